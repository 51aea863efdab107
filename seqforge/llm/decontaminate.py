"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages: windows of 64 words that start every 32 words; an item of the
benchmark into pieces of at most 48 words. A randomised SVD of TF-IDF passages gives a latent
space: Spark tasks multiply their passages with a random basis, partial products are summed
per block of rows, and the orthonormal factor is the next basis. Its rows are the items'
pieces and the passages of all documents over the items' words, added up with random signs
in a bounded number of sums (a count sketch, whose product with itself is that of all
passages but for noise); sums and document frequencies are made in one reading. Every passage of every document is then compared
with every piece by cosine in that space; pairs above a threshold are held to a longest
common subsequence of words, and to the item's answer where the benchmark has one.

The latent space has a bounded rank and a short piece is a small part of a passage, so the
cosine alone loses copies. Every piece is therefore also counted against every window of 96
words: where enough of its words occur at all, runs of about the piece's own length are held
to the same subsequence. The count is an upper bound, so no such copy is lost whatever the
basis. Pieces of fewer than ``SHORTEST`` words meet by chance and are left to the cosine.

Items come in blocks of bounded size; each task holds its texts against one block after another. Scoring
shuffles nothing; its output is one row for each leaked (document, item).

Defined results: null and empty texts leak nothing; null items and items without a word are
ignored; items and documents that repeat give rows each under their own ids, once per pair;
extra columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"\w+")
#: Words of a cell (half a passage), and of an item's piece at most.
CELL, PIECE = 32, 48
#: Rank of the latent space, rounds of subspace iteration, sums to which the passages of all documents are added (fewer for more than TABLE / SUMS words, twice the rank at least).
RANK, ROUNDS, SUMS = 192, 2, 2048
#: Words in more than this share of documents say nothing.
COMMON = 0.3
#: Least cosine of a candidate; least share of a piece's words in common order.
MIN_COSINE, MIN_COMMON = 0.5, 0.6
#: Words of the shortest piece that is sought in runs of its own length.
SHORTEST = 5
#: Words of more pieces than this are counted by a matrix product.
FREQUENT = 16
ITEMS_AT_ONCE = 2048
#: Words that a task scores at a time, and cells times words of a table of bits.
CHUNK, TABLE = 50_000, 16_000_000

PAIRS = "doc_id long, item_id long, cosine double, common_share double"


@dataclass
class Piece:
    item_id: int
    words: list[str]
    answer: list[str]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def pieces_of(items: pd.DataFrame) -> list[Piece]:
    """Pieces of nearly equal length of every item; rows: item_id, text, answer."""
    pieces = []
    for item_id, text, answer in zip(items["item_id"].tolist(), items["text"], items["answer"], strict=True):
        words = words_of(text)
        n = math.ceil(len(words) / PIECE)
        for k in range(n):
            pieces.append(Piece(item_id, words[len(words) * k // n : len(words) * (k + 1) // n], words_of(answer)))
    return pieces


def common_words(mask: dict[str, int], length: int, span: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel; mask: word -> its places among ``length`` words."""
    full = v = (1 << length) - 1
    for w in span:
        if u := v & mask.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def masks_of(piece: Piece) -> dict[str, int]:
    mask: dict[str, int] = {}
    for i, w in enumerate(piece.words):
        mask[w] = mask.get(w, 0) | 1 << i
    return mask


def passages(texts: list[str | None], index: dict[str, int]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; of each vocabulary word in them its id and cell; the text of each cell. A text has ceil(words / CELL) cells."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    cells = -(-sizes // CELL)
    first = np.cumsum(cells) - cells
    ids = np.fromiter(map(index.get, chain.from_iterable(split), repeat(-1)), dtype=np.int64, count=int(sizes.sum()))
    text_of = np.repeat(np.arange(len(split)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell = first[text_of] + place // CELL
    return split, ids[ids >= 0], cell[ids >= 0], np.repeat(np.arange(len(split)), cells)


class Overlap:
    """Counts of the words of every piece that occur in windows of three cells."""

    def __init__(self, pieces: list[Piece], index: dict[str, int]):
        entries = sorted((index[w], i, n) for i, p in enumerate(pieces) for w, n in Counter(p.words).items())
        word, piece, times = (np.array(x, dtype=np.int64) for x in zip(*entries, strict=True))
        self.n_words, self.n_pieces = len(index), len(pieces)
        self.length = np.bincount(piece, times, self.n_pieces)
        frequent = np.bincount(word, minlength=self.n_words) > FREQUENT
        self.column = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.dense = np.zeros((int(frequent.sum()), self.n_pieces), dtype=np.float32)
        often = frequent[word]
        self.dense[self.column[word[often]], piece[often]] = times[often]
        word, self.piece, self.times = word[~often], piece[~often], times[~often]
        self.size = np.bincount(word, minlength=self.n_words)
        self.start = np.cumsum(self.size) - self.size

    def near(self, ids: np.ndarray, cell: np.ndarray, owner: np.ndarray, min_common: float) -> Iterator[tuple[int, int]]:
        """(first cell, piece) of the windows that hold enough of a piece's words; ids and their cells, the text of each cell."""
        at, word = self._held(ids, cell, owner)
        step = max(1, 4_000_000 // self.n_pieces)
        for low in range(0, len(owner), step):
            a, b = np.searchsorted(at, [low, low + step])
            rows, w, n = at[a:b] - low, word[a:b], min(step, len(owner) - low)
            held = np.zeros((n, len(self.dense)), dtype=np.float32)
            often = self.column[w] >= 0
            held[rows[often], self.column[w[often]]] = 1
            size = self.size[w]
            entry = np.repeat(self.start[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            place = np.repeat(rows, size) * self.n_pieces + self.piece[entry]
            counted = held @ self.dense + np.bincount(place, self.times[entry], n * self.n_pieces).reshape(n, -1)
            enough = (counted >= min_common * self.length - 1e-3) & (self.length >= SHORTEST)
            for k in np.flatnonzero(enough.ravel()).tolist():
                yield low + k // self.n_pieces, k % self.n_pieces


    def _held(self, ids: np.ndarray, cell: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First cell and word of all different words of the windows, in order; by a table of bits where that is small."""
        if len(owner) * self.n_words <= TABLE:
            held = np.zeros((len(owner), self.n_words), dtype=bool)
            held[cell, ids] = True
            alone = held.copy()
            for ahead in (1, 2):
                held[:-ahead] |= alone[ahead:] & (owner[ahead:] == owner[:-ahead])[:, None]
            keys = np.flatnonzero(held.ravel())
            at = keys // self.n_words
            return at, keys - at * self.n_words
        shifted = []
        for back in range(3):
            first = cell - back
            inside = first >= 0
            inside[inside] = owner[first[inside]] == owner[cell[inside]]
            shifted.append(first[inside] * self.n_words + ids[inside])
        keys = np.unique(np.concatenate(shifted))
        return keys // self.n_words, keys % self.n_words


def close_copy(piece: Piece, mask: dict[str, int], span: list[str], min_common: float) -> float:
    """Largest common share of a run of ``span`` that is a quarter longer than the piece; 0 if none has ``min_common``."""
    n = len(piece.words)
    if common_words(mask, n, span) < min_common * n:
        return 0.0
    reach = n + n // 4 + 1
    share = max(common_words(mask, n, span[at : at + reach]) for at, w in enumerate(span) if w in mask) / n
    return share if share >= min_common else 0.0


def n_sums(n_words: int) -> int:
    return min(SUMS, max(2 * RANK, TABLE // max(1, n_words)))


def _dealt(key: np.ndarray, number: np.ndarray, sums: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each passage and its sign, as a function of its row's hash and its number in the text."""
    h = key.astype(np.uint64) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(1)) % np.uint64(sums)).astype(np.int64), (h & np.uint64(1)).astype(np.int32) * 2 - 1


def corpus_counts(docs: DataFrame, index: dict[str, int]) -> tuple[int, np.ndarray, DataFrame]:
    """Number of documents, number of those that hold each word, and the kept sums (at: number of the first, part: their integers) of the passages of all documents.

    Integers are added, so neither partitions nor retries change a sum.
    """
    v, sums = len(index), n_sums(len(index))
    block = max(1, 65_536 // v)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df, total = 0, np.zeros(v, dtype=np.int64), np.zeros(sums * v, dtype=np.int32)
        for batch in batches:
            n += len(batch)
            for keys, texts in _chunks(batch["key"].tolist(), batch["text"].tolist()):
                _, ids, cell, owner = passages(texts, index)
                df += np.bincount(np.unique(owner[cell] * v + ids) % v, minlength=v)
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                to, sign = _dealt(np.array(keys, dtype=np.int64)[owner], number, sums)
                np.add.at(total, to[cell] * v + ids, sign[cell])
                second = number[cell] > 0  # also the second cell of the passage before
                at = cell[second] - 1
                np.add.at(total, to[at] * v + ids[second], sign[at])
        made = total.reshape(sums, v)
        narrow = made.astype(np.min_scalar_type(-1 - int(np.abs(made).max(initial=0))))
        starts = list(range(0, sums, block))
        yield pd.DataFrame({"at": [-1, *starts], "part": [np.append(df, n).tobytes(), *(narrow[k : k + block].tobytes() for k in starts)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group["at"].iloc[0])
        size = v + 1 if at < 0 else min(block, sums - at) * v
        summed = sum(np.frombuffer(p, dtype=f"i{len(p) // size}").astype(np.int64) for p in group["part"])
        return pd.DataFrame({"at": [at], "part": [summed.tobytes()]})

    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").transform(common.in_batches, task, "at long, part binary")
    kept = common.stored(rows.groupBy("at").applyInPandas(add, "at long, part binary"))
    counted = kept.where("at < 0").first()
    df = np.frombuffer(counted["part"], dtype=np.int64) if counted else np.zeros(v + 1, dtype=np.int64)
    return int(df[-1]), df[:-1], kept.where("at >= 0")


def latent_basis(sums: DataFrame, columns: np.ndarray, n_words: int, pieces: list[Piece], index: dict[str, int], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Orthonormal words x rank basis of the leading right singular vectors, by distributed subspace iteration; ``columns``: the index's words in ``sums`` of ``n_words``."""
    v, rank = len(index), min(rank, len(index))
    spark = sums.sparkSession

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch["part"]:
                made = np.frombuffer(part, dtype=np.int64).reshape(-1, n_words)[:, columns]
                made = made[made.any(axis=1)]
                terms = [np.flatnonzero(r) for r in made]
                times = [r[t].astype(np.float32) for r, t in zip(made, terms, strict=True)]
                yield pd.DataFrame({"terms": pd.Series([t.astype(np.int32) for t in terms], dtype=object), "times": pd.Series(times, dtype=object), "weight": np.ones(len(made), dtype=np.float32)})

    schema = "terms array<int>, times array<float>, weight float"
    theirs = common.cut(sums.transform(common.in_batches, rows, schema))
    own = [[index[w] for w in p.words if w in index] for p in pieces]
    heavy = math.sqrt(1 + theirs.count() / max(1, len(pieces)))
    mine = spark.createDataFrame([(t, [1.0] * len(t), float(heavy)) for t in own if t], schema)
    matrix = common.cut(theirs.unionByName(mine).coalesce(8))
    block = 512

    def product(basis: np.ndarray) -> np.ndarray:
        """A'A basis, by partial sums of the tasks."""

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((v, rank), dtype=np.float32)
            step = max(1, 8_000_000 // v)
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.iloc[at : at + step]
                    a = np.zeros((len(part), v), dtype=np.float32)
                    for i, (terms, times, weight) in enumerate(zip(part["terms"], part["times"], part["weight"], strict=True)):
                        np.add.at(a[i], terms, times * idf[terms])
                        a[i] *= weight / max(float(np.linalg.norm(a[i])), 1e-9)
                    total += a.T @ (a @ basis)
            starts = range(0, v, block)
            yield pd.DataFrame({"at": list(starts), "part": [total[i : i + block].tobytes() for i in starts]})

        def add(group: pd.DataFrame) -> pd.DataFrame:
            summed = sum(np.frombuffer(p, dtype=np.float32) for p in group["part"])
            return pd.DataFrame({"at": group["at"].iloc[:1], "part": [summed.tobytes()]})

        parts = matrix.transform(common.in_batches, task, "at long, part binary").groupBy("at").applyInPandas(add, "at long, part binary").toPandas().sort_values("at")
        return np.vstack([np.frombuffer(p, dtype=np.float32).reshape(-1, rank) for p in parts["part"]])

    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((v, rank)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    return basis


def scorer(sums: DataFrame, words: dict[str, int], pieces: list[Piece], n_docs: int, counts: np.ndarray, min_cosine: float, min_common: float) -> Callable[[list, list], list[tuple]]:
    """(doc_ids, texts) -> pairs, for a block of items: its latent space and what its pieces are counted by."""
    df = {w: int(counts[words[w]]) for p in pieces for w in p.words}
    vocabulary = frozenset(w for p in pieces for w in p.words)
    # words that most documents hold are left out; where that leaves a piece nothing, its rarest words stay
    kept = {w for w in vocabulary if df.get(w, 0) <= COMMON * n_docs}
    for p in pieces:
        if kept.isdisjoint(p.words):
            kept.update(sorted(set(p.words), key=lambda w: (df.get(w, 0), w))[:3])
    index = {w: i for i, w in enumerate(sorted(kept))}
    idf = np.array([math.log((1 + n_docs) / (1 + df.get(w, 0))) + 0.1 for w in index], dtype=np.float32)
    columns = np.array([words[w] for w in index], dtype=np.int64)
    vectors = latent_basis(sums, columns, len(words), pieces, index, idf) * idf[:, None]
    targets = np.zeros((len(pieces), vectors.shape[1]), dtype=np.float32)
    for i, p in enumerate(pieces):
        targets[i] = vectors[[index[w] for w in p.words if w in index]].sum(axis=0)
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-9)
    masks = [masks_of(p) for p in pieces]
    whole = {w: i for i, w in enumerate(sorted(vocabulary))}
    to_kept = np.array([index.get(w, -1) for w in whole], dtype=np.int64)
    overlap = Overlap(pieces, whole)

    def score(doc_ids: list, texts: list) -> list[tuple]:
        split, every, places, owner = passages(texts, whole)
        if not len(every):
            return []
        kept_id = to_kept[every]
        ids, cell = kept_id[kept_id >= 0], places[kept_id >= 0]
        sums = np.zeros((len(owner) + 1, vectors.shape[1]), dtype=np.float32)
        # the n-th kept word of every cell at a time
        first_of = np.searchsorted(cell, np.arange(len(owner)))
        size = np.searchsorted(cell, np.arange(len(owner)), side="right") - first_of
        for n in range(int(size.max(initial=0))):
            more = np.flatnonzero(size > n)
            sums[more] += vectors[ids[first_of[more] + n]]
        follows = np.append(owner[1:] == owner[:-1], False)  # the next cell is of the same text
        window = sums[:-1] + sums[1:] * follows[:, None]
        window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
        cosine = window @ targets.T
        first = np.searchsorted(owner, np.arange(len(split)))
        best: dict[tuple, tuple[float, float]] = {}
        for k in np.flatnonzero((cosine >= min_cosine).ravel()).tolist():
            at, i = divmod(k, len(pieces))
            d = int(owner[at])
            start = (at - int(first[d])) * CELL
            span = split[d][max(0, start - CELL) : start + 3 * CELL]
            p = pieces[i]
            share = common_words(masks[i], len(p.words), span) / len(p.words)
            if share >= min_common and (not p.answer or f" {' '.join(p.answer)} " in f" {' '.join(span)} "):
                key = (doc_ids[d], p.item_id)
                best[key] = max(best.get(key, (0.0, 0.0)), (share, float(cosine[at, i])))
        for at, i in overlap.near(every, places, owner, min_common):
            d, p = int(owner[at]), pieces[i]
            key = (doc_ids[d], p.item_id)
            if key in best:
                continue
            start = (at - int(first[d])) * CELL
            share = close_copy(p, masks[i], split[d][start : start + 3 * CELL], min_common)
            around = split[d][max(0, start - CELL) : start + 3 * CELL]
            if share and (not p.answer or f" {' '.join(p.answer)} " in f" {' '.join(around)} "):
                best[key] = (share, float(cosine[at, i]))
        return [(*key, c, s) for key, (s, c) in best.items()]

    return score


def _chunks(keys: list, texts: list) -> Iterator[tuple[list, list]]:
    """Keys and texts of a batch, CHUNK words at a time."""
    first, size = 0, 0
    for k, t in enumerate(texts, 1):
        size += len(t or "") // 6
        if size >= CHUNK or k == len(texts):
            yield keys[first:k], texts[first:k]
            first, size = k, 0


def _scored(batch: pd.DataFrame, score: Callable[[list, list], list[tuple]]) -> list[tuple]:
    return [pair for part in _chunks(batch["doc_id"].tolist(), batch["text"].tolist()) for pair in score(*part)]


def leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE, min_common: float = MIN_COMMON, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """doc_id, item_id, cosine, common_share of every leaked pair. ``benchmark``: item_id, text and, if it has one, answer.

    Documents are read twice, however many blocks of items there are: for the frequencies and sums of all items' words, and to be scored
    against every block in turn. What several blocks are scored by is kept in the shared folder and loaded by the tasks.
    """
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    items = common.cut(benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text", answer.cast("string").alias("answer")).distinct())
    n = max(1, math.ceil(items.count() / items_at_once))
    blocks = [pieces_of(items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").toPandas()) for k in range(n)]
    blocks = [pieces for pieces in blocks if pieces]
    spark = docs.sparkSession
    if not blocks:
        return spark.createDataFrame([], PAIRS)
    words = {w: i for i, w in enumerate(sorted({w for pieces in blocks for p in pieces for w in p.words}))}
    n_docs, counts, sums = corpus_counts(docs, words)
    made = (scorer(sums, words, pieces, n_docs, counts, min_cosine, min_common) for pieces in blocks)
    scorers: list = [next(made)]
    if len(blocks) > 1:
        folder = f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
        scorers = [_put(f"{folder}/{k}", score) for k, score in enumerate(chain(scorers, made))]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for score in scorers:
                found = _scored(batch, _got(score) if isinstance(score, str) else score)
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "cosine", "common_share"])

    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text").transform(common.in_batches, task, PAIRS)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common_share").alias("common_share"))


def _put(path: str, score: Callable[[list, list], list[tuple]]) -> str:
    where, name = common.file_at(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(name) as out:
        out.write(cloudpickle.dumps(score))
    return path


def _got(path: str) -> Callable[[list, list], list[tuple]]:
    where, name = common.file_at(path)
    with where.open_input_stream(name) as data:
        return cloudpickle.loads(data.read())
