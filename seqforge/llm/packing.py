"""Vector bin packing of tokenised examples into training sequences.

Each task packs the examples of its own partition, as a stream: an example that overflows
a sequence by itself gives off full sequences, and what remains waits in a pool of bounded
size. A sequence is filled from the pool by the dot-product heuristic: of the examples that
fit under all limits (tokens, segments, loss-bearing tokens), the one whose demand vector
has the largest dot product with the sequence's free capacity goes in. When none fits
whole, the best one is cut to fill the gap. A sequence that another limit closes early is cut
back to a power of two, and what it gives up goes back to the pool; a partition's last tokens
fill sequences of powers of two as well, so that nothing is padded. No shuffle is needed and no
task holds more than the pool and the remembered chunks, which are bounded both.

Defined results: null text is an example of the end token alone; repeated rows are packed
as often as they occur; null ids pass through; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Sequences numbered within a partition.
PER_PARTITION = 1 << 40
SEPARATORS, SPACES = re.compile("[\x1c-\x1f]"), re.compile("[^\\S\x1c-\x1f]+")
#: Marks that the word tokenizer cuts from a word of letters.
MARKS = ".,;:!?"
#: Chunks whose ids a worker remembers (about 250 bytes each), of all but one text; documents tokenised at a time.
MAX_CHUNKS, AT_ONCE = 300_000, 256
#: Words of letters below it, which are prepared one by one, go to the tokenizer's model directly.
LATIN_END = "\u0100"


@dataclass(frozen=True)
class Limits:
    """Of one sequence; ``pool``: examples that wait at most, before a sequence is closed."""

    tokens: int = 4096
    segments: int = 16
    loss_tokens: int = 4096
    pool: int = 512


class Packer:
    """Packs (key, ids, loss prefix sums) examples; gives rows of PIECES."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.items: list[list] = []  # key, ids left, their loss prefix, place of the first, ids of the whole example
        self.demand = np.zeros((limits.pool + 1, 3))
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray, loss: np.ndarray) -> None:
        """loss[i]: loss-bearing tokens among the first i ids."""
        item = [key, ids, loss, 0, len(ids)]
        while len(item[1]) >= self.limits.tokens or item[2][-1] - item[2][0] > self.limits.loss_tokens:  # a sequence of its own
            n = self._fitting(item, self.cap)
            self._place(item, n if n == self.limits.tokens else _power_below(n), 0)
            self.next_id += 1
        if len(item[1]):
            item[1:3] = item[1].copy(), item[2].copy()  # lets go of what is packed
            self._keep(len(self.items), item)
        while len(self.items) > self.limits.pool:
            self.close_one()

    def _keep(self, k: int, item: list) -> None:
        self.items[k : k + 1] = [item]
        self.demand[k] = (len(item[1]), 1, item[2][-1] - item[2][0])

    def _fitting(self, item: list, free: np.ndarray) -> int:
        """Most tokens of the item that the free capacity takes."""
        _, ids, loss, _, _ = item
        if free[1] < 1:
            return 0
        return min(len(ids), int(free[0]), int(np.searchsorted(loss, loss[0] + free[2], side="right")) - 1)

    def _place(self, item: list, n: int, offset: int) -> None:
        key, ids, loss, start, total = item
        self.rows.append((key, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), total, self.next_id, offset, int(loss[n] - loss[0])))
        item[1:4] = ids[n:], loss[n:], start + n

    def _remove(self, k: int) -> None:
        last = len(self.items) - 1
        self.items[k], self.demand[k] = self.items[last], self.demand[last]
        self.items.pop()

    def close_one(self, tokens: int | None = None) -> None:
        """Fills one sequence from the pool, of ``tokens`` at most if given."""
        free = self.cap.copy()
        free[0] = tokens or free[0]
        demand = self.demand[: len(self.items)].copy()
        scaled = demand / self.cap
        chosen: list[tuple[int, int]] = []  # item, tokens
        while free[0] >= 1 and free[1] >= 1 and len(chosen) < len(self.items):
            score = scaled @ (free / self.cap)
            fits = (demand[:, 0] <= free[0]) & (demand[:, 2] <= free[2])  # every item is one segment
            k = int(np.argmax(np.where(fits, score, -1.0)))
            if not fits[k]:
                k = int(np.argmax(score))
            n = int(demand[k, 0]) if fits[k] else self._fitting(self.items[k], free)
            if n < 1:
                break
            loss = self.items[k][2]
            free -= (n, 1, loss[n] - loss[0])
            demand[k], scaled[k] = np.inf, -1e6  # taken
            chosen.append((k, n))
        size = sum(n for _, n in chosen)
        size = size if size == self.limits.tokens else _power_below(size)
        offset = 0
        for k, n in chosen:
            if n := min(n, size - offset):
                self._place(self.items[k], n, offset)
                offset += n
        for k in sorted((k for k, _ in chosen), reverse=True):
            if len(self.items[k][1]):
                self._keep(k, self.items[k])
            else:
                self._remove(k)
        self.next_id += 1

    def flush(self) -> None:
        """Empties the pool; the last tokens fill sequences of powers of two, which need no padding."""
        while self.items:
            left = int(self.demand[: len(self.items), 0].sum())
            self.close_one(min(self.limits.tokens, 1 << (left.bit_length() - 1)))

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _power_below(n: int) -> int:
    """The largest power of two up to n."""
    return 1 << (n.bit_length() - 1)


def chunks_of(text: str) -> list[str]:
    """Chunks between spaces, in lower case where that is safe: the tokenizer lower-cases all but its special tokens."""
    if text.isascii() and "<|" not in text:
        text = text.lower()
    if SEPARATORS.search(text):  # which Python counts as spaces and the tokenizer does not
        return [c for c in SPACES.split(text) if c]
    return text.split()


class WordIds(dict):
    """texts -> ids, for a tokenizer that lower-cases and drops white space: each chunk between spaces is tokenised once and remembered.

    The ids of a chunk that is not there are made when they are asked for. Once half of
    ``max_chunks`` are there they become the older half, of which those stay that are asked
    for again before the newer half is full.
    """

    def __init__(self, tokenizer_path: str, max_chunks: int = MAX_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.half, self.older = Tokenizer.from_file(tokenizer_path), max(1, max_chunks // 2), {}
        self.tokenize, self.normal = self.tokenizer.model.tokenize, self.tokenizer.normalizer.normalize_str
        #: What the tokenizer makes of each Latin letter before its model reads the word.
        prepared = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(self.normal(c))
        self.letters = {ord(c): "".join(piece for piece, _ in prepared(c)) for c in map(chr, range(ord(LATIN_END))) if c.isalpha()}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._made(chunk)
        self[chunk] = ids
        return ids

    def _made(self, chunk: str) -> bytes:
        """Marks after a word of letters are tokens of their own, so words are remembered without them; not after letters that normalise to a letter and an accent, which joins the marks."""
        word = chunk.rstrip(MARKS)
        if word.isalpha():
            latin = word.isascii() or max(word) < LATIN_END
            if latin or self.normal(word).isalpha():
                if word != chunk:
                    return self[word] + self[chunk[len(word) :]]
                if latin:
                    return array("I", [t.id for t in self.tokenize(word.translate(self.letters))]).tobytes()
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        for text in texts:
            found.append(np.frombuffer(b"".join(map(self.__getitem__, chunks_of(text))), dtype="<u4"))
            if len(self) > self.half:
                self.older = dict(self)
                self.clear()
        return found


def _encoder(tokenizer_path: str) -> WordIds:
    return common.worker_state(f"word ids of {tokenizer_path}", lambda: WordIds(tokenizer_path))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents; every id of a document but its first bears loss."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = _encoder(tokenizer_path), Packer(limits, TaskContext.get().partitionId() * PER_PARTITION)
        for batch in batches:
            keys, texts = batch["key"].tolist(), [t or "" for t in batch["text"]]
            for at in range(0, len(keys), AT_ONCE):
                for k, found in zip(keys[at : at + AT_ONCE], encode(texts[at : at + AT_ONCE]), strict=True):
                    ids = np.append(found, np.uint32(end_id))
                    packer.add(k, ids, np.maximum(np.arange(len(ids) + 1) - 1, 0))
            yield frame(packer.taken())
        packer.flush()
        yield frame(packer.taken())

    pieces = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).transform(common.in_batches, task, PIECES)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_turns(turns: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Pieces of instruction data (conv_id, turn, role, text): loss falls on the assistant's tokens only. doc_id is conv_id."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select(F.col("conv_id").cast("string").alias("key"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = _encoder(tokenizer_path), Packer(limits, TaskContext.get().partitionId() * PER_PARTITION)
        for batch in batches:
            for k, roles, texts in zip(batch["key"].tolist(), batch["roles"], batch["texts"], strict=True):
                parts = [np.append(found, np.uint32(end_id)) for found in encode(list(texts))]
                bears = np.concatenate([np.full(len(p), r == "assistant") for p, r in zip(parts, roles, strict=True)])
                packer.add(k, np.concatenate(parts), np.append(0, np.cumsum(bears)))
            yield frame(packer.taken())
        packer.flush()
        yield frame(packer.taken())

    return whole.transform(common.in_batches, task, PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({c: "int64" for c in names[1:]})
