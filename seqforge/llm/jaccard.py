"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; two are linked if their Jaccard similarity
is at least 0.8. Documents of equal sets are one class, joined once.

Every class has a signature of 128 minimum hashes: tokens that two sets share with a
probability equal to their similarity. A run starts with all classes in one bucket and
splits buckets recursively: in each bucket, one token place or two (1 / threshold on
average) are sampled by a hash of the path so far, and classes with equal tokens there stay
together. Buckets of one class end and small ones are compared by brute force. In a larger
bucket, classes whose mean similarity to the whole bucket is high are dense: splitting would part
them slowly or never, so they are compared with all of the bucket at once, block by block; only
the sparse rest, if there is much of it, is split again, and at the last level nothing is left over. Runs
repeat until the expected recall of a pair at the threshold is at least the target at the
deepest level that was reached; runs beyond those that the first level needs are made for the
classes that went deeper only.

Splitting is column arithmetic: the first level reads four bytes of a token, deeper ones a byte.
In a bucket, sketches of a byte per token are compared first, then the exact sets (64-bit hashes
of the shingles) of those that may be linked. A pair may meet in several buckets: the one with
the smallest path owns it, which both classes tell from their lists of paths, so every link is
verified and counted once. Links leave a task as a count per class and a spanning forest, never
as pairs; connected groups follow from the forest by alternating star contraction.

Defined results: a text of one to four words is one shingle; texts without a word and null
doc_ids are linked to nothing and are groups of their own; rows that share a doc_id are
joined by their sets; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.995
TOKENS = 128
#: Classes of a bucket that are compared by brute force (a second, spread over ten cells; a level more costs several passes); levels of a path; classes of a block of a dense bucket, and the shingles of one at most (on average).
SMALL, LEVELS, BLOCK_CLASSES, BLOCK_SHINGLES = 4096, 6, 1024, 2_000_000
#: A class is dense in a bucket if its mean similarity to it is above this share of the threshold, estimated from so many tokens; values rarer than RARE count as none.
#: At half the threshold, a level more would save two thirds of the comparisons and cost as much again in runs.
DENSE, PROBES, RARE = 0.6, 16, 0.02
#: Buckets whose shares of values (some 10 KB each) are broadcast at most.
MAX_SHARES = 2000
#: Shared tokens below the expected number that still send a pair to verification, in standard deviations.
SLACK = 4.5
#: Words hashed at a time, and shingles of which minima are taken at a time.
CHUNK, BLOCK = 200_000, 4096
ODD = np.uint64(0x9E3779B97F4A7C15)

_random = np.random.default_rng(11)
MULTIPLY = _random.integers(1 << 62, size=(TOKENS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(1 << 62, size=(TOKENS, 1), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text."""
    split = [t.lower().split() if t else [] for t in texts]
    flat = [w for s in split for w in s]
    if not flat:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=len(flat) > 1000)
    sets, at = [], 0
    for s in split:
        h = hashed[at : at + len(s)]
        at += len(s)
        n = max(1, len(h) - words + 1) if len(h) else 0
        total = np.zeros(n, dtype=np.uint64)
        for k in range(min(words, len(h))):
            total = total * ODD + h[k : k + n]
        sets.append(np.unique(mixed(total)))
    return sets


def signature(tokens: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function."""
    least = np.full(TOKENS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(tokens), BLOCK):
        block = (MULTIPLY * tokens[None, at : at + BLOCK] + ADD) >> np.uint64(32)
        np.minimum(least, block.min(axis=1).astype(np.uint32), out=least)
    return least


def _text_chunks(batch: pd.DataFrame) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for d, t in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
        ids.append(d), texts.append(t)
        size += len(t or "") // 6
        if size >= CHUNK:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, set_id, size, sig (128 tokens of four bytes) of every row; set_id and sig are null where there is no id or no word."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ids, texts in _text_chunks(batch):
                for d, tokens in zip(ids, shingle_sets(texts, words), strict=True):
                    has = d is not None and len(tokens) > 0
                    rows.append((d, str(_set_id(tokens)), len(tokens), signature(tokens).astype("<u4").tobytes()) if has else (d, None, 0, None))
            yield pd.DataFrame(rows, columns=["doc_id", "set_id", "size", "sig"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").transform(common.in_batches, task, "doc_id string, set_id string, size long, sig binary")
    return found.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "set_id")})  # nullable longs would reach pandas as floats


def token_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """set_id, tokens (eight bytes each) of the documents with a word."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in _text_chunks(batch):
                rows = [(_set_id(tokens), tokens.astype("<u8").tobytes()) for tokens in shingle_sets(texts, words) if len(tokens)]
                yield pd.DataFrame(rows, columns=["set_id", "tokens"])

    return docs.select("doc_id", "text").transform(common.in_batches, task, "set_id long, tokens binary")


# paths


def survival(depth: int, threshold: float) -> float:
    """Chance that a pair at the threshold shares a path of ``depth`` levels: a branching process with 1 / threshold samples a level."""
    second, alive = 1 / threshold - 1, 1.0
    for _ in range(depth):
        gone = 1 - threshold * alive
        alive = 1 - (1 - second) * gone - second * gone * gone
    return alive


def runs_for(depth: int, threshold: float, recall: float) -> int:
    alive = survival(depth, threshold)
    return 1 if alive >= recall else math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _places(run: int, threshold: float) -> list[int]:
    """The token places that a run samples in its first bucket."""
    first, second, u = (xxhash.xxh64_intdigest(f"{run} {k}") for k in range(3))
    first, second = first % TOKENS, second % TOKENS
    return [first, second] if u < (1 / threshold - 1) * 2**64 and second != first else [first]


def _even(path: Column) -> Column:
    """Paths are even, so that the lowest bit can mark a sparse class."""
    return path.bitwiseAND(F.lit(-2))


def _first_level(classes: DataFrame, runs: range, threshold: float) -> DataFrame:
    """path, set_id from the roots (set_id, roots: four bytes for each place of each run)."""
    places = [(run, place) for run in range(runs.stop) for place in _places(run, threshold)]
    paths = [_even(F.xxhash64(F.lit(run), F.lit(place), F.substring("roots", 4 * at + 1, 4))) for at, (run, place) in enumerate(places) if run in runs]
    return classes.select(F.explode(F.array(*paths)).alias("path"), "set_id")


def _next_level(open_: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """path, set_id of the buckets that the buckets of ``open_`` (path, set_id) are split into."""
    rows = open_.join(sketches, "set_id")
    place = lambda k: F.pmod(F.xxhash64("path", F.lit(k)), F.lit(TOKENS)).cast("int")
    path = lambda p: _even(F.xxhash64("path", p, F.substring(F.col("sketch"), p + 1, F.lit(1))))
    both = (F.pmod(F.xxhash64("path", F.lit(2)), F.lit(1 << 20)) < int((1 / threshold - 1) * (1 << 20))) & (place(0) != place(1))
    return rows.select(F.explode(F.array_compact(F.array(path(place(0)), F.when(both, path(place(1)))))).alias("path"), "set_id")


def _dense(large: DataFrame, n_paths: int, sketches: DataFrame, threshold: float) -> DataFrame:
    """``large`` (path, set_id, n; of ``n_paths`` buckets) with ``dense``: whether the class is near most of its bucket."""
    probes = F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: (i * 256 + F.conv(F.hex(F.substring(F.col("sketch"), i * (TOKENS // PROBES) + 1, F.lit(1))), 16, 10).cast("int")).cast("int"))
    rows = large.join(sketches, "set_id").select("path", "set_id", "n", probes.alias("probes"))
    counted = rows.select("path", "n", F.explode("probes").alias("value")).groupBy("path", "n", "value").agg(F.count("*").alias("c")).where(F.col("c") >= RARE * F.col("n"))
    share = F.map_from_entries(F.collect_list(F.struct("value", (F.col("c") / F.col("n")).alias("share"))))  # at most PROBES / RARE entries
    shares = common.broadcast_if(counted.groupBy("path").agg(share.alias("share")), n_paths, MAX_SHARES)
    mean = F.aggregate(F.transform("probes", lambda v: F.coalesce(F.try_element_at("share", v), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) / PROBES
    return rows.join(shares, "path", "left").select("path", "set_id", "n", (mean >= DENSE * threshold).alias("dense"))


def _run(start: DataFrame, sketches: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None, int]:
    """Buckets to compare (path, set_id, n, dense: null in buckets of one block), the classes that went deeper, the deepest level."""
    split, done, deeper, level = start, None, None, 1
    while True:
        sizes = common.cut(split.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        n_paths, n_large = sizes.agg(F.count("*"), F.count_if(F.col("n") > SMALL)).first()
        rows = split.join(common.broadcast_if(sizes, n_paths), "path")
        small = rows.where(F.col("n") <= SMALL).withColumn("dense", F.when(F.col("n") > BLOCK_CLASSES, True))
        done = small if done is None else done.unionByName(small)
        if not n_large:
            return done, deeper, level
        large = split.join(common.broadcast_if(sizes.where(F.col("n") > SMALL), n_large), "path")
        judged = common.stored(large.withColumn("dense", F.lit(True)) if level == LEVELS else _dense(large, n_large, sketches, threshold))
        kinds = common.cut(judged.groupBy("path").agg(F.count_if("dense").alias("n_dense"), F.count_if(~F.col("dense")).alias("n_sparse")))
        # few sparse classes stay with the dense ones; a bucket without dense ones is only split
        judged = judged.join(common.broadcast_if(kinds, n_large), "path").withColumn("dense", F.col("dense") | (F.col("n_sparse") <= SMALL))
        done = done.unionByName(judged.where((F.col("n_dense") > 0) | F.col("dense")).select("path", "set_id", "n", "dense"))
        if kinds.where(F.col("n_sparse") > SMALL).isEmpty():
            return done, deeper, level
        sparse = judged.where("NOT dense").select("path", "set_id")
        split = common.stored(_next_level(sparse, sketches, threshold))
        level += 1
        ids = sparse.select("set_id")
        deeper = ids if deeper is None else deeper.unionByName(ids)


def buckets(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """path, set_id, n, dense of all buckets to compare, of as many runs as the recall needs; kept. ``classes``: set_id, roots, sketch."""
    sketches, roots = classes.select("set_id", "sketch"), classes.select("set_id", "roots")
    made = runs_for(1, threshold, recall)
    found, deeper, depth = _run(_first_level(roots, range(made), threshold), sketches, threshold)
    while (needed := runs_for(depth, threshold, recall)) > made:
        again = common.cut(deeper.distinct())
        start = _first_level(roots.join(common.sized(again), "set_id", "left_semi"), range(made, needed), threshold)
        more, further, level = _run(start, sketches, threshold)
        found, depth, made = found.unionByName(more), max(depth, level), needed
        deeper = again if further is None else again.unionByName(further)
    return common.stored(found)


# comparing


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of equal keys in sorted batches."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        if held:
            columns = {c: np.concatenate([held[c], v]) for c, v in columns.items()}
        keys = columns[key]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
        for a, b in zip(starts, starts[1:]):
            yield {c: v[a:b] for c, v in columns.items()}
        held = {c: v[starts[-1] :] for c, v in columns.items()}
    if held:
        yield held


def _roots(near: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected part, of a symmetric matrix of links."""
    root = np.arange(len(near))
    while True:
        least = np.where(near, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _owned(path: int, paths: list[np.ndarray]) -> np.ndarray:
    """Whether no path before ``path`` compares the pair, for all pairs. Odd entries are buckets in which the class is sparse: two sparse ones are not compared there."""
    place = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
    flat = np.concatenate(paths)
    earlier = (flat & -2) < path
    place, flat = place[earlier], flat[earlier]
    names, column, count = np.unique(flat & -2, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    place, flat, column = place[shared], flat[shared], column[shared]
    names, column = np.unique(column, return_inverse=True)
    any_ = np.zeros((len(paths), len(names)), dtype=np.float32)
    any_[place, column] = 1
    even = any_.copy()
    even[place, column] = (flat & 1) == 0
    met = even @ any_.T
    return (met + met.T) == 0


def _comparable(group: dict[str, np.ndarray]) -> np.ndarray:
    """The pairs that a cell has to judge: owned by its path, of different classes, not both sparse, of two blocks where the cell has two."""
    path, own = int(group["path"][0]), group["own"]
    pairs = _owned(path, list(group["paths"]))
    np.fill_diagonal(pairs, False)
    if own[0] >= 0:
        dense = group["dense"].astype(bool)
        pairs &= dense[:, None] | dense[None, :]
        if (own != own[0]).any():
            pairs &= own[:, None] != own[None, :]
    return pairs


CELLS = "cell long, path long, own int, dense boolean, paths array<long>, set_id long"


def cells(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``CELLS`` and sketch: every bucket, a large one as the pairs of its blocks; ``own`` is a row's block (-1 in buckets of one), ``paths`` all buckets of its class."""
    listed = found.groupBy("set_id").agg(F.sort_array(F.collect_list(F.when(F.col("dense").isNull() | F.col("dense"), F.col("path")).otherwise(F.col("path") + 1))).alias("paths"))
    large = found.where("dense IS NOT NULL")
    shingles = large.join(classes.select("set_id", "size"), "set_id").groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    number = common.sized(common.cut(shingles.select("path", blocks.alias("blocks"))))
    dealt = found.join(number, "path", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("set_id", "path"), F.col("blocks")).cast("int"), F.lit(-1)))
    other = F.when(F.col("own") >= 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))
    spread = dealt.withColumn("other", F.explode(other))
    cell = F.when(F.col("own") < 0, F.col("path")).otherwise(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")))
    rows = spread.select(cell.alias("cell"), "path", "own", F.coalesce("dense", F.lit(True)).alias("dense"), "set_id")
    return rows.join(listed.join(classes.select("set_id", "sketch"), "set_id"), "set_id")


def members(rows: DataFrame, threshold: float) -> DataFrame:
    """``CELLS`` of the classes with a pair in their cell that the sketches take for a link."""
    least = TOKENS * threshold - SLACK * math.sqrt(TOKENS * threshold * (1 - threshold))
    names = [c.split()[0] for c in CELLS.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in _groups(batches, "cell"):
            sketch = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(-1, TOKENS)
            n = len(sketch)
            near = np.zeros((n, n), dtype=bool)
            for k in range(n - 1):
                near[k, k + 1 :] = (sketch[k + 1 :] == sketch[k]).sum(axis=1) >= least
            if near.any():
                hit = (near | near.T) & _comparable(group)
                for i in np.flatnonzero(hit.any(axis=1)).tolist():
                    out.append(tuple(group[c][i] for c in names))
            if len(out) > 5_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return rows.repartition("cell").sortWithinPartitions("cell").select(*names, "sketch").transform(common.in_batches, task, CELLS)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership blocks of the tokens that occur twice."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    kept = count[place] > 1
    owner, column = owner[kept], number[place[kept]]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(sets), step), dtype=np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        total += x @ x.T
    return total


def verified(found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """set_id, root (smallest class of its part of the cell), n (links that the cell owns)."""
    names = [c.split()[0] for c in CELLS.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in _groups(batches, "cell"):
            ids, tokens = group["set_id"], [np.frombuffer(t, dtype="<u8") for t in group["tokens"]]
            size = np.array([len(t) for t in tokens], dtype=np.float32)
            if len(ids) == 2:
                both = len(np.intersect1d(tokens[0], tokens[1], assume_unique=True))
                shared = np.array([[size[0], both], [both, size[1]]], dtype=np.float32)
            else:
                shared = common_counts(tokens)
            linked = shared * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-3
            linked &= _comparable(group)
            root = _roots(linked)
            degree = linked.sum(axis=1)
            for i in np.flatnonzero(degree):
                out.append((ids[i], ids[root[i]], degree[i]))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["set_id", "root", "n"])
                out = []
        yield pd.DataFrame(out, columns=["set_id", "root", "n"])

    rows = found.join(sets, "set_id").repartition("cell").sortWithinPartitions("cell")
    return rows.select(*names, "tokens").transform(common.in_batches, task, "set_id long, root long, n long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component), from edges a, b, by alternating large and small stars; kept."""
    edges = common.cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = common.cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = common.cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = common.cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    least = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return common.cut(nodes.join(least, "node", "left").select("node", F.coalesce("label", "node").alias("label")))


def classes_of(every: DataFrame, threshold: float, recall: float) -> DataFrame:
    """set_id, rep (smallest doc_id), size, roots (tokens at the places of all first levels), sketch (the low byte of each token); kept."""
    places = [place for run in range(runs_for(LEVELS, threshold, recall)) for place in _places(run, threshold)]
    pick = lambda at, n: F.substring("sig", at, n)
    roots, sketch = F.concat(*[pick(4 * p + 1, 4) for p in places]), F.concat(*[pick(4 * k + 1, 1) for k in range(TOKENS)])
    rows = every.where("set_id IS NOT NULL").select("set_id", "doc_id", "size", roots.alias("roots"), sketch.alias("sketch"))
    return common.stored(rows.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size"), F.max("roots").alias("roots"), F.max("sketch").alias("sketch")))


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its connected group), set_id (smallest doc_id of equal sets), n_links (other sets linked to its set)."""
    every = common.stored(signatures(docs, words))
    classes = classes_of(every, threshold, recall)
    found = common.stored(members(cells(buckets(classes, threshold, recall), classes), threshold))
    wanted = found.select("set_id").distinct().join(classes.select("set_id", "rep"), "set_id").select(F.col("rep").alias("doc_id")).distinct()
    # rows may share a doc_id: only sets that are wanted are joined, each once
    sets = token_sets(docs.join(common.sized(common.cut(wanted)), "doc_id", "left_semi"), words).dropDuplicates(["set_id"])
    links = common.stored(verified(found, sets, threshold))
    group = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("set_id").agg(F.sum("n").alias("n_links"))
    named = classes.select("set_id", "rep").join(group.withColumnRenamed("node", "set_id"), "set_id", "left").join(counted, "set_id", "left")
    named = named.withColumn("label", F.coalesce("label", "set_id"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = common.cut(named.join(smallest, "label").select("set_id", "rep", "class_id", "n_links"))
    joined = every.select("doc_id", "set_id").join(named, "set_id", "left")
    return joined.select("doc_id", *[F.coalesce(c, "doc_id").alias(a) for c, a in (("class_id", "class_id"), ("rep", "set_id"))], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
