"""Merkle manifest of a dataset: a binary hash tree per group, and one over the groups' roots.

A row's leaf is the hash of its fields. Leaves of a group, in order of their key, are cut into
aligned blocks of 4096. A first pass reduces each block to its root; blocks of roots are
reduced the same way until a group has one node left, and the groups' roots are the leaves
of one more tree. A second pass walks each block by fractal traversal: the block's tree is
cut into strata of four levels, of which only the subtree above the current leaf (existing)
and the next one, grown by one leaf a step (desired), are held. It gives each leaf's
authentication path inside the block; what stands above is the same for all leaves of the
block and is appended from the pass over the blocks' roots. Only digests are shuffled.

A node without a sibling is hashed alone, as long as its level has several nodes. A path's
elements are ``<`` and the digest of a left sibling, ``>`` and that of a right one, or ``-``.

Defined results: null fields hash as ``-``; null groups come first and form a group; null keys
come first in their group; equal keys follow their leaves' order; repeated rows are leaves of
their own; a group of one leaf has that leaf as its root, a table of one group that group's;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Levels of a block and of a stratum.
BLOCK, STRATUM = 12, 4
NODE = "g string, place long, n long, digest string"
PROOF = "g string, place long, path array<string>, top string"


def digest_of(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def fold(digest: str, path: list[str]) -> str:
    """The root that a digest and its authentication path lead to."""
    for step in path:
        digest = digest_of(step[1:], digest) if step[0] == "<" else digest_of(digest, step[1:])
    return digest


def framed(value: Column) -> Column:
    """A field's text behind its length in bytes, or ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, fields)), 256)


class Subtree:
    """The levels from ``low`` to below ``high`` under one node of level ``high``, grown leaf by leaf."""

    def __init__(self, leaves: list[str], low: int, high: int, index: int):
        self.leaves, self.low, self.high, self.index = leaves, low, high, index
        self.next, self.end = index << high, min((index + 1) << high, len(leaves))
        self.rows: list[list[str]] = [[] for _ in range(low, high)]
        self.waiting: list[tuple[int, str]] = []  # left nodes without their sibling, highest first
        self.root = ""

    def _add(self, level: int, digest: str) -> None:
        while level < self.high:
            if level >= self.low:
                self.rows[level - self.low].append(digest)
            if not self.waiting or self.waiting[-1][0] != level:
                self.waiting.append((level, digest))
                return
            digest = digest_of(self.waiting.pop()[1], digest)
            level += 1
        self.root = digest

    def step(self) -> None:
        """Takes one more leaf; after the last, nodes without a sibling are hashed alone."""
        if self.next < self.end:
            self._add(0, self.leaves[self.next])
            self.next += 1
            while self.next == self.end and self.waiting:
                level, digest = self.waiting.pop()
                self._raise(level, digest)

    def _raise(self, level: int, digest: str) -> None:
        self._add(level + 1, digest_of(digest))

    def grown(self) -> Subtree:
        while self.next < self.end:
            self.step()
        return self

    def node(self, level: int, index: int) -> str:
        return self.rows[level - self.low][index - (self.index << (self.high - level))]


def block_root(leaves: list[str], height: int) -> str:
    return Subtree(leaves, height, height, 0).grown().root


def traverse(leaves: list[str], height: int, stratum: int = STRATUM) -> Iterator[list[str]]:
    """The authentication paths of a block's leaves, one after another."""
    n = len(leaves)
    bounds = [(low, min(low + stratum, height)) for low in range(0, height, stratum)]
    existing = [Subtree(leaves, low, high, 0).grown() for low, high in bounds]
    desired = [Subtree(leaves, low, high, 1) for low, high in bounds]
    widths = [-(-n >> level) for level in range(height)]
    for place in range(n):
        path = []
        for level in range(height):
            sibling = (place >> level) ^ 1
            if sibling >= widths[level]:
                path.append("-")
            else:
                path.append("<>"[sibling & 1] + existing[level // stratum].node(level, sibling))
        yield path
        for k, (low, high) in enumerate(bounds):
            desired[k].step()
            if not (place + 1) & ((1 << high) - 1):
                existing[k], desired[k] = desired[k], Subtree(leaves, low, high, desired[k].index + 1)


def _height(n: int, block: int) -> int:
    """Levels below a block's root in a tree of n leaves."""
    return min(block, (n - 1).bit_length())


def _blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", block))


def _roots(nodes: DataFrame, block: int) -> DataFrame:
    """The roots of blocks as nodes of their own tree."""

    def reduced(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        leaves, n = group.sort_values("place")["digest"].tolist(), int(group["n"].iloc[0])
        return pd.DataFrame([(key[0], key[1], -(-n >> block), block_root(leaves, _height(n, block)))], columns=["g", "place", "n", "digest"])

    return common.cut(_blocks(nodes, block).groupBy("g", "block").applyInPandas(reduced, NODE))


def _walk(nodes: DataFrame, uppers: DataFrame, block: int) -> DataFrame:
    """Path and top of every node: its block's traversal, then what stands above the block."""

    def walked(key: tuple, group: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        above, top = list(upper["path"].iloc[0]), upper["top"].iloc[0]
        paths = [p + above for p in traverse(group["digest"].tolist(), _height(int(group["n"].iloc[0]), block))]
        return pd.DataFrame({"g": key[0], "place": group["place"].to_numpy(), "path": paths, "top": top})

    upper = uppers.withColumnRenamed("place", "block").groupBy("g", "block")
    return _blocks(nodes, block).groupBy("g", "block").cogroup(upper).applyInPandas(walked, PROOF)


def _above(nodes: DataFrame, block: int) -> DataFrame:
    """Path and top of the root of every block."""
    roots = _roots(nodes, block)
    if (roots.agg(F.max("n")).first()[0] or 1) == 1:
        return roots.select("g", "place", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    return common.cut(_walk(roots, _above(roots, block), block))


def manifest(leaves: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(placed leaves, proofs of blocks) of a kept table of leaves (g, key, leaf, ...).

    Placed leaves have place and n (leaves of the group) added; proofs of blocks: g, block, path from the block's
    root to the dataset's, subroot, root.
    """
    placed = common.ranked(leaves, ["g"], ["key", "leaf"])
    sizes = common.cut(placed.groupBy("g").agg(F.count("*").alias("n")))
    placed = common.cut(placed.join(common.sized(sizes), "g"))
    within = _above(placed.select("g", "place", "n", F.col("leaf").alias("digest")), block)
    groups = common.cut(within.where("place = 0").select("g", F.col("top").alias("digest")))
    tops = common.ranked(groups, [], ["g"]).withColumn("n", F.lit(groups.count()).cast("long"))
    nodes = common.cut(tops.select(F.lit("").alias("g"), "place", "n", "digest", F.col("g").alias("name")))
    proofs = _walk(nodes.select("g", "place", "n", "digest"), _above(nodes.drop("name"), block), block)
    proofs = proofs.join(nodes.select("place", "name"), "place").select(F.col("name").alias("g"), F.col("path").alias("upper"), F.col("top").alias("root"))
    joined = within.join(common.sized(common.cut(proofs)), "g")
    return placed, common.cut(joined.select("g", F.col("place").alias("block"), F.concat("path", "upper").alias("path"), F.col("top").alias("subroot"), "root"))


def proofs(placed: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, leaf, claim, path, folded_root, subroot, root of every placed leaf; ``claim`` is the leaf of the row as it is found now."""
    schema = "key long, leaf string, claim string, path array<string>, folded_root string, subroot string, root string"

    def proved(group: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        above, leaves = list(upper["path"].iloc[0]), group["leaf"].tolist()
        paths = [p + above for p in traverse(leaves, _height(int(group["n"].iloc[0]), block))]
        folded = [fold(c, p) for c, p in zip(group["claim"], paths, strict=True)]
        out = pd.DataFrame({"key": group["key"].astype("Int64").to_numpy(), "leaf": leaves, "claim": group["claim"].to_numpy(), "path": paths, "folded_root": folded})
        return out.assign(subroot=upper["subroot"].iloc[0], root=upper["root"].iloc[0])

    own = _blocks(placed.select("g", "place", "n", "key", "leaf", "claim"), block)
    return own.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInPandas(proved, schema)


def siblings(path: Column) -> Column:
    """The siblings' digests of a path, one after another."""
    return F.regexp_replace(F.array_join(path, ""), "[<>-]", "")


def dataset_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Kept leaves of documents, grouped by lang; where ``tampered``, the claim has one more in n_chars."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = F.expr("try_add(cast(n_chars AS bigint), 1L)")
    claim = leaf([more if f == "n_chars" else F.col(f) for f in fields])
    own = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("g"),  # which sorts before "="
        F.col("doc_id").cast("long").alias("key"),
        leaf([F.col(f) for f in fields]).alias("leaf"),
        F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), claim).alias("other"),
    )
    return common.cut(own.select("g", "key", "leaf", F.coalesce("other", "leaf").alias("claim")))
