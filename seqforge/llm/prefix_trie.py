"""Prefix trie of conversations as preorder intervals.

A turn is a digest of its role and text; a node, a distinct sequence of first turns, is a
128-bit hash: the exclusive or of hashes of (place, digest), so that a node's parent follows
from its own last turn. Conversations are ranked in lexicographic order of their digests:
pieces of 64 digests are ranked, then pieces of 64 ranks, until one key is left for each, so
that no row grows with a conversation. The members of a node are consecutive ranks; nodes in
order of (smallest member's rank, depth) are in preorder, and the last node of a subtree is
the one where its last member ends. Leaves and savings of a subtree are differences of
prefix sums at both ends of its interval. Texts are read once and never shuffled.

Defined results: turns that share their number are ordered by role and digest; rows without
conv_id belong to no conversation and are left out; repeated rows are turns of their own; an
empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Items of a piece that are ranked at once; rows of a block of a prefix sum or of a list of ids.
PIECE, BLOCK = 64, 4096
WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """Kept turns (conv_id, place, digest, words) of conversations (conv_id, turn, role, text); places are from 0."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return common.cut(common.ranked(common.cut(own), ["conv_id"], ["turn", "role", "digest"]).select("conv_id", "place", "digest", "words"))


def rebuilt(own: DataFrame, heads: Column, lead: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Kept (turns, conversations) where conversation c starts with the first ``heads`` turns of the conversation ``lead`` instead of its own.

    ``heads`` (0 to ``most``) and ``lead`` are expressions over conv_id. All conversations stay, those without a turn as well.
    """
    sizes = common.cut(own.groupBy("conv_id").agg(F.count("*").alias("n")))
    convs = sizes.select("conv_id", heads.cast("long").alias("heads"), lead.alias("lead"))
    led = sizes.select(F.col("conv_id").alias("lead"), F.col("n").alias("lead_n"))
    convs = common.cut(convs.join(led, "lead", "left").withColumn("given", F.least("heads", F.coalesce("lead_n", F.lit(0)))))
    first = own.where(F.col("place") < most).withColumnRenamed("conv_id", "lead")
    given = convs.where("given > 0").select("conv_id", "lead", "given").join(first, "lead").where("place < given").select("conv_id", "place", "digest", "words")
    rest = own.join(convs.select("conv_id", "heads", "given"), "conv_id").where("place >= heads")
    rest = rest.select("conv_id", (F.col("place") - F.col("heads") + F.col("given")).alias("place"), "digest", "words")
    return common.cut(given.unionByName(rest)), convs.select("conv_id")


def _pieces(items: DataFrame, keys: list[str]) -> DataFrame:
    """One binary key for the at most PIECE items (place, item) of each group."""
    listed = F.sort_array(F.collect_list(F.struct("place", "item")))
    return items.groupBy(*keys).agg(F.aggregate(listed, F.lit(b""), lambda a, x: F.concat(a, x["item"])).alias("key"))


def ranks(turns_: DataFrame, convs: DataFrame, most: int) -> DataFrame:
    """conv_id, rank of all conversations in lexicographic order of their turns (places up to ``most``), equal ones by conv_id."""
    items = turns_.select("conv_id", "place", F.col("digest").alias("item"))
    while most >= PIECE:
        pieces = common.cut(_pieces(items.withColumn("piece", F.expr(f"place div {PIECE}")), ["conv_id", "piece"]))
        known = common.ranked(common.cut(pieces.select("key").distinct()), [], ["key"], "rank")
        item = F.unhex(F.lpad(F.hex("rank"), 16, "0"))
        items = common.cut(pieces.join(common.cut(known), "key").select("conv_id", F.col("piece").alias("place"), item.alias("item")))
        most //= PIECE
    keyed = convs.join(_pieces(items, ["conv_id"]), "conv_id", "left").withColumn("key", F.coalesce("key", F.lit(b"")))
    return common.cut(common.ranked(common.cut(keyed), [], ["key", "conv_id"], "rank").select("conv_id", "rank"))


def _prefixes(turns_: DataFrame, most: int) -> DataFrame:
    """Turns with the node of the sequence up to them (a, b) and its parent (pa, pb)."""
    tags = {"ta": F.xxhash64("place", "digest"), "tb": F.xxhash64(F.lit(1), "place", "digest")}
    rows = turns_.withColumns(tags).withColumn("block", F.expr(f"place div {BLOCK}"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.bit_xor("ta").over(so_far), "b": F.bit_xor("tb").over(so_far)})
    if most >= BLOCK:
        whole = rows.groupBy("conv_id", "block").agg(F.bit_xor("ta").alias("wa"), F.bit_xor("tb").alias("wb"))
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        bases = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(w).over(before), F.lit(0)).alias(w) for w in ("wa", "wb")])
        rows = rows.join(bases, ["conv_id", "block"]).withColumns({k: F.col(k).bitwiseXOR(F.col(w)) for k, w in (("a", "wa"), ("b", "wb"))})
    parents = {"pa": F.col("a").bitwiseXOR(F.col("ta")), "pb": F.col("b").bitwiseXOR(F.col("tb"))}
    return common.cut(rows.withColumns(parents).select("conv_id", (F.col("place") + 1).alias("depth"), "words", "a", "b", "pa", "pb"))


def _running(nodes: DataFrame) -> DataFrame:
    """Nodes by their preorder place, with running sums of leaves and of savings."""
    nodes = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    sums = nodes.groupBy("block").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("savings"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = common.cut(sums.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("leaves", "savings")]))
    within = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = nodes.withColumns({"leaf_sum": F.sum("leaf").over(within), "saved_sum": F.sum("saved").over(within)}).join(common.sized(bases), "block")
    return common.cut(summed.withColumns({"leaf_sum": F.col("leaf_sum") + F.col("leaves"), "saved_sum": F.col("saved_sum") + F.col("savings")}).drop("block", "leaves", "savings"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: the digest of the ids of the conversations that end at a node.

    They have consecutive ranks in order of their ids, so ids are joined to texts of at most BLOCK in
    parallel; a node's texts then stream through one hash, which is sequential by its definition.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy("a", "b", F.expr(f"rank div {BLOCK}").alias("part")).agg(ids.alias("ids"))
    dealt = texts.repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b").sortWithinPartitions("a", "b", "part")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            rows = []
            for a, b, ids in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ids"], strict=True):
                if node == (a, b):
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(rows, columns=["a", "b", "ends_sha256"]).astype({"a": "int64", "b": "int64"})
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=["a", "b", "ends_sha256"])

    return common.in_batches(dealt.select("a", "b", "ids"), digests, "a long, b long, ends_sha256 string")


def trie(turns_: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of kept turns (conv_id, place, digest, words) of kept conversations.

    pos and end (the preorder interval), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    most = turns_.agg(F.max("place")).first()[0] or 0
    prefixes = _prefixes(turns_, most)
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("whole"))
    known = ranks(turns_, convs, most).join(last, "conv_id", "left")
    known = common.cut(known.select("conv_id", "rank", *[F.coalesce(F.col(f"whole.{k}"), F.lit(0)).alias(f"end_{k}") for k in "ab"]))
    members = F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("rank").alias("first"), F.max(F.struct("rank", "end_a", "end_b")).alias("last")
    zero = F.lit(0).cast("long")
    root = known.agg(*members).where("n_convs > 0").withColumns({k: zero for k in ("depth", "words", "a", "b")}).withColumns({k: F.lit(None).cast("long") for k in ("pa", "pb")})
    same = [F.min(c).alias(c) for c in ("depth", "words", "pa", "pb")]
    nodes = prefixes.join(known, "conv_id").groupBy("a", "b").agg(*members, *same).unionByName(root)
    nodes = nodes.select("a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "first", "last.end_a", "last.end_b", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    # a node has no child if its last member ends there
    nodes = common.cut(nodes.withColumn("leaf", ((F.col("a") == F.col("end_a")) & (F.col("b") == F.col("end_b"))).cast("long")))
    nodes = _running(common.ranked(nodes, [], ["first", "depth"], "pos"))
    ends = nodes.select(F.col("a").alias("end_a"), F.col("b").alias("end_b"), F.col("pos").alias("end"), F.col("leaf_sum").alias("to_leaf"), F.col("saved_sum").alias("to_saved"))
    spans = common.cut(nodes.join(ends, ["end_a", "end_b"]))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    spans = common.cut(spans.join(parents, ["pa", "pb"], "left"))
    children = nodes.where("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    digests = _end_digests(known.select("conv_id", "rank", F.col("end_a").alias("a"), F.col("end_b").alias("b")))
    done = spans.join(children, ["a", "b"], "left").join(digests, ["a", "b"], "left")
    return done.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        (F.col("to_leaf") - F.col("leaf_sum") + F.col("leaf")).alias("n_leaves"),
        (F.col("to_saved") - F.col("saved_sum") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "pos",
        "end",
    )
