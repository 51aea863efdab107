"""Merkle manifest and conversation trie, against plain Python versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqforge.llm import common, merkle, prefix_trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, place long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest


def plain_leaf(*fields):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def plain_path(levels, place):
    """(sibling or none, whether it stands left) by level."""
    path = []
    for level in levels[:-1]:
        twin = place ^ 1
        path.append((level[twin] if twin < len(level) else None, place & 1))
        place >>= 1
    return path


def plain_fold(digest, path):
    for twin, left in path:
        digest = h(digest) if twin is None else h(twin, digest) if left else h(digest, twin)
    return digest


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of each row (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        leaf = plain_leaf(d, source, lang, n, text)
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        groups[b"" if lang is None else b"=" + lang.encode()].append((d is not None, d or 0, leaf, plain_leaf(d, source, lang, n + 1, text) if hit else leaf, d))
    names = sorted(groups)
    trees = {g: plain_levels([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for place, (_, _, leaf, claim, d) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            path = plain_path(trees[g], place) + plain_path(top, k)
            out.append((d, leaf, trees[g][-1][0], top[-1][0], h(*[t for t, _ in path if t]), plain_fold(claim, path)))
    return out


def manifest_rows(spark, rows, block=merkle.BLOCK):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], DOCS)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    placed, blocks = merkle.manifest(merkle.dataset_leaves(docs, fold), block)
    proved = merkle.proofs(placed, blocks, block)
    return [tuple(r) for r in proved.select("key", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), "folded_root").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("block", [2, 3, merkle.BLOCK])
def test_manifest_matches_plain_trees(spark, block):
    """Blocks of 4 and 8 leaves give trees of several levels of blocks."""
    rng = random.Random(block)
    rows = [(i, rng.choice([None, "", "Ünï", "x" * 3000, "a b"]), rng.choice(["en", "en", "en", "de", "日本"]), rng.choice([None, "s"]), rng.choice([None, 0, 7])) for i in rng.sample(range(-50, 400), 150)]
    same(manifest_rows(spark, rows, block), plain_manifest(rows))


def test_manifest_of_odd_tables(spark):
    """Null groups and keys, repeated rows, groups of one leaf, one row, no row."""
    rows = [(None, "t", None, None, None), (5, "t", None, "s", 1), (None, None, "en", "s", 2), *[(5, "t", "en", "s", 1)] * 9, (5, "u", "en", "s", 1), (7, "t", "fr", "s", 9_223_372_036_854_775_806)]
    same(manifest_rows(spark, rows, 2), plain_manifest(rows))
    same(manifest_rows(spark, rows[:1]), plain_manifest(rows[:1]))
    assert manifest_rows(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 100])
@pytest.mark.parametrize("stratum", [1, 2, 4])
def test_traversal_gives_every_path(n, stratum):
    leaves = [h(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    want = [["-" if t is None else "><"[left] + t for t, left in plain_path(levels, i)] for i in range(n)]
    got = list(merkle.traverse(leaves, len(levels) - 1, stratum))
    assert got == want
    assert all(merkle.fold(leaf, p) == levels[-1][0] for leaf, p in zip(leaves, got, strict=True))
    assert merkle.fold(h("other"), got[0]) != levels[-1][0] or n == 1


def test_traversal_holds_few_nodes():
    """Of 4096 leaves' tree, two subtrees of four levels in each of three strata."""
    seen = []

    class Counted(merkle.Subtree):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self)

    old, merkle.Subtree = merkle.Subtree, Counted
    try:
        for _ in merkle.traverse([h(str(i)) for i in range(4096)], 12):
            live = {}
            for s in seen:
                live.setdefault(s.low, []).append(s)
            seen[:] = [s for group in live.values() for s in group[-2:]]
            assert sum(len(r) for s in seen for r in s.rows) <= 6 * 30
            assert all(len(s.waiting) <= 12 for s in seen)
    finally:
        merkle.Subtree = old


def test_ranked_splits_large_groups_and_equal_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 300 + [("b", i) for i in range(50)] + [("c", 0)], "g string, v long").withColumn("v", F.col("v"))
    out = common.ranked(common.cut(rows), ["g"], ["v"])
    places = defaultdict(list)
    for r in out.collect():
        places[r.g].append((r.place, r.v))
    assert sorted(p for p, _ in places["a"]) == list(range(300)) and all(p == v for p, v in places["b"]) and places["c"] == [(0, 0)]


# conversation trie

TURNS = "conv_id long, turn long, role string, text string, place long, rank string"


def plain_trie(rows):
    """Nodes of rebuilt conversations, from rows (conv_id, turn, role, text), by nested dicts and lists."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        n = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:n] + turns[n:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in convs if len(built[c]) == len(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            sum(len(p) == len(path) + 1 for p in below), sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p), h(",".join(map(str, ends))),
        ))
    return out


def trie_rows(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    own = prefix_trie.turns(table)
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    nodes = prefix_trie.trie(*prefix_trie.rebuilt(own, heads, F.col("conv_id") - F.col("conv_id") % 20, 3))
    return nodes, [tuple(r) for r in nodes.drop("pos", "end").collect()]


@pytest.mark.parametrize("piece, block", [(2, 3), (prefix_trie.PIECE, prefix_trie.BLOCK)])
def test_trie_matches_plain_trie(spark, monkeypatch, piece, block):
    """Small pieces and blocks give several rounds of ranks and several blocks of sums."""
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(piece)
    words = ["", "a", "a b", "a  b\x0bc", "Ünï", "x y"]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in range(45) for t in range(rng.choice([1, 2, 3, 7]))]
    rows += [(c, t, "user", "same") for c in (100, 101, 102, 115) for t in range(25)]
    nodes, got = trie_rows(spark, rows)
    same(got, plain_trie(rows))
    spans = sorted((r.pos, r.end, r.depth, r.n_leaves) for r in nodes.collect())
    assert [s[0] for s in spans] == list(range(len(spans)))  # a preorder
    for pos, end, depth, _ in spans:
        assert all(spans[k][2] > depth for k in range(pos + 1, end + 1)) and (end + 1 == len(spans) or spans[end + 1][2] <= depth)


def test_trie_of_odd_tables(spark):
    """Nulls in any column, ties, repeated rows, conversations without turns or without their twentieth, negative ids, no row."""
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, None, "user", "b"), (3, 1, "user", "c"), (3, 1, "user", "c"), (3, 1, "bot", "z " * 3000)]
    rows += [(c, 1, "user", "one") for c in (20, 21, 22, 23, 24, 47, 48, 49, 50)] + [(-7, 0, "user", "x"), (-20, 0, "user", "y"), (-20, 1, "", "y")]
    plain = plain_trie([r for r in rows if r[0] is None or r[0] >= 0])
    same(trie_rows(spark, [r for r in rows if r[0] is None or r[0] >= 0])[1], plain)
    assert any(r[1] == 0 and r[7] != h("") for r in plain)  # a conversation without turns
    assert len(trie_rows(spark, rows)[1]) > len(plain)
    assert trie_rows(spark, [])[1] == []
    same(trie_rows(spark, rows[1:2])[1], plain_trie(rows[1:2]))
