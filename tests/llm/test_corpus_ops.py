"""Operators over all documents, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqforge.llm import common, decontaminate, jaccard, line_dedup, packing, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, a string"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "a") for i, t in zip(ids, texts, strict=True)], DOCS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(n):
    return min(line_dedup.MAX_EDITS, n // line_dedup.CHARS_PER_EDIT)


def plain_dedup(rows):
    """Brute force over (doc_id, text)."""
    first = {}
    for d, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            if d is not None and len(line) >= line_dedup.MIN_CHARS:
                old = first.get(line, (d, pos))
                first[line] = (min(old[0], d), min(old[1], pos))
    lines = sorted(first, key=lambda x: first[x])
    later = set()
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            limit = allowed(min(len(a), len(b)))
            if first[a] < first[b] and b not in later and abs(len(a) - len(b)) <= limit and distance(a, b) <= limit:
                later.add(b)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        seen, kept = set(), []
        for line in t.split("\n"):
            if len(line) >= line_dedup.MIN_CHARS and (line in seen or (d is not None and (line in later or d > first[line][0]))):
                continue
            seen.add(line)
            kept.append(line)
        out.append((d, "\n".join(kept)))
    return out


def noisy_lines(rng, n):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    bases = [" ".join(word() for _ in range(rng.randrange(4, 40))) for _ in range(n)]
    lines = []
    for b in bases:
        lines.append(b)
        for _ in range(rng.randrange(4)):
            t = list(b)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(t))
                kind = rng.randrange(3)
                t[k : k + (kind != 0)] = [rng.choice("xyzé")] if kind < 2 else []
            lines.append("".join(t))
    return lines


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(7)
    lines = noisy_lines(rng, 60)
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    rows = [*zip(rng.sample(range(1000), 60), texts, strict=True), (1000, None), (1001, ""), (1002, "\n\n"), (None, texts[0] + "\n" + texts[0]), (1003, "short\nshort\nshort")]
    got = line_dedup.dedup_lines(docs(spark, [t for _, t in rows], [d for d, _ in rows]).repartition(3)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, plain_dedup(rows)))
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    assert got[0].asDict().keys() >= {"lang", "key", "a", "n_lines", "n_dropped"}


def test_line_keys_are_own_columns_of_whole_characters(spark):
    """Keys of a line with characters of one to four bytes: equal where the plain segments are. No lambda runs over the places."""
    lines = [("aé𝄞z" * 30)[:n] for n in (39, 40, 41, 79, 80, 81, 82, 83)] + ["b" + ("aé𝄞z" * 30)[1:80], ("aé𝄞z" * 30)[:79] + "b"]
    wide = spark.createDataFrame([(x,) for x in lines], "line string").withColumns({"len": F.length("line"), "wide": F.encode("line", "UTF-32")})
    seen = {}
    for row in wide.select("line", *[k.alias(n) for n, k in line_dedup._keys().items()]).collect():
        for i, (edits, less, segment, shift, _) in enumerate(line_dedup._places()):
            n = len(row.line) - less
            start, end = n * segment // (edits + 1) + shift, n * (segment + 1) // (edits + 1) + shift
            plain = (n, segment, row.line[start:end]) if allowed(n) == edits else None
            assert (row[f"k{i}"] is None) == (plain is None)
            assert seen.setdefault(row[f"k{i}"], plain) == plain
    assert len(set(seen.values())) == len(seen) == 40


def test_line_dedup_of_very_long_texts(spark):
    line = "x" * 40000 + "some words here"
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, [line, line.replace("words", "wordz"), "y" * 39000 + line])).collect()}
    assert got[0] == line and got[1] == "" and len(got[2]) == 79015


def test_short_repeated_lines_go(spark):
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, ["Share this\n\na first line", "Share this\n\nx\nx", "Share thus\nx"])).collect()}
    assert got == {0: ("Share this\n\na first line", 0), 1: ("\nx", 2), 2: ("Share thus", 1)}


def test_every_near_pair_is_a_candidate(spark):
    rng = random.Random(9)
    lines = sorted({x for x in noisy_lines(rng, 80) if len(x) >= line_dedup.MIN_CHARS})
    df = docs(spark, lines)
    ids = {r.id: r.line for r in line_dedup._lines(df).collect()}
    got = {frozenset((ids[r.a], ids[r.b])) for r in line_dedup.near_pairs(df, line_dedup.distinct_lines(df)).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= allowed(min(len(a), len(b)))}
    assert got == want and len(want) > 20


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(texts):
    sets = [shingles(t) for t in texts]
    links = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    group = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            low = min([group[i], *(group[j] for j in js)])
            changed |= low != group[i]
            group[i] = low
    n_links = [len({frozenset(sets[j]) for j in js if sets[j] != sets[i]}) for i, js in enumerate(links)]
    return group, n_links


def near_copies(rng, n_base, most):
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 300))]
        for _ in range(rng.randrange(1, most)):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [256, 12])
def test_join_matches_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(small)
    texts = [*near_copies(rng, 25, 12), *near_copies(rng, 1, 60)[:40], None, "", "one two", "one two", "ONE two", "a b c d e", " "]
    got = {r.doc_id: r for r in jaccard.join_similar(docs(spark, texts).repartition(3)).collect()}
    group, n_links = plain_groups(texts)
    linked = [i for i in range(len(texts)) if n_links[i]]
    found = sum(got[i].n_links for i in linked)
    assert all(got[i].n_links <= n_links[i] for i in range(len(texts))) and found >= 0.98 * sum(n_links)
    assert sum(got[i].class_id == group[i] for i in range(len(texts))) >= 0.98 * len(texts)
    assert [got[i].class_id for i in range(len(texts) - 7, len(texts))] == [len(texts) - k for k in (7, 6, 5, 5, 5, 2, 1)]


def test_join_of_odd_tables(spark):
    assert jaccard.join_similar(docs(spark, [])).count() == 0
    rows = jaccard.join_similar(docs(spark, ["a b c d e f", "a b c d e f", "z"], [None, 3, 3])).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in rows) == [("3", "3"), ("3", "3"), ("None", "None")]


def test_join_keeps_texts_of_odd_blanks(spark):
    texts = ["\u00a0", "\x1c", "a b c d e f", "", "\u3000", None, " \t\n", "a\u00a0b c d e f"]
    got = {r.doc_id: r for r in jaccard.join_similar(docs(spark, texts)).collect()}
    assert {i: r.class_id for i, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 2}
    assert all(r.n_links == 0 for r in got.values())


def test_sparse_buckets_are_split_further(spark, monkeypatch):
    """Texts that share a passage but are not similar, and some near copies among them."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [f"{passage} {own()}" for _ in range(150)]
    texts += [t + f" tail{i}" for i, t in enumerate(texts[:20])]
    classes = jaccard.classes_of(common.stored(jaccard.signatures(docs(spark, texts))), 0.8, 0.995)
    levels = []
    run = jaccard._run
    monkeypatch.setattr(jaccard, "_run", lambda *a: levels.append(run(*a)) or levels[-1])
    found = jaccard.buckets(classes).collect()
    assert max(x[2] for x in levels) > 1 and len(levels) > 1 and any(r.dense is None for r in found)
    got = {r.doc_id: r for r in jaccard.join_similar(docs(spark, texts)).collect()}
    group, n_links = plain_groups(texts)
    assert [got[i].class_id for i in range(170)] == group and [got[i].n_links for i in range(170)] == n_links


def test_large_group_is_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 16)
    monkeypatch.setattr(jaccard, "LEVELS", 2)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 400, 5)]
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 9)
    got = jaccard.join_similar(docs(spark, texts)).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {len(texts) - 1}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_pipeline_stages_match_plain_versions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n // 12 + 1))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [prose(rng.randrange(30, 200)) for _ in range(40)]
    copy = clean[3].split("\n")
    copy[0] = copy[0].replace(copy[0].split()[4], "zzzz", 1)
    texts = [*clean, clean[0], "\n".join(copy), clean[1] + "\n" + bench[2][1], "too short", "spam ham eggs and ham " * 60, None]
    frame = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")

    kept = corpus_pipeline.quality_rules(spark, frame, SF)
    assert kept.columns == frame.columns
    judged = quality.holdout_signals(frame)
    want = {r.doc_id for r in judged.collect() if not r.base_failed}
    assert {r.doc_id for r in kept.collect()} == want and set(range(43)) == want

    kept = common.stored(kept)
    lines = corpus_pipeline.line_dedup_stage(spark, kept, SF)
    plain = {d: t for d, t in plain_dedup([(r.doc_id, r.text) for r in kept.collect()])}
    assert {r.doc_id: r.text for r in lines.collect()} == {d: t for d, t in plain.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = corpus_pipeline.near_duplicates(spark, kept, SF)
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    group, _ = plain_groups([t for _, t in rows])
    assert {r.doc_id for r in near.collect()} == {rows[g][0] for g in group}

    left = corpus_pipeline.decontamination(spark, frame, SF)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {42}
    pieces = corpus_pipeline.packed(spark, frame, SF).toPandas()
    assert set(pieces["doc_id"]) == set(range(len(texts))) and (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup_stage", "near_duplicates", "decontamination", "packed"]


def test_stages_with_clashing_and_null_columns(spark):
    from pyspark.sql import functions as F

    line = "a line of more than thirty characters to keep once only"
    frame = docs(spark, [line + " and some more words here", line + "\n" + line, None, ""], [1, 2, 3, None])
    names = "id line pos len sig keys drops n_dropped stratum kept rep set_id path cluster word n text_hash quality item_id _row _id".split()
    frame = frame.withColumns({c: F.lit(None).cast("string") if c < "n" else F.lit(7) for c in names})
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.line_dedup_stage, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        for table in (frame, frame.limit(0)):
            out = stage(spark, table, SF)
            assert out.columns == frame.columns
            assert all(r.stratum == 7 and r.n_dropped == 7 for r in out.collect())
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, frame, SF).collect()}[2] == line
    assert {r.doc_id for r in corpus_pipeline.packed(spark, frame, SF).collect()} == {1, 2, 3, None}


def test_line_dedup_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    frame = docs(spark, ["one line here\none line here", "other"]).withColumns({c: F.lit(7) for c in ("__lines", "__drops", "__placed", "__kept", "row", "lines", "kept", "drops", "__n_dropped")})
    out = line_dedup.dedup_lines(frame)
    assert set(out.columns) == {*frame.columns, "n_lines", "n_dropped"}
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[0][c] == 7 for c in ("__lines", "__drops", "__placed", "__kept", "row", "lines", "kept", "drops", "__n_dropped")) and got[0].n_dropped == 1


@pytest.mark.parametrize("limit", [0, 1000])
def test_rows_are_dropped_without_a_shuffle_of_them(spark, tmp_path, limit):
    from pyspark.sql import functions as F

    frame = docs(spark, [f"text {i % 40}" for i in range(200)]).withColumn("folder", F.lit("mine")).repartition(5)
    frame.write.parquet(str(tmp_path / "docs"))
    gone = common.cut(spark.range(0, 200, 7).select(F.xxhash64("id").alias("h")))
    for table in (spark.read.parquet(str(tmp_path / "docs")), frame):
        out = common.without(table, F.xxhash64("doc_id"), gone, max_rows=limit)
        assert out.columns == frame.columns
        assert sorted(r.doc_id for r in out.collect()) == [i for i in range(200) if i % 7] and {r.folder for r in out.collect()} == {"mine"}
        assert limit or "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert common.without(table.limit(0), F.xxhash64("doc_id"), gone, max_rows=limit).collect() == []
