"""Binary id shards and their index: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqforge.llm import queries, token_files

DOCS = "doc_id long, text string, lang string, copy long, shard string"


def hashes(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def ids_of(text):
    return Tokenizer.from_file(queries.WORDS).encode(text or "", add_special_tokens=False).ids + [1]


def written(spark, rows, path):
    docs = spark.createDataFrame([(*r, "en", 9, "x") for r in rows], DOCS)
    token_files.write(docs, path, queries.WORDS)
    return token_files.keys(spark, path)


def back(spark, path, wanted):
    found = token_files.read(spark, path, token_files.lookup(spark, path, wanted))
    return [(r.doc_id, r.copy, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in found.collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 20000])
def test_perfect_hash_is_minimal_and_survives_its_bytes(n):
    keys, prints = hashes(n)
    perfect = token_files.PerfectHash.of(keys, prints)
    again, end = token_files.PerfectHash.from_bytes(b"xy" + perfect.to_bytes(), 2)
    for p in (perfect, again):
        assert sorted(p.slots(keys, prints).tolist()) == list(range(n))
    assert end == 2 + len(perfect.to_bytes())
    assert n < 64 or 64 * sum(len(w) for w, _ in perfect.levels) < 5 * n + 64 * len(perfect.levels)  # bits


def test_equal_hashes_are_an_error():
    with pytest.raises(ValueError, match="same hashes"):
        token_files.PerfectHash.of(np.array([5, 5], np.uint64), np.array([6, 6], np.uint64))


def test_index_knows_its_keys_and_rejects_others():
    keys, prints = hashes(5000)
    at = np.arange(5000) * 3
    data = token_files.index_bytes(keys, prints, at % 7, at, at + 1)
    found, own = token_files.index_find(data, keys, prints)
    assert own.all() and (found["at"] == at).all() and (found["shard"] == at % 7).all() and (found["count"] == at + 1).all()
    assert not token_files.index_find(data, *hashes(5000, 1))[1].any()
    assert not token_files.index_find(token_files.index_bytes(*[np.array([], np.uint64)] * 2, *[np.array([], np.int64)] * 3), keys[:3], prints[:3])[1].any()
    with pytest.raises(ValueError, match="index part"):
        token_files.index_find(b"x" * 100, keys, prints)


def test_round_trip_of_odd_documents(spark, tmp_path):
    """Null, empty and very long texts, marks inside payloads, a doc_id that a third of the rows share, null doc_ids."""
    rng = random.Random(1)
    texts = [None, "", " ", "Ünï©ode 漢字 <|endoftext|> it's", '" " "', "lorem ipsum " * 9000]
    rows = [(i, rng.choice(texts[:5])) for i in rng.sample(range(-40, 400), 90)] + [(3, f"copy {i % 4}") for i in range(60)] + [(None, "a"), (None, "b"), (1000, texts[5])]
    keys = written(spark, rows, f"{tmp_path}/ids")
    got = sorted(back(spark, f"{tmp_path}/ids", keys), key=lambda r: r[2])
    at, order = 0, [(-(1 << 62) if d is None else d) for d, _, _, _ in got]
    assert order == sorted(order) and len(got) == len(rows)
    for _, _, start, ids in got:
        assert start == at
        at += len(ids)
    want, have = defaultdict(list), defaultdict(list)
    for d, t in rows:
        want[d].append(ids_of(t))
    for d, copy, _, ids in got:
        have[d].append(ids)
    assert {d: sorted(v) for d, v in want.items()} == {d: sorted(v) for d, v in have.items()}
    copies = [c for d, c, _, _ in got if d == 3]
    assert sorted(copies) == list(range(len(want[3]))) and copies == sorted(copies)
    assert len({r.shard for r in token_files.lookup(spark, f"{tmp_path}/ids", keys.where("doc_id = 3")).collect()}) > 1  # a hot doc_id is spread


def test_lookup_of_single_and_absent_keys(spark, tmp_path):
    written(spark, [(i, f"text {i}") for i in range(50)], f"{tmp_path}/ids")
    wanted = spark.createDataFrame([(7, 0), (7, 1), (99, 0), (None, 0), (49, 0)], "doc_id long, copy long")
    got = back(spark, f"{tmp_path}/ids", wanted)
    assert sorted((d, c, ids) for d, c, _, ids in got) == [(7, 0, ids_of("text 7")), (49, 0, ids_of("text 49"))]


def test_empty_table(spark, tmp_path):
    assert back(spark, f"{tmp_path}/ids", written(spark, [], f"{tmp_path}/ids")) == []


def test_files_are_raw_ids(spark, tmp_path):
    written(spark, [(2, "b"), (1, "a")], f"{tmp_path}/ids")
    data = b"".join(p.read_bytes()[16:] for p in sorted((tmp_path / "ids" / "ids").iterdir()))
    assert np.frombuffer(data, "<u2").tolist() == ids_of("a") + ids_of("b")


def test_query_equals_the_tokenizer(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op11_token_files(spark, sf).collect()}
    at, want = 0, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(ids_of(r.text), "<u4")
        want[r.doc_id], at = (at, len(ids), zlib.crc32(ids.tobytes())), at + len(ids)
    assert got == want
