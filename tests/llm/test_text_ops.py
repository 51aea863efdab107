"""Operators on single texts, against plain Python versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqforge.llm import decontaminate, html_text, language, packing, quality, queries, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"
SF = "/root/testdata/sf0.001"
VARIED = [None, "", " ", "Wh.", "\n\n", "one two three four five six seven", "a b c d e " * 3, "Ünï©ode 漢字 <|endoftext|> it's 42  x", "x" * 5000, "lorem ipsum " * 4000]


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or ""), "k", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a null id here", None, None, None, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# quality rules


def plain_signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_signals_match_plain_python(spark):
    texts = [*VARIED, "a b c d e f a b c d e g a b c d e", "l one\nl one\n\n\nl two\nl one", "x #*$ y\x0bz\x1fw"]
    got = {r.doc_id: tuple(r[c] for c in quality.BASE) for r in quality.with_signals(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_signals(t), t
    assert quality.with_signals(empty(spark)).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 100), (1, 7), (20, 3000), (60, 100)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = [r[0] for r in df.select(quality._binomial_tail(df.k, df.n, 0.01)).collect()]
    want = [1.0 if k > n * 0.01 else sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) for k, n in cases]
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_hold_the_risk(spark):
    rng = random.Random(1)
    # clean texts have a few symbols, junk has many: the certified cutoff must separate them and spare clean texts
    clean = [" ".join(rng.choice("abcdefgh") * 4 + str(rng.randrange(10**6)) for _ in range(60)) for _ in range(900)]
    junk = [" ".join("#*$%" + str(rng.randrange(10**6)) for _ in range(60)) for _ in range(50)]
    df = docs(spark, clean + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    signals = quality.holdout_signals(df)
    kept = {r.doc_id: r.kept for r in quality.judge(signals, quality.cutoffs(signals, labels)).collect()}
    assert all(kept[i] for i in range(900)) and not any(kept[i] for i in range(900, 950))
    none = quality.cutoffs(signals, labels.limit(0))
    assert none.count() == 0 and all(r.kept != r.base_failed for r in quality.judge(signals, none).collect())


# packing


def check_pieces(pieces, ids_of, limits):
    for doc_id, p in pieces.groupby("doc_id"):
        ids = ids_of[doc_id]
        at = 0
        for r in p.sort_values("start").itertuples():
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist()
        assert s["length"].sum() <= limits.tokens and len(s) <= limits.segments and s["loss_tokens"].sum() <= limits.loss_tokens


def test_packing_is_an_exact_partition_of_all_ids(spark):
    from tokenizers import Tokenizer

    path = f"{queries.TOKENIZERS}/word_bpe_49k.json"
    tokenizer = Tokenizer.from_file(path)
    texts = [*VARIED, *[r.text for r in table(spark, "documents").collect()]]
    got = packing.pack_documents(docs(spark, texts).where("doc_id IS NOT NULL").repartition(3), path).toPandas()
    ids_of = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert set(got["doc_id"]) == set(ids_of)
    check_pieces(got, ids_of, packing.Limits())
    sizes = got.groupby("sequence_id")["length"].sum()
    padded = sum(4096 - n for n in sizes if n & (n - 1))
    assert padded <= 0.001 * sizes.sum()
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_packing_respects_every_limit(spark):
    limits = packing.Limits(tokens=256, segments=3, loss_tokens=100, pool=16)
    turns = table(spark, "conversations")
    got = packing.pack_turns(turns, f"{queries.TOKENIZERS}/word_bpe_49k.json", limits=limits).toPandas()
    for _, s in got.groupby("sequence_id"):
        assert s["length"].sum() <= 256 and len(s) <= 3 and s["loss_tokens"].sum() <= 100
    assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()


def plain_pack(examples, limits):
    """Brute force: next of the largest dot product into the open sequence, cut where nothing fits whole; lists only."""
    left = [[key, 0, n, loss] for key, n, loss in examples]  # key, start, tokens, whether each token bears loss
    sequences = []
    while left:
        free, found = [limits.tokens, limits.segments, limits.loss_tokens], []
        while free[0] and free[1] and left:
            cap = (limits.tokens, limits.segments, limits.loss_tokens)
            score = lambda x: sum(d / c * f / c for d, c, f in zip((x[2], 1, sum(x[3][x[1] : x[1] + x[2]])), cap, free))
            whole = [x for x in left if x[2] <= free[0] and sum(x[3][x[1] : x[1] + x[2]]) <= free[2]]
            x = max(whole or left, key=score)
            n = loss = 0
            while n < min(x[2], free[0]) and loss + x[3][x[1] + n] <= free[2]:
                loss += x[3][x[1] + n]
                n += 1
            if not n:
                break
            found.append((x[0], x[1], n))
            free = [free[0] - n, free[1] - 1, free[2] - loss]
            x[1], x[2] = x[1] + n, x[2] - n
            left = [y for y in left if y[2]]
        sequences.append(found)
    return sequences


def test_all_three_limits_bind_and_nothing_is_padded():
    rng = random.Random(4)
    limits = packing.Limits(tokens=128, segments=6, loss_tokens=70, pool=64)
    examples = []
    for key in range(300):
        n = rng.choice([3, 8, 20, 60, 200])
        examples.append((key, n, [rng.random() < rng.choice([0.1, 0.9]) for _ in range(n)]))
    packer = packing.Packer(limits, 0)
    for key, n, loss in examples:
        packer.add(key, np.arange(n), np.append(0, np.cumsum(loss)))
    packer.flush()
    pieces = pd.DataFrame(packer.taken(), columns=[c.split()[0] for c in packing.PIECES.split(", ")])
    check_pieces(pieces, {key: list(range(n)) for key, n, _ in examples}, limits)
    per = pieces.groupby("sequence_id").agg(n=("length", "sum"), s=("length", "size"), l=("loss_tokens", "sum"))
    assert all(n & (n - 1) == 0 for n in per["n"])
    assert (per["n"] == 128).any() and (per["s"] == 6).any() and (per["l"] >= 65).any()
    # about as many sequences as the plain packer needs with all examples in view, which pads what it closes early
    assert len(per) <= 1.5 * len(plain_pack(examples, limits))


def test_turns_are_packed_whole(spark):
    got = queries.turn_packing(spark, SF).toPandas()
    per = got.groupby("sequence_id").agg(n=("length", "sum"), s=("length", "size"), l=("loss_tokens", "sum"))
    assert per["s"].max() <= 16 and per["l"].max() <= 2048 and per["n"].max() <= 4096 and all(n & (n - 1) == 0 for n in per["n"])
    assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()


# token counts


def test_token_counts_match_a_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models

    path = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    scores = token_counts.piece_scores(path)
    reference = Tokenizer(models.Unigram(list(scores.items()), None, False))
    texts = [r.text for r in table(spark, "documents").limit(60).collect()]
    covered = set("".join(p for p in scores if len(p) == 1))
    trie = token_counts.Trie(scores, max_nodes=2000)
    for w in {w for t in texts for w in t.split()}:
        token = token_counts.WORD_MARK + w
        if set(token) <= covered:
            assert trie.count(token) == len(reference.encode(token).ids), token


def test_token_counts_of_odd_texts(spark):
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs(spark, VARIED), f"{queries.TOKENIZERS}/piece_bpe_32k.model").collect()}
    assert got[0] == got[1] == got[2] == (0, 0)
    scores = token_counts.piece_scores(f"{queries.TOKENIZERS}/piece_bpe_32k.model")

    def plain(token):
        best = [(0.0, 0)] + [None] * len(token)
        for k in range(1, len(token) + 1):
            found = [(best[j][0] + scores[token[j:k]], best[j][1] + 1) for j in range(max(0, k - 60), k) if token[j:k] in scores]
            if token[k - 1] not in scores:
                n = len(token[k - 1].encode())
                found.append((best[k - 1][0] + n * token_counts.BYTE_SCORE, best[k - 1][1] + n))
            best[k] = max(found, key=lambda x: x[0])
        return best[-1][1]

    for i, t in enumerate(VARIED):
        if t:
            assert got[i] == (len(t.split()), sum(plain("▁" + w) for w in t.split()))


# language and toxicity


def test_language_of_held_out_texts(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_of_odd_texts(spark):
    model = language.fit(["the cat and the dog", "le chat et le chien", "der hund und die katze"] * 3, ["en", "fr", "de"] * 3)
    got = {r.doc_id: r for r in language.predict(docs(spark, [*VARIED, "the dog", "123 !!", "le chien et"]), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 4)] == ["und"] * 4
    n = len(VARIED)
    assert [got[n + k].lang_pred for k in range(3)] == ["en", "und", "fr"]
    assert all(r.lang_pred == "und" for r in language.predict(docs(spark, ["a"]), language.Model()).collect())


def test_letters_beyond_the_third_plane_count(spark):
    model = language.fit(["the cat", "le chat"] * 3, ["en", "fr"] * 3)
    (row,) = language.predict(docs(spark, ["\U00030000\U00030001"]).where("doc_id IS NOT NULL"), model).collect()
    assert row.lang_pred != "und"


def test_language_sample_is_bounded_and_whole_where_small(spark):
    rows = docs(spark, [f"text {i}" for i in range(3000)], ["en" if i else "fr" for i in range(3000)])
    texts, langs = language.training_sample(rows.unionByName(rows), F.lit(True), sample=100)
    assert Counter(langs) == {"en": 100, "fr": 1} and len(set(texts)) == 101


def test_language_counts_do_not_depend_on_blocks(monkeypatch):
    text, letters = "Le petit chat, dort; là-bas 12 fois. " * 50, language._letters()
    whole = language.counts(text, letters)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (language.counts(text, letters) == whole).all()


def test_toxicity_of_planted_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(5))
    bad = ["zorgle", "flimkin", "brastok", "idiot"]
    texts, toxic = [], []
    for i in range(600):
        t = [word() for _ in range(60)]
        if i % 8 == 0:
            for _ in range(3):
                t[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(t)), toxic.append(i % 8 == 0)
    model = toxicity.fit(texts, np.array(toxic))
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs(spark, ["a clean text " * 20, "you zorgle and flimkin " + "ab " * 40, None, ""]), model).collect()}
    assert got[0] < 0.3 <= got[1] and got[2] < 0.3 and got[3] < 0.3
    assert all(r.score < 0.01 for r in toxicity.score_texts(docs(spark, ["x"]), toxicity.fit(["a"], np.array([False]))).collect())


def test_toxicity_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((got["toxic"] == 1) & (got["predicted"] == 1)).sum()
    assert hit >= 0.8 * (got["toxic"] == 1).sum() and hit >= 0.9 * (got["predicted"] == 1).sum() and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_toxicity_learns_a_repeated_doc_id_once(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (3, 1)], "doc_id long, toxic int")
    texts, toxic, _ = toxicity.training_sample(rows, labels, F.lit(True))
    assert texts == ["a", "c"] and toxic.tolist() == [True, False]


def test_label_model_matches_plain_expectation_maximisation():
    rng = np.random.default_rng(1)
    y = rng.random(500) < 0.3
    votes = np.array([rng.random(500) < np.where(y, 0.7, 0.1), rng.random(500) < np.where(y, 0.5, 0.05), rng.random(500) < np.where(y, 0.1, 0.9)]).T
    belief = plain = np.where(votes[:, 0], 0.8, 0.2)
    for _ in range(50):
        rate = [[(sum(b for b, v in zip(side, votes[:, j]) if v) + 0.5) / (sum(side) + 1) for j in range(3)] for side in (plain, 1 - plain)]
        prior = (sum(plain) + 0.5) / 501
        odds = []
        for row in votes:
            p, q = prior, 1 - prior
            for j, v in enumerate(row):
                one, zero = rate[0][j], rate[1][j]
                one = min(one, zero) if j == 2 else max(one, zero)
                p, q = p * (one if v else 1 - one), q * (zero if v else 1 - zero)
            odds.append(p / (p + q))
        plain = np.array(odds)
    got = toxicity.label_model(votes, belief, against=np.array([False, False, True]))
    assert np.abs(got - plain).max() < 1e-3 and ((got > 0.5) == y).mean() > 0.9


def test_toxicity_sample_keeps_the_class_mix(spark):
    rows = docs(spark, [f"text {i}" for i in range(900)])
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(900)], "doc_id long, toxic int")
    texts, toxic, weight = toxicity.training_sample(rows, labels, F.lit(True), sample=100)
    assert len(texts) == 200 and toxic.sum() == 100
    assert abs(np.average(toxic, weights=weight) - 1 / 9) < 1e-9
    intercept = toxicity.logistic(np.zeros((200, 1)), toxic.astype(float), weight=weight)[1]
    assert abs(1 / (1 + np.exp(-intercept)) - 1 / 9) < 1e-3


def test_label_model_discounts_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = [(rng.random(4000) < np.where(y, 0.8, 0.05)) for _ in range(3)]
    copied = rng.random(4000) < 0.2
    votes = np.array([*good, copied, copied, copied]).T
    posterior = toxicity.label_model(votes, np.where(votes[:, :3].sum(1) > 1, 0.9, 0.1))
    assert ((posterior > 0.5) == y).mean() > 0.9


# WARC


def plain_records(rows):
    first = {}
    for page_id, html in rows:
        key = (html or "").encode()
        if page_id is not None:
            first[key] = min(first.get(key, page_id), page_id)
    out = []
    for page_id, html in rows:
        key = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(key).digest()).decode()
        source = first.get(key)
        again = source is not None and page_id != source
        out.append((page_id, len(key), digest, "revisit" if again else "response", source if again else None))
    return Counter(out)


def test_warc_round_trip_with_magic_in_payloads(spark):
    trap = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n y"
    htmls = ["<p>é漢</p>", None, "", trap, "<p>é漢</p>", trap + trap, "WARC/1.1\r\n", trap, "\r\n\r\n", "a" * 70000, "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"]
    rows = [(i + 5, f"http://h/{i}\r\nX: y" if i % 2 else None, h) for i, h in enumerate(htmls)] + [(9, "u", "<p>é漢</p>"), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = Counter(tuple(r) for r in warc.page_records(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == plain_records([(p, h) for p, _, h in rows])
    assert warc.page_records(spark, pages.limit(0)).count() == 0


def test_warc_small_splits_find_the_same_records(spark):
    pages = table(spark, "pages")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = Counter(tuple(r) for r in warc.page_records(spark, pages).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == plain_records([(r.page_id, r.html) for r in pages.collect()])


# HTML


def test_html_text_of_known_structures():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav>
    <div class="cookie-notice">We use cookies</div><header>Site</header><main><article><header><h1>A &amp; B</h1></header>
    <p>One   two&nbsp;three<br>four<p>Five <b>six</b> <!-- c --><script>if (a < b) {}</script>seven
    <form><input value="q"> search</form><div class="comments"><p>nice post</p></div>
    <ul><li>x<li>y</ul></article></main><aside>side</aside><footer>&copy; me</footer></body></html>"""
    assert html_text.parse(page)[0] == ["A & B", "One two three four", "Five six seven", "x", "y"]
    for odd in (None, "", "<", "<p", "<!-- open", "<script>x", "&amp", "</p>"):
        html_text.parse(odd)
    assert html_text.parse("plain &lt; text")[0] == ["plain < text"]


def test_html_template_subtrees_go(spark):
    body = lambda i: f"<html><body><div><span>Acme</span> welcome, reader</div><div><p>Own text {i} of this page</p><p>shared by two</p></div></body></html>"
    rows = [(i, f"http://acme.org/{i}", body(i)) for i in range(9)] + [(20, None, body(20)), (21, "nonsense", None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3 of this page" and got[21] == ""
    assert got[20] == "Acme welcome, reader\nOwn text 20 of this page\nshared by two"


def test_html_keeps_recurring_articles_and_mirrored_pages(spark):
    """Wrappers that recur inside an article, and pages that are copies of each other."""
    article = "<html><body><nav>menu</nav><article><div class='content'><p>Same text</p></div></article></body></html>"
    mirror = "<html><body><div><p>Only this</p></div></body></html>"
    rows = [(i, f"http://a.org/{i}", article) for i in range(4)] + [(10 + i, f"http://b.org/{i}", mirror) for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(4)} == {"Same text"} and {got[10 + i] for i in range(4)} == {"Only this"}


def test_html_markup_is_never_text():
    texts = lambda h: html_text.parse(h)[0]
    assert texts('<p class="x>Hello world</p><p>second</p>') == [] and texts('one<a href="x>y</article>') == ["one"]
    assert texts("<p title=it's>hello</p>") == ["hello"] and texts('a<img alt="x>y">b <c') == ["ab"]
    assert texts("<p>1 < 2 <!-- a > b -->and 3</p>") == ["1 < 2 and 3"]
    assert texts('<div class="ad-free legal-history">own</div><div class="cookie-notice">no</div><div class="ad_box2">no</div><p>We <label>mean</label> it</p>') == ["own", "We mean it"]
    assert texts("<div>" * 30000 + "deep" + "</div>" * 30000) == ["deep"]


def test_html_templates_match_a_plain_count(spark):
    """Subtrees of well-formed pages, counted from a plain parser, decide which blocks go."""
    from xml.etree import ElementTree

    rng = random.Random(8)
    boxes = ["<div>" + "".join(f"<p>b{rng.randrange(40)}</p>" for _ in range(rng.randrange(1, 3))) + "</div>" for _ in range(30)]
    pages = [(i, f"http://h{i % 3}.org/{i}", "<html><body>" + "".join(rng.choices(boxes, k=rng.randrange(1, 6))) + f"<p>own {i}</p></body></html>") for i in range(90)]
    seen = defaultdict(set)
    for i, url, h in pages:
        for node in ElementTree.fromstring(h).iter():
            if node.tag in ("div", "p"):
                seen[url.split("/")[2], ElementTree.tostring(node)].add(i)
    limit = max(3, min(0.2 * 30, 30**0.5))

    def kept(node, host):
        if len(seen[host, ElementTree.tostring(node)]) >= limit and node.tag in ("div", "p"):
            return []
        return [node.text] if node.text else [t for child in node for t in kept(child, host)]

    want = {i: "\n".join(kept(ElementTree.fromstring(h), url.split("/")[2])) for i, url, h in pages}
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want and any("b" in t for t in got.values())


def test_html_keeps_articles_of_documents(spark):
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, SF).collect()}
    for r in table(spark, "pages").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1]
        import html as entities

        want = " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>?", "\n", article))).split())
        assert " ".join(got[r.page_id].text.split()) == want and got[r.page_id].n_chars == len(got[r.page_id].text)


# decontamination


def test_leaks_found_and_clean_documents_left(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(rng.choice([16, 40, 55, 120])) for _ in range(30)]
    planted, texts = set(), []
    for i in range(200):
        t = text(rng.randrange(0, 400)).split()
        if i % 5 == 0:
            k = rng.randrange(len(items))
            words = items[k].split()
            if i % 10 == 0:  # a paraphrase: every sixth word replaced
                words = [rng.choice(vocabulary) if j % 6 == 5 else w for j, w in enumerate(words)]
            at = rng.randrange(len(t) + 1)
            t[at:at] = words
            planted.add((i, k))
        texts.append(" ".join(t))
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(None, "y", "x"), (99, None, "x"), (98, "", "x")], "item_id long, text string, lang string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, [*texts, None, ""]), bench).collect()}
    brute = set()
    for k, item in enumerate(items):
        for p in decontaminate.pieces_of(pd.DataFrame({"item_id": [k], "text": [item], "answer": [None]})):
            for i, t in enumerate(texts):
                words = t.split()
                for at in range(0, max(1, len(words)), 32):
                    if decontaminate.common_words(decontaminate.masks_of(p), len(p.words), words[max(0, at - 32) : at + 96]) >= 0.6 * len(p.words):
                        brute.add((i, k))
    assert planted <= found and found <= brute
    assert len(found & brute) >= 0.9 * len(brute)
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.leaks(empty(spark), bench).count() == 0


def test_short_items_are_all_found(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(6000)]
    text = lambda n: [rng.choice(vocabulary[: rng.choice([60, 6000])]) for _ in range(n)]
    texts = [text(300) for _ in range(400)]
    items, planted, exact = [], set(), set()
    for k in range(2000):
        d, n = rng.randrange(400), rng.randrange(5, 21)
        at = rng.randrange(300 - n)
        words = texts[d][at : at + n]
        if k % 2:  # every third word replaced
            words = [rng.choice(vocabulary) if j % 3 == 2 else w for j, w in enumerate(words)]
        else:
            exact.add((d, k))
        items.append(" ".join(words)), planted.add((d, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert exact <= found and planted <= found
    # brute force: every run of a document against every item
    for k in range(0, 2000, 100):
        (p,) = decontaminate.pieces_of(pd.DataFrame({"item_id": [k], "text": [items[k]], "answer": [None]}))
        assert {d for d, t in enumerate(texts) if decontaminate.close_copy(p, decontaminate.masks_of(p), t, 0.6)} <= {d for d, i in found if i == k}


def test_answers_must_occur(spark):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words[:30]), "w40 w41"), (2, " ".join(words[:30]), "nowhere")], "item_id long, text string, answer string")
    assert {r.item_id for r in decontaminate.leaks(docs(spark, [" ".join(words), "other text"]), bench).collect()} == {1}


def test_word_ids_are_the_tokenizers():
    path = f"{queries.TOKENIZERS}/word_bpe_49k.json"
    encode = packing.WordIds(path, max_chunks=2000)
    rng = random.Random(11)
    letters = "aZ09.,;:!?'s<|>ªµº \x1c\u0301ǅİ\u0958\ufb1dΣςﬁ한ᄒ" + "".join(map(chr, range(0xC0, 0x180)))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(600)]
    texts += ["", "x" * 40000, "Don't <|endoftext|>abc", "ÀÉ. straße!", "e\u0301te", "Word word. WORD!"]
    for _ in range(2):  # learnt, then remembered
        want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [g.tolist() for g in encode(texts)] == [w.ids for w in want]


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_template_boxes_go_inside_and_outside_articles(spark):
    """A host whose boxes have no telling mark-up; its articles share a paragraph, two of its pages are copies, one is template alone."""
    shared = "<p>This passage is in several articles and belongs to each of them, whoever wrote it first.</p>"
    page = lambda i, extra="": (
        f"<html><body><div class='x0'>Acme daily <b>since 1990</b></div><main><p>Story {i} is about the number {i} and nothing else at all.</p>{extra}"
        "<div class='x1'>Share this page with friends</div></main><div><p>All rights belong to someone.</p></div></body></html>"
    )
    rows = [(i, f"http://acme.org/{i}", page(i, shared if i % 2 else "")) for i in range(12)]
    rows += [(20 + k, f"http://acme.org/m{k}", page(99)) for k in range(2)] + [(30, "http://acme.org/e", page(0).replace("<p>Story 0 is about the number 0 and nothing else at all.</p>", ""))]
    got = extracted(spark, rows)
    for i in range(12):
        assert got[i] == f"Story {i} is about the number {i} and nothing else at all." + ("\n" + shared[3:-4] if i % 2 else "")
    assert got[20] == got[21] == "Story 99 is about the number 99 and nothing else at all."
    alone = extracted(spark, [(k, r[1], r[2].replace("main>", "div>")) for k, r in enumerate(rows)])
    assert alone[14] == ""  # template alone
    assert alone[0] == got[0] and alone[12] == got[20]


def test_html_mirrors_keep_their_text(spark):
    """Many copies of one page beside other pages of the host: the copies' article is no template."""
    page = lambda text: f"<html><body><div class='x0'>Acme daily</div><article><div class='c'><p>{text}</p><p>More of it.</p></div></article></body></html>"
    rows = [(i, f"http://acme.org/{i}", page("The same story on many pages")) for i in range(10)] + [(10 + i, f"http://acme.org/o{i}", page(f"Other story {i}")) for i in range(10)]
    got = extracted(spark, rows)
    assert {got[i] for i in range(10)} == {"The same story on many pages\nMore of it."} and got[13] == "Other story 3\nMore of it."


def test_html_articles_forms_and_marks():
    texts = lambda h: html_text.parse(h)[0]
    assert texts("<div id=content><p>The real story, told at length</p></div><article class='teaser'><p>Read also this</p></article>") == ["The real story, told at length"]
    assert texts("<div id=content><p>The real story, told at length</p></div><article><p>And</p></article>") == ["The real story, told at length", "And"]
    assert texts("<article><form><p>What the article says</p><input value=x></form></article>") == ["What the article says"]
    assert texts("<form id=aspnet><div><p>A page inside one form</p><button>Go</button></div></form>") == ["A page inside one form"]
    assert texts("<p>A story of some length</p><form>Your name <input></form>") == ["A story of some length"]
    assert texts("<form><nav>menu</nav><article><p>Own</p></article></form><div>A longer text beside the form</div>") == ["Own", "A longer text beside the form"]
    assert texts("<article><div class='legal'>A case in court</div><p class=share>of the market</p><p id=search>for gold</p><div class='share-price'>rose</div></article>") == ["A case in court", "of the market", "for gold", "rose"]
    assert texts("<article><p>Own</p><div class='ad'>buy</div><div id='comments'><p>nice</p></div></article>") == ["Own"]


def test_label_model_overrules_labels_that_no_voter_shares():
    """A posterior is no copy of the label: a text without any entry that is labelled toxic is doubted, one full of entries that is labelled clean as well."""
    rng = random.Random(4)
    bad = ["zorgle", "flimkin", "bratzle", "quimdor", "snargel", "plonkist"]
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    clean = lambda: " ".join(rng.choice(words) for _ in range(80))
    nasty = lambda: " ".join([*(rng.choice(words) for _ in range(60)), *rng.choices(bad, k=6)])
    texts = [clean() for _ in range(400)] + [nasty() for _ in range(60)] + [clean() for _ in range(4)] + [nasty() for _ in range(4)]
    toxic = np.array([False] * 400 + [True] * 60 + [True] * 4 + [False] * 4)
    own = toxicity.firsts(texts)
    lexicon = toxicity.lexicons(texts, toxic, np.ones(len(texts)))
    assert own.all() and set(bad) <= set(lexicon[0]) | {w for w in bad for s in lexicon[1] if w.startswith(s)}
    x = np.array([toxicity.features(t, *lexicon) for t in texts])
    votes, against, error = toxicity.votes_of(x, toxic)
    posterior = toxicity.label_model(votes, np.where(toxic, 0.9, 0.02), against=against, error=error)
    assert (posterior[:400] < 0.2).all() and (posterior[400:460] > 0.8).all()
    assert (posterior[460:464] < 0.5).all() and (posterior[464:] > 0.5).all()


def test_copies_are_no_lexicon():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    copied = [word() for _ in range(60)]
    near = lambda: " ".join(w if rng.random() > 0.02 else word() for w in copied)
    texts = [near() for _ in range(80)] + [" ".join(word() for _ in range(60)) for _ in range(200)]
    toxic = np.array([True] * 80 + [False] * 200)
    own = toxicity.firsts(texts)
    assert own[:80].sum() <= 4 and own[80:].all()
    model = toxicity.fit(texts, toxic)
    assert not set(copied) & set(model.words)


def test_training_with_one_class_only(spark):
    score = lambda model: {r.score for r in toxicity.score_texts(docs(spark, ["clean", None, "you idiot"]), model).collect()}
    assert all(s > 0.99 for s in score(toxicity.fit(["you idiot", "you fool"], np.array([True, True]))))
    assert all(s < 0.01 for s in score(toxicity.fit(["fine", "good"], np.array([False, False]))))


def plain_language(text, model):
    """Nearest centroid of a text by dictionaries of n-grams and loops; none without a letter."""
    padded, m = " ", 1 << 32
    for c in (text or "").lower():
        padded += c if c.isalpha() else " " if padded[-1] != " " else ""
    if not padded.strip():
        return None
    padded = padded.rstrip() + "  " if not (text or "").lower()[-1].isalpha() else padded + " "
    grams = Counter()
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            c = [ord(x) for x in padded[k : k + n]]
            if n == 1 and c[0] == 32:
                continue
            h = c[0] * 2654435761 if n == 1 else c[1] * 40503 + c[0] * 2246822519 if n == 2 else c[2] * 40503 + c[1] * 2246822519 + 0
            if n == 3:
                h = (h % m) * 3266489917 + c[0] * 668265263
            h %= m
            grams[((h ^ (h >> 15)) * 2654435761 % m) >> 20] += 1
    weights = {g: math.log1p(n) * float(model.idf[g]) for g, n in grams.items()}
    norm = math.sqrt(sum(v * v for v in weights.values()))
    cosines = [sum(v * float(c[g]) for g, v in weights.items()) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    return model.languages[model.owner[best]], cosines[best]


def test_language_matches_a_plain_nearest_centroid(spark):
    rows = table(spark, "documents")
    model = language.fit(*language.training_sample(rows, F.lit(True)))
    texts = {r.doc_id: r.text for r in rows.collect()} | {10**6 + k: t for k, t in enumerate(VARIED)}
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    for d, t in texts.items():
        plain = plain_language(t, model)
        if plain is None:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
        else:
            assert got[d].lang_pred == plain[0] and abs(got[d].score - min(1, max(0, plain[1]))) < 1e-4


def test_leaks_of_several_blocks_of_items_are_those_of_one(spark):
    """Items in blocks of seven: documents are still read twice, and all planted items of one to twenty words are found, short ones where they are at least five words."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(60)]
    items, planted = [], defaultdict(set)
    for k in range(60):
        d, n = rng.randrange(60), k % 20 + 1
        at = rng.randrange(200 - n)
        items.append((k, " ".join(texts[d][at : at + n])))
        planted[n < decontaminate.SHORTEST].add((d, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(spark, [" ".join(t) for t in texts])
    one = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    many = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, items_at_once=7).collect()}
    assert planted[False] <= one and planted[False] <= many
    recall = len(planted[True] & one) / len(planted[True])
    print(f"recall of items of one to four words: {recall:.2f}")
    assert decontaminate.leaks(frame, bench.limit(0)).collect() == []


def test_latent_space_is_fitted_on_the_passages_of_all_documents(spark):
    """A thousand documents of one passage, each with a word of its own: every word is in the sums, once, however the rows are dealt."""
    texts = [f"word{k} other text" for k in range(1000)] + [None, ""]
    index = {f"word{k}": k for k in range(1000)}
    made = []
    for parts in (1, 5):
        rows = docs(spark, texts)
        n, df, sums = decontaminate.corpus_counts(rows.repartition(parts), index)
        assert n == rows.count() and df.tolist() == [1] * 1000
        rows = sums.orderBy("at").collect()
        made.append(np.concatenate([np.frombuffer(r.part, dtype=np.int64) for r in rows]).reshape(-1, 1000))
    assert (made[0] == made[1]).all() and len(made[0]) == decontaminate.n_sums(1000)
    assert (np.abs(made[0]).sum(axis=0) == 1).all()


def test_latent_sums_keep_the_products_of_words(spark):
    """Passages are of two cells of one text; the sums' products of words are those of all passages but for noise."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(4) + 4 * rng.randrange(1 + k % 2)}" for _ in range(rng.randrange(1, 100))) for k in range(800)]
    index = {f"w{k}": k for k in range(8)}
    _, _, sums = decontaminate.corpus_counts(docs(spark, texts), index)
    got = np.concatenate([np.frombuffer(r.part, dtype=np.int64) for r in sums.orderBy("at").collect()]).reshape(-1, 8).astype(float)
    rows = []
    for words in (t.split() for t in texts):
        rows += [np.bincount([index[w] for w in words[at : at + 64]], minlength=8) for at in range(0, len(words), 32)]
    want = np.array(rows, dtype=float)
    a, b = got.T @ got, want.T @ want
    assert np.abs(a - b).max() < 0.1 * b.max()
