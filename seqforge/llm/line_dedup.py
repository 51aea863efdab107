"""Line deduplication by a segment-partition edit join, in built-in functions only.

All lines of at least ``MIN_CHARS`` characters, that is all but empty ones, are compared over
all documents. Equal lines of any length are duplicates; two different lines are near
duplicates if their edit distance is at most the number of edits that the shorter one's
length allows. A line of length l that allows t edits is cut into t + 1 segments, of which
one survives t edits unchanged; so every line looks up, for each length from its own down to
t less, the few substrings of itself that can stand for a segment of a line of that length
(multi-match-aware positions), keyed by length, segment number and content. Letter counts
discard most chance meetings inside the join. What is left is verified exactly: common ends
are trimmed, and a banded bit-parallel automaton (bits are diagonals, one word per number of
edits) reads the rest.

A line goes if the same line, or a near duplicate of it, occurs earlier: lines are ordered by
the smallest doc_id that holds them, then their smallest position, then their hash. Within a
document the first of equal lines stays. Equal lines are counted before anything is joined,
so a line that fills a third of the table is one row of the join.

Defined results: null texts stay null; empty lines always stay; a document whose lines all
go gets an empty text; rows that share a doc_id count as one document, and rows of null
doc_id lose only lines that repeat within them; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MAX_EDITS, CHARS_PER_EDIT = 1, 2, 40
#: Letters whose counts form the signature of a line, five bits each.
LETTERS = "etaonirshdlu"
#: Bytes of dropped positions that are broadcast at most: of a position, and of a document with its key and array.
MAX_BYTES, POSITION_BYTES, ROW_BYTES = 32 << 20, 4, 64


def allowed_edits(length: Column) -> Column:
    return F.least(F.lit(MAX_EDITS), F.floor(length / CHARS_PER_EDIT).cast("int"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, id of the comparable lines."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.where(F.length("line") >= MIN_CHARS)
    return rows.withColumn("id", F.xxhash64("line"))


def _places() -> list[tuple[int, int, int, int, bool]]:
    """Where a line may hold a segment of an indexed line: the indexed line's edits, by how much it is shorter, the segment, its shift, and whether the place is the line's own segment."""
    places = []
    for edits in range(1, MAX_EDITS + 1):
        for less in range(edits + 1):
            for segment in range(edits + 1):
                spare = edits - segment  # edits that may follow the segment; ``segment`` of them may precede it
                for shift in range(max(-segment, less - spare), min(segment, less + spare) + 1):
                    places.append((edits, less, segment, shift, less == 0 and shift == 0))
    return places


def _keys() -> dict[str, Column]:
    """Keys k0, k1, ... of a line of length ``len``, one for each place; null where the indexed line would allow another number of edits.

    Segments are cut from ``wide``, the line in four bytes a character: cutting from a string walks there from its first character, each time.
    """

    def key(edits: int, less: int, segment: int, shift: int, _own: bool) -> Column:
        n = F.col("len") - less
        start, end = (F.floor(n * k / (edits + 1)).cast("int") for k in (segment, segment + 1))
        return F.when(allowed_edits(n) == edits, F.xxhash64(n, F.lit(segment), F.substring("wide", (start + shift) * 4 + 1, (end - start) * 4)))

    return {f"k{i}": key(*p) for i, p in enumerate(_places())}


def _signature() -> Column:
    """Counts of the letters modulo 32, five bits each, below the length modulo 16. Letters are taken out one after another, so that what is looked through shrinks.

    The lambda, beside the counts, keeps the whole projection out of whole-stage code, where keys and counts are one method that is too long to be compiled.
    """
    rest, counts = F.col("line"), F.lit(0).cast("long")
    for c in LETTERS:
        less = F.replace(rest, F.lit(c), F.lit(""))
        counts, rest = counts * 32 + (F.octet_length(rest) - F.octet_length(less)).cast("long").bitwiseAND(F.lit(31)), less
    return counts.bitwiseOR(F.get(F.transform(F.array("len"), lambda n: F.shiftleft((n % 16).cast("long"), 60)), 0))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id, first_doc, first_pos, n (occurrences), sig and the keys k0, k1, ... of every distinct line; stored."""
    rows = _lines(docs).withColumns({"len": F.length("line"), "wide": F.encode("line", "UTF-32")}).withColumns({**_keys(), "sig": _signature()})
    keys = [F.any_value(k).alias(k) for k in _keys()]
    grouped = rows.groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.any_value("sig").alias("sig"), *keys)
    return common.stored(grouped)


def candidate_pairs(distinct: DataFrame) -> DataFrame:
    """a, b: ids of distinct lines that share a segment and nearly the same letters; kept.

    With e edits of which d change the length, letter counts differ by at most 2 e - d.
    """
    own = [f"k{i}" for i, p in enumerate(_places()) if p[-1]]
    flat = lambda names: distinct.select("id", "sig", F.explode(F.array_compact(F.array(*names))).alias("key"))
    probe, index = flat([f"k{i}" for i in range(len(_places()))]).toDF("a", "sig_a", "key"), flat(own).toDF("b", "sig_b", "key")

    def apart(k: int) -> Column:
        five = [F.shiftright(c, 5 * k).bitwiseAND(F.lit(31)) for c in ("sig_a", "sig_b")]
        d = F.abs(five[0] - five[1])
        return F.least(d, 32 - d)

    longer = (F.shiftright("sig_a", 60) - F.shiftright("sig_b", 60)).bitwiseAND(F.lit(15))  # by how much a is longer
    near = reduce(lambda x, y: x + y, [apart(k) for k in range(len(LETTERS))]) + longer <= 2 * MAX_EDITS
    met = probe.join(index, (probe.key == index.key) & ((longer > 0) | (F.col("a") > F.col("b"))) & near)
    return common.cut(met.select("a", "b").distinct())


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by steps of falling powers of two."""
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    fits = lambda n, step: (n + step <= F.least(F.length(a), F.length(b))) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step))
    return F.aggregate(powers, F.lit(0), lambda n, step: F.when(fits(n, step), n + step).otherwise(n))


def automaton(pattern: Column, text: Column, limit: int = MAX_EDITS) -> Column:
    """Final words r0, r1, ... of the banded bit-parallel automaton over two arrays of characters.

    Bit d + limit of word e says: with e edits, the text read so far matches a prefix of the
    pattern that is longer by d.
    """
    whole = (1 << (2 * limit + 1)) - 1
    names = [f"r{e}" for e in range(limit + 1)]

    def struct(words: list[Column]) -> Column:
        return F.struct(*[w.cast("int").alias(n) for w, n in zip(words, names, strict=True)])

    start, word = [], 1 << limit
    for _ in names:
        start.append(F.lit(word))
        word |= (word << 1) & whole

    def read(r: Column, j: Column) -> Column:
        hit = reduce(
            lambda x, y: x.bitwiseOR(y),
            [F.when(F.get(pattern, j + d) == F.get(text, j), F.lit(1 << (d + limit))).otherwise(F.lit(0)) for d in range(-limit, limit + 1)],
        )
        words = [r["r0"].bitwiseAND(hit)]
        for e in range(1, limit + 1):
            before = r[f"r{e - 1}"]
            moved = r[f"r{e}"].bitwiseAND(hit).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
            words.append(moved.bitwiseAND(F.lit(whole)))
        return struct(words)

    steps = F.when(F.size(text) > 0, F.sequence(F.lit(0), F.size(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, struct(start), read)


def edits_of(final: str, ahead: Column, limit: int = MAX_EDITS) -> Column:
    """Least number of edits whose word in the automaton's final state has the bit of a pattern ``ahead`` of the text; else ``limit`` + 1."""
    place = F.greatest(F.lit(0), F.least(ahead + limit, F.lit(2 * limit)))
    found = F.lit(limit + 1)
    for e in range(limit, -1, -1):
        found = F.when(F.call_function("getbit", F.col(final)[f"r{e}"], place) == 1, e).otherwise(found)
    return F.when(F.abs(ahead) <= limit, found).otherwise(limit + 1)


def verified(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (line_a, line_b, ...) within the edits that the shorter line allows."""
    limit = allowed_edits(F.least(F.length("line_a"), F.length("line_b")))
    rows = pairs.where(F.abs(F.length("line_a") - F.length("line_b")) <= limit)
    rows = rows.withColumn("_n", _common_prefix(F.col("line_a"), F.col("line_b")))
    rest = lambda c: F.expr(f"reverse(substring({c}, _n + 1))")
    rows = rows.withColumns({"_a": rest("line_a"), "_b": rest("line_b")})
    rows = rows.withColumn("_m", _common_prefix(F.col("_a"), F.col("_b")))
    characters = lambda c: F.filter(F.split(F.expr(f"substring({c}, _m + 1)"), ""), lambda x: x != "")
    rows = rows.withColumns({"_a": characters("_a"), "_b": characters("_b")})
    rows = rows.withColumn("_r", automaton(F.col("_a"), F.col("_b")))
    rows = rows.withColumn("edits", edits_of("_r", F.size("_a") - F.size("_b")))
    return common.filtered(rows, F.col("edits") <= limit).drop("_n", "_m", "_a", "_b", "_r")


def near_pairs(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """a, b: ids of near-duplicate lines; kept."""
    pairs = candidate_pairs(distinct)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = common.cut(distinct.select("id", "first_doc").join(ids, "id", "left_semi"))
    texts = _lines(docs).join(common.sized(wanted), "id").where("doc_id = first_doc").select("id", "line")
    texts = common.stored(texts.groupBy("id").agg(F.any_value("line").alias("line")))
    both = pairs.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")
    return common.cut(verified(both).select("a", "b"))


def dropped_positions(docs: DataFrame) -> DataFrame:
    """doc_id, drops: positions of lines that occur earlier, themselves or nearly, in another document or place; kept."""
    distinct = distinct_lines(docs)
    near = near_pairs(docs, distinct)
    place = F.struct("first_doc", "first_pos", "id")
    places = distinct.select("id", place.alias("place"))
    ends = near.join(places.toDF("a", "place_a"), "a").join(places.toDF("b", "place_b"), "b")
    later = ends.select(F.when(F.col("place_a") < F.col("place_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    later = later.withColumn("later", F.lit(True))
    judged = common.cut(distinct.select("id", "first_doc", "n").join(later, "id", "left").where("n > 1 OR later").select("id", "first_doc", "later"))
    rows = _lines(docs).select("id", "doc_id", "pos").join(common.sized(judged), "id")
    rows = rows.where("later OR doc_id > first_doc")
    return common.cut(rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("drops")))


def without_repeats(docs: DataFrame, n_lines: str, n_dropped: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the duplicate lines taken out of ``text``; adds two counts under these names, which replace columns of theirs."""
    drops = dropped_positions(docs)
    size = drops.agg(F.sum(POSITION_BYTES * F.size("drops") + ROW_BYTES)).first()[0] or 0
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    marked = rows.join(F.broadcast(drops) if size <= MAX_BYTES else drops, "doc_id", "left").withColumn("lines", F.split("text", "\n"))
    # places of equal lines of one document, in order of their hash: all but the first repeat
    placed = F.sort_array(F.filter(F.transform("lines", lambda x, i: F.when(F.length(x) >= MIN_CHARS, F.struct(F.xxhash64(x).alias("h"), i.alias("i")))), lambda s: s.isNotNull()))
    marked = marked.withColumn("placed", placed)
    repeats = F.transform("placed", lambda s, j: F.when(s["h"] == F.get(F.col("placed"), j - 1)["h"], s["i"]))
    gone = F.array_union(F.coalesce("drops", F.array().cast("array<int>")), F.array_compact(repeats))
    marked = marked.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone))
    text = F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")
    own = {n_lines: F.size("lines").cast("long"), n_dropped: (F.size("lines") - F.size("kept")).cast("long")}
    counts = [F.when(F.col("text").isNotNull(), e).alias(c) for c, e in own.items()]
    others = [F.when(F.col("text").isNotNull(), text).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in own]
    return marked.select(*others, *counts)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without duplicate lines, with n_lines and n_dropped (which replace columns of these names)."""
    return without_repeats(docs, "n_lines", "n_dropped")
