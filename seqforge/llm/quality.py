"""Quality rules with risk-controlled cutoffs.

Every document gets a handful of signals from built-in functions. A rule rejects a
document whose signal exceeds a cutoff. Cutoffs are chosen for each length stratum by
testing, on labelled clean documents, the hypothesis that a cutoff rejects more than an
allowed share of clean documents: an exact binomial test, walked from the loosest cutoff
to the strictest until one is not certified, with a Bonferroni share of ``delta`` for each
stratum and rule. So with probability 1 - ``delta`` no stratum loses more than ``alpha``
of its clean documents to these rules.

Defined results: null text counts as empty; an empty text fails the base rules. Null
labels and labels of unknown documents are ignored, repeated texts calibrate once, and a
stratum with too few labels gets no cutoff (the base rules alone decide). Extra columns
pass through ``with_signals`` and ``judge``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: White space and symbols of the base signals.
BREAKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW_WORDS, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Upper word counts of the length strata; longer documents form the last one.
STRATA = (50, 200, 1000)
#: Cutoffs of each rule from the loosest to the strictest.
RULES = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05),
    "mark_share": (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2),
    "caps_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15),
    "repeat_share": (0.19, 0.16, 0.13, 0.1, 0.07, 0.05, 0.03),
}
ALPHA, DELTA = 0.05, 0.05
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside windows that occur twice or more, from window hashes sorted with their places."""
    grams = F.when(
        F.size("_words") >= WINDOW_WORDS,
        F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW_WORDS))),
    )
    df = df.withColumn("_grams", grams)
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    places = F.transform(
        "_sorted",
        lambda x, j: F.when((x["g"] == F.get(F.col("_sorted"), j - 1)["g"]) | (x["g"] == F.get(F.col("_sorted"), j + 1)["g"]), x["i"]),
    )
    df = df.withColumn("_places", F.sort_array(F.filter(places, lambda p: p.isNotNull())))
    covered = F.aggregate(
        F.transform("_places", lambda p, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(F.col("_places"), j + 1) - p, F.lit(WINDOW_WORDS)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_grams", "_sorted", "_places")


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base signals, the rules' shares, ``base_failed`` and ``stratum``."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    t = F.col("_text")
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(t, BREAKS, "")).cast("long"),
            "n_symbols": _count_of(t, SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines"),
            "_caps": _count_of(t, CAPITALS),
            "_marks": _count_of(t, "!?"),
        }
    )
    df = _repeat_words(df)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    df = df.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "mark_share": share("_marks", "n_words"),
            "caps_share": share("_caps", "word_chars"),
            "dup_line_share": share("n_dup_lines", "_n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "stratum": reduce(lambda c, i: c.when(F.col("n_words") <= STRATA[i], i), range(1, len(STRATA)), F.when(F.col("n_words") <= STRATA[0], 0)).otherwise(len(STRATA)),
        }
    )
    return df.drop("_text", "_words", "_lines", "_n_lines", "_caps", "_marks")


def _binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) by logarithms of the terms, each from the one before; 1 where k is above the mean."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    step = lambda a, i: F.struct(
        (a["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + odds).alias("term"),
        a["total"].alias("total"),
    )

    def add(a: Column, i: Column) -> Column:
        term = step(a, i)["term"]
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add)["total"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(total))


def cutoffs(signals: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum (at most ``len(STRATA) + 1``), a nullable cutoff column for each rule.

    ``signals`` needs doc_id, text_hash, base_failed, stratum and the shares.
    """
    risk = alpha / len(RULES)
    level = delta / (len(RULES) * (len(STRATA) + 1))
    clean = labels.where("quality = 1").select("doc_id").distinct()
    holdout = signals.where(~F.col("base_failed")).join(clean, "doc_id").dropDuplicates(["text_hash"])
    counts = [F.count_if(F.col(rule) > cut).alias(f"{rule}_{i}") for rule, grid in RULES.items() for i, cut in enumerate(grid)]
    cells = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cutoff"), F.col(f"{rule}_{i}").alias("rejected")) for rule, grid in RULES.items() for i, cut in enumerate(grid)]))
    tested = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *counts).select("stratum", "n", cells.alias("c")).select("stratum", "n", "c.*")
    tested = tested.withColumn("certified", _binomial_tail(F.col("rejected"), F.col("n"), risk) <= level)
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    passed = tested.withColumn("all_so_far", F.min("certified").over(so_far)).where("all_so_far")
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"{rule}_cutoff") for rule in RULES])


def judge(signals: DataFrame, limits: DataFrame) -> DataFrame:
    """``kept``: the base rules passed and no certified cutoff exceeded. ``limits`` has a row for each stratum."""
    fired = reduce(lambda a, b: a | b, [F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False)) for rule in RULES])
    judged = signals.join(F.broadcast(limits), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~fired)
    return judged.drop(*[f"{rule}_cutoff" for rule in RULES])


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def holdout_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """The narrow columns that calibration needs, kept."""
    hashed = docs.select("doc_id", F.col(text).alias("text"), text_hash(text).alias("text_hash"))
    return common.cut(with_signals(hashed).drop("text"))
