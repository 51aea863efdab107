"""The corpus pipeline: a list of stages, each a DataFrame in and a DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.llm import common, decontaminate, jaccard, line_dedup, packing, quality
from seqforge.llm.queries import WORDS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep. Signals are stored beside the rows, so that no join drops any."""
    own = docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text", quality.text_hash("text").alias("text_hash"))
    signals = common.stored(quality.with_signals(own).drop("text"))
    limits = quality.cutoffs(signals.drop("__doc"), common.table(spark, sf_dir, "labels"))
    return quality.judge(signals, common.cut(limits)).where("kept").select("__doc.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before; those of which nothing is left go."""
    own = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    done = line_dedup.without_repeats(own, "n_lines", "n_dropped")
    left = common.filtered(done, F.expr(r"n_dropped = 0 OR text IS NULL OR text RLIKE '\\S'"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def _row() -> Column:
    """What a row is known by: rows of one doc_id but different texts are judged apart, and rows without one as well."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one of the smallest doc_id (null comes last); equal rows stay or go together."""
    rows = docs.select(_row().alias("__row"), "doc_id", "text")
    groups = common.cut(jaccard.join_similar(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "class_id").distinct())
    shared = common.cut(groups.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id"))
    members = common.cut(groups.join(common.sized(shared), "class_id"))
    named = rows.select("__row", "doc_id").join(common.sized(members), "__row")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("first"))
    others = common.cut(members.join(first, "class_id").where("__row != first.__row").select("__row"))
    return common.without(docs, _row(), others)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaked = decontaminate.leaks(docs.select(_row().alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, _row(), common.cut(leaked.select("doc_id").distinct()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]
#: SQL expresses neither the similarity join's classes nor tokenisation; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs
