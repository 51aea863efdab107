"""The queries of this subpackage, by name, and the SQL they are held against."""

from __future__ import annotations

import uuid
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard, language, line_dedup, merkle, packing, prefix_trie, quality, sql_pairs, sql_quality, sql_trees, token_counts, token_files, toxicity, warc
from .common import shared_dir, table

#: Vocabulary files of public tokenizers.
WORDS, PIECES = (public_tokenizers.path(name) for name in ("word_bpe_49k.json", "piece_bpe_32k.model"))
TOKENIZERS = str(Path(WORDS).parent)
#: Instruction data: at most half of a sequence bears loss.
TURNS = packing.Limits(loss_tokens=2048)


def _fold(n: int) -> Column:
    """The fold of a row: crc32 of its doc_id's text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-centroid language of every document; the fold of remainder 0 is held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(*language.training_sample(docs, _fold(5) != 0))
    return language.predict(docs, model).withColumn("held_out", _fold(5) == 0).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record of every page, written and read back."""
    return warc.page_records(spark, table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORDS)


def turn_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all conversations; the assistant's tokens bear loss, and all three limits bind."""
    return packing.pack_turns(table(spark, sf_dir, "conversations"), WORDS, limits=TURNS)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that occur, themselves or nearly, before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, class of equal sets and number of links of every document."""
    return jaccard.join_similar(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; the fold of remainder 2 is held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"), _fold(4) != 2))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdict of every document."""
    signals = quality.holdout_signals(table(spark, sf_dir, "documents"))
    limits = quality.cutoffs(signals, table(spark, sf_dir, "labels"))
    return quality.judge(signals, limits).select("doc_id", *quality.BASE, "base_failed", "kept", "stratum")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they leak."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document in binary shards, found again by its key through the index and read back."""
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, WORDS)
    found = token_files.read(spark, path, token_files.lookup(spark, path, token_files.keys(spark, path)))
    size = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return found.select("doc_id", "start", size, F.crc32("ids").alias("ids_crc32"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each rebuilt on the first turns of every twentieth."""
    own = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    nodes = prefix_trie.trie(*prefix_trie.rebuilt(own, heads, F.col("conv_id") - F.col("conv_id") % 20, 3))
    return nodes.drop("pos", "end")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authentication path of every document in the dataset's Merkle manifest, and what rows that were tampered with fold to."""
    leaves = merkle.dataset_leaves(table(spark, sf_dir, "documents"), _fold(7) == 0)
    proved = merkle.proofs(*merkle.manifest(leaves))
    digest = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256")
    return proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", digest, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "turn_packing": turn_packing,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_files": op11_token_files,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle": op13_merkle,
}
ORACLES = {"op2_warc": sql_pairs.WARC, "op6_ngram_jaccard_join": sql_pairs.JACCARD, "op8_quality_rules": sql_quality.ORACLE, "op12_prefix_trie": sql_trees.TRIE, "op13_merkle": sql_trees.MERKLE}
