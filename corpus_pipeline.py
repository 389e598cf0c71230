"""Training-corpus pipeline: quality rules, line dedup, near-dedup, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. ``run`` applies them to documents and puts a table between stages, so that none is computed twice.

Defined results, for every stage: an empty table gives an empty one; texts of any length are taken whole; input columns
of any name are carried along unchanged (n_chars follows the text, and the last stage returns columns of its own). Null
and blank texts fail the quality rules; in the later stages, called by themselves, a null text stays null in line dedup,
counts as a text without a word in near-dedup (one of those stays) and in mixing (it weighs nothing, so goes only where
its whole source does), and has no token ids. Rows without doc_id keep their lines, come last in near-dedup and go by
their text in mixing. Repeated rows are judged alike by the first two stages; near-dedup keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, quality_rules, simhash
from tidemark.llm._common import cut, read, released


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; so does a document that loses its last word."""
    kept = line_dedup.keep_first_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document appears once for each pass over it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs, bpe.default_tokenizer(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("bpe", encode),
]

#: Compression verdicts, fingerprints and token ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with released(spark, "pipeline"):  # what a stage held goes with its end
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
