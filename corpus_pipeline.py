"""A corpus pipeline: quality rules, line dedup, n-gram join, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's docs.  All but the
last return the columns of documents.

Edge cases: a document of null or empty text has no words, so the first stage rejects it;
in later stages such a document stays.  A document of null id takes part in the first
stage and in packing, and passes the stages between unchanged.  Rows that share an id are
one document where documents are dropped: all of them go, or all stay.  Ties go to the
least id.  Columns beyond those of documents pass unchanged, also where their names are
those that an operator adds.  An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import decontaminate, line_dedup, ngram_join, packing, quality
from faultline.llm.workspace import Workspace, scope

#: SQL cannot express best-fit packing or the edit join; a test compares run() with a version in plain Python.
ORACLE_SQL = None

#: A text with a word.
HAS_WORD = r"[^\x20\x09-\x0D]"


def beside(docs: DataFrame, added: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs only; those named like the added ones are kept out of its way."""
    hidden = {c: f"__{c}" for c in docs.columns if c in added}
    done = work(docs.withColumnsRenamed(hidden))
    return done.drop(*hidden).withColumnsRenamed({v: k for k, v in hidden.items()}).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return beside(docs, quality.ADDED, lambda d: quality.judge(d).where("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that lost lines and has no word left goes."""

    def work(d: DataFrame) -> DataFrame:
        cleaned = line_dedup.dedup(d, short=line_dedup.SHORT).where((F.col("n_removed") == 0) | F.col("text").rlike(HAS_WORD))
        return cleaned.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))

    return beside(docs, line_dedup.ADDED, work)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    lost = ngram_join.join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    hits = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(hits.where("n_hit > 0").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_join", near_copy_stage), ("decontaminate", benchmark_stage), ("pack", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table.  A stage's own tables are removed when its result is written, and its input with them."""
    place = Workspace(spark, "corpus-pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scope():
            docs = place.table(name, stage(spark, docs, sf_dir))
        if before:
            place.drop(before)
        before = name
    return docs
