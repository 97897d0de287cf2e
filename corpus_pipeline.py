"""Training-data pipeline: documents to packed sequences, stage by stage.

Each stage gets the documents that its predecessor kept, and all but the last
return the columns of documents.  run() writes each stage's result as Parquet
into the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import decontam, linededup, packing, quality, simhash
from sessionlake.llm.common import made, release, store, table
from sessionlake.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the better grade is at least a half."""
    return quality.select(docs, table(spark, sf_dir, "labels"), least=0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three documents or more have, but for the last of them; n_chars follows the text."""
    out = linededup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8)."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Fitted models, fingerprints and alignments can't be said in SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = made()
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark, keep=(docs._scratch_path,))  # what the stage itself had put down
    return STAGES[-1][1](spark, docs, sf_dir)
