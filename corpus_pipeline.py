"""Training-corpus pipeline over ``documents``: five operators one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; its result is
written as Parquet in the cluster's shared folder and read again.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm import bpe, decontaminate, line_dedup, near_dup, quality
from tastegrid.session import ensure_checkpoint_dir, ship_package
from tastegrid.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior of the rules' votes keep."""
    ship_package(spark)
    measured = quality.judge(docs)
    return measured.where("kept").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line of ten characters or more only in the first document that has it."""
    ship_package(spark)
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8)."""
    ship_package(spark)
    return near_dup.drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed), and digests of the ids and of what they decode to."""
    ship_package(spark)
    spec, pattern = bpe.default_spec()
    out = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), spec, pattern), spec)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", encoding),
]

#: Expectation maximisation, sketches and tokenizers have no SQL twin; tests/llm holds brute-force ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; the last one's rows."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
