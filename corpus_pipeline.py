"""Documents to training tokens, stage by stage; each stage's rows are written before the next one reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from emberfield.llm.cluster import shared_path
from emberfield.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on the labels beside the documents."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay only in one of them; all documents stay."""
    return line_dedup.dedup_lines(docs, counts=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat, up to the limit on passes; every document stays at least once; rows go in mixed order."""
    return mixing.in_order(mixing.mix(docs)).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text."""
    out = bpe.encode_documents(docs.select("doc_id", "source", "text"), vocabulary())
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

# Learned scores and a vocabulary's token ids cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_path(spark, f"pipeline-{name}")
        stage(spark, rows, sf_dir).write.parquet(folder)
        rows = spark.read.parquet(folder)
    return rows
