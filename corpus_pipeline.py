"""A corpus pipeline over documents: toxic ones go, one of each group of near copies stays, secrets are masked, and what
is left is packed into training sequences. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowgauge.llm import packing, secret_scan, simhash, toxicity
from flowgauge.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents below their language's threshold (0.3 without one). A null text is scored as no words; of rows with one
    id each is judged by its own text; no rows: no rows, no labels: a model that tells nothing apart."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the smallest doc_id, then the smallest SHA-256 of the text, then the
    other columns as JSON. Null and blank texts are one group; rows without a doc_id stay; no rows: no rows."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars, where there is one, brought up to date. A null text stays null;
    repeated rows are masked alike; no rows: no rows."""
    return secret_scan.mask(docs, secret_scan.fit(spark, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens. A null text is its end id alone; repeated rows are
    packed each; no rows: no rows."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]
#: Training a network, XXH64 and a tokenizer are out of reach of SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
