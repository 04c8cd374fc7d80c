"""Corpus pipeline: five stages, each written as Parquet and read by the next.

``STAGES`` lists ``(name, function)``; every function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame. All but the last return the columns of the
documents. ``run`` applies them to the ``documents`` table. Each stage's written
table cuts its lineage, so a lost executor repeats work of one stage only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpairs.llm import mixing, packing, quality_rules, simhash, toxicity
from sparkpairs.llm.common import table
from sparkpairs.session import scratch_path

#: A corpus is read once; what the weights leave over is not repeated.
MIX = mixing.MixSettings(max_epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives the tokens of its budget."""
    return mixing.mix(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    p = packing.pack(docs)
    return p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier, XXH64 fingerprints and a tokenizer have no SQL form; the stages are tested against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
