"""Views over the shared test tables that stand in for the reference's inputs.

Each view is built identically in the oracle SQL (see ``oracle.py``).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpairs.functions.constants import WS_CLASS
from sparkpairs.functions.rand import digest, uniform
from sparkpairs.functions.text import py_strip
from sparkpairs.operators import pairs
from sparkpairs.operators.ordering import join_null_safe, running_agg

TAG_COMMAND = "Fix grammar: "
SOURCE_TAGGED = "tagged"
SOURCE_MULTI = "multi_ref"
SOURCE_IO = "io_pairs"


#: The derived public corpora: how each becomes pairs, and what its stored splits serve as.
CORPORA = {
    SOURCE_TAGGED: pairs.Corpus(partial(pairs.adapt_tagged, source_name=SOURCE_TAGGED), {"train": "train", "validation": "test"}),
    SOURCE_MULTI: pairs.Corpus(partial(pairs.adapt_multi, source_name=SOURCE_MULTI), {"validation": "train", "test": "test"}),
    SOURCE_IO: pairs.Corpus(partial(pairs.adapt_io, source_name=SOURCE_IO), {"train": "train", "validation": "test"}),
}
CORPUS_KEYS = {SOURCE_TAGGED: ["doc_id"], SOURCE_MULTI: ["conv_id", "turn"], SOURCE_IO: ["item_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(docs: DataFrame) -> DataFrame:
    """Every line wrapped in double quotes (final punctuation stays inside)."""
    return docs.withColumn("text", F.concat(F.lit('"'), F.regexp_replace("text", "\n", '"\n"'), F.lit('"')))


def contracted(docs: DataFrame) -> DataFrame:
    """Adds n't contractions: ' is ' -> ' isn't ', ' the ' -> ' couldn't '."""
    t = F.replace(F.col("text"), F.lit(" is "), F.lit(" isn't "))
    return docs.withColumn("text", F.replace(t, F.lit(" the "), F.lit(" couldn't ")))


def tagged(docs: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """Task-tagged corpus ``_id, task, src, tgt``: command prefix on a keyed half,
    task from the quality label."""
    j = docs.join(labels, "doc_id")
    u = uniform(digest(seed, "tag", F.col("doc_id")))
    return j.select(
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("_id"),
        F.when(F.col("quality") == 1, F.lit("gec")).otherwise(F.lit("paraphrase")).alias("task"),
        F.when(u < 0.5, F.concat(F.lit(TAG_COMMAND), F.col("text"))).otherwise(F.col("text")).alias("src"),
        F.col("text").alias("tgt"),
    )


def multi_reference(conv: DataFrame) -> DataFrame:
    """Multi-reference corpus ``sentence, corrections``: a user turn and the assistant turns that
    follow it before any other role speaks, however many, one row per reply (a user turn without
    one has an empty array). Each reply finds its user turn by a scan of bounded chunks: no
    grouping and no pairing within a conversation."""
    speaks = F.col("role").eqNullSafe("assistant")
    x = conv.select("conv_id", "turn", "role", "text").withColumn("_at", 2 * F.col("turn") + F.when(speaks, 0).otherwise(1))
    x = running_agg(x, ["conv_id"], "_at", F.when(~speaks, F.col("turn")), "max", "_asked")
    a = x.filter(speaks & F.col("text").isNotNull()).select("conv_id", F.col("_asked").alias("turn"), F.col("text").alias("reply"))
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("sentence"))
    keys = ["conv_id", "turn"]
    none = join_null_safe(u, a.select(*keys).distinct(), keys, "left_anti")
    return (join_null_safe(u, a, keys).select(*keys, "sentence", F.array("reply").alias("corrections"))
            .unionByName(none.withColumn("corrections", F.array().cast("array<string>"))))


def io_pairs(bench: DataFrame) -> DataFrame:
    """Input/output pairs: output is the whitespace-normalised input."""
    out = py_strip(F.regexp_replace("text", F.lit("[" + WS_CLASS + "]+"), " "))
    return bench.select("item_id", F.col("text").alias("input"), out.alias("output"))


def stored_split(df: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """The split a row of a derived corpus is stored in: a keyed tenth in the one that serves as test."""
    train, test = CORPORA[name].splits
    u = uniform(digest(seed, "stored", *CORPUS_KEYS[name]))
    return df.withColumn("split", F.when(u < 0.1, F.lit(test)).otherwise(F.lit(train)))


def generated(rows: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Model-output stand-in: trailing spaces on a keyed 60%, a changed text on the rest."""
    u = uniform(digest(seed, "gen", F.col(key)))
    gen = F.when(u < 0.6, F.concat(F.col("corrected"), F.lit("  "))) \
           .otherwise(F.concat(F.lit("~"), F.col("corrected")))
    return rows.withColumn("generated", gen)


def metric_log(events: DataFrame) -> DataFrame:
    """Training/eval metric log: run = user, metric = event type, value."""
    return events.select(F.col("user_id").alias("run_id"), "ts", "event_id",
                         F.col("event_type").alias("metric"), "value")
