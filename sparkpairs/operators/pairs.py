"""Adapters, union and source selection for ``(source, original, corrected)`` pairs
(S7-S10, U1-U3, P1-P5, F7, F8, J4, A1, A2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sparkpairs.functions.text import remove_command

PAIR_COLS = ["source", "original", "corrected"]


def adapt_clean(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``text`` becomes both sides; an existing pair table passes through.

    The decision is made on the schema at plan time, never on rows.
    """
    cols = set(df.columns)
    if "text" in cols:
        return df.select(*keep, "source", F.col("text").alias("original"), F.col("text").alias("corrected"))
    if {"original", "corrected"} <= cols:
        return df.select(*keep, *PAIR_COLS)
    raise ValueError("clean dataset must have either 'text' or both 'original' and 'corrected' columns")


def adapt_tagged(df: DataFrame, source_name: str, task: str = "gec", keep: list[str] = ()) -> DataFrame:
    """Keep one task, strip the leading command from the source side only."""
    return df.filter(F.col("task") == task).select(
        *keep,
        F.lit(source_name).alias("source"),
        remove_command("src").alias("original"),
        F.col("tgt").alias("corrected"),
    )


def adapt_multi(df: DataFrame, source_name: str, keep: list[str] = ()) -> DataFrame:
    """S8 + F8: one row per reference correction; a scalar is a one-element list."""
    corr = F.col("corrections")
    if not isinstance(df.schema["corrections"].dataType, ArrayType):
        corr = F.array(corr)
    return df.select(*keep, F.lit(source_name).alias("source"), F.col("sentence").alias("original"),
                     F.explode(corr).alias("corrected"))


def adapt_io(df: DataFrame, source_name: str, keep: list[str] = ()) -> DataFrame:
    """``input``/``output`` renamed, constant source."""
    return df.select(*keep, F.lit(source_name).alias("source"), F.col("input").alias("original"),
                     F.col("output").alias("corrected"))


def merge_pairs(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL in list order, projected to the three pair columns."""
    out = None
    for f in frames:
        f = f.select(*PAIR_COLS)
        out = f if out is None else out.unionByName(f)
    return out


@dataclass(frozen=True)
class Corpus:
    """A corpus known by name: ``adapt(df, keep=...)`` makes pairs of it, ``splits`` maps the splits it is stored
    with to the ones they serve as (a corpus without a test split lends its validation split)."""

    adapt: Callable[..., DataFrame]
    splits: dict[str, str]


def load_corpora(names: list[str], corpora: dict[str, Corpus], read: Callable[[str], DataFrame],
                 split_col: str = "split") -> DataFrame:
    """U1 by name: ``split`` and the pair columns of the named corpora, in one table.

    ``read(name)`` gives the stored rows with ``split_col``; stored splits that are not mapped are left out by a plain
    membership test on that column. Unknown names raise before anything is read."""
    unknown = [n for n in names if n not in corpora]
    if unknown or not names:
        raise ValueError(f"no such corpus: {', '.join(unknown) or '(none named)'}; known: {', '.join(sorted(corpora))}")
    out = None
    for name in names:
        c = corpora[name]
        stored = read(name)
        stored = stored.filter(F.col(split_col).isin(list(c.splits)))
        serves = F.create_map(*[F.lit(x) for pair in c.splits.items() for x in pair])[F.col(split_col)]
        f = c.adapt(stored, keep=[split_col]).select(serves.alias("split"), *PAIR_COLS)
        out = f if out is None else out.unionByName(f)
    return out


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    """A1: row counts per group."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def distinct_sources(df: DataFrame) -> DataFrame:
    """A2 / U3."""
    return df.select("source").distinct()


def requested_frame(spark, sources: list[str]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "source string")


def unknown_sources(df: DataFrame, sources: list[str]) -> DataFrame:
    """Requested names that do not occur (anti join)."""
    req = requested_frame(df.sparkSession, sources)
    return req.join(distinct_sources(df), "source", "left_anti")


def filter_by_source(df: DataFrame, sources: list[str]) -> DataFrame:
    """Keep requested sources; unknown names are ignored, and an empty or
    all-unknown request keeps the whole dataset.

    The request list is bounded by the caller. Whether any requested name exists
    is decided once, by a job that stops at the first match; the filter that
    remains is a plain membership test, which reaches the scan.
    """
    if not sources:
        return df
    wanted = df.filter(F.col("source").isin(list(dict.fromkeys(sources))))
    return df if wanted.isEmpty() else wanted
