"""Dataset statistics and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_distribution(pairs: DataFrame, applied_col: str = "applied") -> DataFrame:
    """How often each error type changed a text."""
    return pairs.select(F.explode(applied_col).alias("error_type")).groupBy("error_type").agg(
        F.count(F.lit(1)).alias("n"))


def errors_per_row(pairs: DataFrame, n_col: str = "n_errors") -> DataFrame:
    """Distribution of the number of counted errors per row."""
    return pairs.groupBy(F.col(n_col).cast("bigint").alias(n_col)).agg(F.count(F.lit(1)).alias("rows"))


def row_digest(cols: list[str]):
    """md5 of the values, each with its length before it; a null is ``-``."""
    def value(c):
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*[value(c) for c in cols]))


def _half_sum(digest, start: int):
    """Sum of 16 hex digits of the digests; 28 + 10 digits hold 10 billion times a billion rows."""
    return F.sum(F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(28,0)")).cast("string")


def dataset_fingerprint(df: DataFrame, group_cols: list[str] = (), cols: list[str] | None = None) -> DataFrame:
    """K6: order-independent identity per group: row count and the sums of both
    halves of the row digests (equal rows add up instead of cancelling out)."""
    cols = cols or [c for c in df.columns if c not in group_cols]
    digest = row_digest(cols)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.concat_ws("-", _half_sum(digest, 1), _half_sum(digest, 17)).alias("fingerprint"),
    )
