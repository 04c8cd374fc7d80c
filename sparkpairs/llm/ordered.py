"""Global positions in a stated order, without a window over the whole table.

Rows are range-partitioned by the order and sorted inside their partition; a row's
position is its place there plus the rows of the partitions before it. Only one row per
partition (and group) is summed, so a hot group or a table of equal keys spreads like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkpairs.llm.common import free_name
from sparkpairs.session import materialize


def numbered(df: DataFrame, order: list[Column], out: str, group: str | None = None, size: str | None = None) -> DataFrame:
    """``df`` with the row's position (from 0) in ``order`` as ``out``, within its ``group`` if one is named.

    ``order`` starts with the group's column. ``size``: name for the number of rows of the group. ``df`` is
    read twice (bounds, rows): it should be narrow and materialised. Rows that ``order`` leaves equal follow each other."""
    spark = df.sparkSession
    taken = df
    names = []
    for base in ("_part", "_at", "_first", "_rows", "_before"):
        names.append(free_name(taken, base))
    part, at, first, rows, before = names
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn(part, F.spark_partition_id())
                         .withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    keys = [part] + ([group] if group else [])
    counts = placed.groupBy(*keys).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(rows))
    w = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(part)
    whole = Window.partitionBy(*([group] if group else [F.lit(0)]))
    counts = counts.withColumn(before, F.sum(rows).over(w) - F.col(rows))
    if size:
        counts = counts.withColumn(size, F.sum(rows).over(whole))
    names_ = {k: free_name(placed, f"_k{i}") for i, k in enumerate(keys)}
    counts = counts.select(*[F.col(k).alias(v) for k, v in names_.items()], first, before, *([size] if size else []))
    on = F.lit(True)
    for k, v in names_.items():
        on = on & F.col(k).eqNullSafe(F.col(v))
    joined = placed.join(counts, on).withColumn(out, F.col(before) + F.col(at) - F.col(first))
    return joined.select(*df.columns, out, *([size] if size else []))
