"""Skew-safe positions, ordinals and running aggregates.

A window ``PARTITION BY g ORDER BY t`` puts a whole group in one task; with
one group holding a third of the rows that task is the job. Positions are counted
instead: rows are range-partitioned by group and order (the splitters come from a
sample of the rows themselves, so a hot group or one instant spreads over as many
tasks as its rows need), numbered inside their partition, and shifted by the rows of
the group in the partitions before. Running aggregates work inside bounded chunks of
positions and carry the chunk totals, themselves in bounded chunks, level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkpairs.functions.names import free_names
from sparkpairs.session import materialize

RUN_CHUNK = 65536


def join_null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on ``cols`` where null equals null, so rows with a null key stay."""
    names = dict(zip(cols, free_names([left, right], *[f"_r_{c}" for c in cols]), strict=True))
    r = right.select(*[F.col(c).alias(names[c]) if c in cols else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(names[c]))
    joined = left.join(r if how not in ("left_anti", "left_semi") else r.select(*names.values()), on, how)
    return joined.drop(*names.values())


def numbered(df: DataFrame, order: list[Column], out: str, group: list[str] | tuple = (), size: str | None = None,
             partitions: int | None = None) -> DataFrame:
    """``df`` with each row's position (from 0) in ``order`` as ``out``, within its ``group``.

    ``order`` sorts inside a group; add a unique column last where equal rows are many, so that they
    spread as well. ``size``: name for the number of rows of the group. ``df`` is read twice (splitters and
    rows) and written once: an expensive input should be materialised."""
    group = list(group)
    part, at, first, rows, before = free_names(df, "_part", "_at", "_first", "_rows", "_before", taken=(out, size or out))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(g) for g in group] + list(order)
    placed = materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by)
                         .withColumn(part, F.spark_partition_id())
                         .withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy(*group, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(rows))
    w = Window.partitionBy(*(group or [F.lit(0)]))  # one row per partition and group
    counts = counts.select(*group, part, first, (F.sum(rows).over(w.orderBy(part)) - F.col(rows)).alias(before),
                           *([F.sum(rows).over(w).alias(size)] if size else []))
    joined = join_null_safe(placed, counts, [*group, part])
    return joined.select(*df.columns, (F.col(before) + F.col(at) - F.col(first)).cast("bigint").alias(out), *([size] if size else []))


def ordinal_within(df: DataFrame, part_cols: list[str], order_cols: list[str], ordinal_col: str = "ordinal") -> DataFrame:
    """Exact 0-based row number per ``part_cols`` ordered by ``order_cols`` (nulls first)."""
    return numbered(df, [F.asc_nulls_first(c) for c in order_cols], ordinal_col, part_cols)


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _both(fn: str, a: Column, b: Column) -> Column:
    """The aggregate of two parts, either of which may be missing."""
    if fn == "sum":
        return F.coalesce(a + b, a, b)
    return (F.least if fn == "min" else F.greatest)(a, b)


def _scan(df: DataFrame, part: list[str], at: str, value: str, fn: str, out: str, inclusive: bool, chunk: int, most: int) -> DataFrame:
    """Running ``fn`` of ``value`` along ``at`` (from 0 to ``most`` at most), null where nothing came before.

    More than one chunk of rows: a window inside each chunk, and the totals of the chunks before it, which are
    a scan of a table ``chunk`` times smaller."""
    agg = _AGG[fn]
    hi = 0 if inclusive else -1
    if most < chunk:
        w = Window.partitionBy(*(part or [F.lit(0)])).orderBy(at).rowsBetween(Window.unboundedPreceding, hi)
        return df.withColumn(out, agg(value).over(w))
    block, local, total, carry = free_names(df, "_block", "_local", "_total", "_carry", taken=(out,))
    x = df.withColumn(block, F.floor(F.col(at) / chunk).cast("bigint"))
    totals = x.groupBy(*part, block).agg(agg(value).alias(total))
    totals = _scan(totals, part, block, total, fn, carry, False, chunk, most // chunk).drop(total)
    w = Window.partitionBy(*part, block).orderBy(at).rowsBetween(Window.unboundedPreceding, hi)
    joined = join_null_safe(x.withColumn(local, agg(value).over(w)), totals, [*part, block])
    return joined.withColumn(out, _both(fn, F.col(carry), F.col(local))).drop(block, local, carry)


def running_agg(df: DataFrame, part_cols: list[str], ordinal_col: str, value: Column, fn: str,
                out_col: str, inclusive: bool = True, chunk: int | None = None) -> DataFrame:
    """Running ``fn`` (sum/min/max) of ``value`` along ``ordinal_col`` (integers from 0).

    No task holds more than ``chunk`` consecutive ordinals of a group, at any length: the largest ordinal
    decides how many levels of chunk totals there are. ``inclusive=False`` excludes the current row (null
    before the first row). ``df`` is read once per level and once for the largest ordinal."""
    chunk = chunk or RUN_CHUNK
    most = df.agg(F.max(ordinal_col)).first()[0] or 0
    (v,) = free_names(df, "_value")
    out = _scan(df.withColumn(v, value), list(part_cols), ordinal_col, v, fn, out_col, inclusive, chunk, int(most)).drop(v)
    if fn == "sum" and inclusive:
        out = out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0)))
    return out
