"""Shuffles, exact-size splits, subsamples and samples.

A global permutation is ``ORDER BY md5(seed:key), key``. Exact positions in it
are computed without an unpartitioned window or a sort into one task, and text is
moved once:

1. the rows are materialised with their digest, so the input (however expensive
   upstream) is computed once;
2. digest prefixes are counted (a table of bounded size: ``16**PREFIX_HEX`` rows per
   partition value) and laid out over the tasks in the order of the permutation;
3. each row goes to the task of its prefix, is sorted there, and its position is the
   task's first position plus its place in the task.

A prefix that holds far more than a task's share (a group of copies) cannot be laid
out; then the rows are range-partitioned by digest and row number, which cuts copies too.

Splits, subsamples and samples need only the first rows of that order. They
find the digest at the cut by counting digest prefixes and then keep rows by a
predicate on their own digest: no row is moved, sorted or checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkpairs.functions.names import free_names
from sparkpairs.functions.rand import digest
from sparkpairs.operators.ordering import join_null_safe, numbered
from sparkpairs.session import materialize, plan_barrier

PREFIX_HEX = 4               # 65,536 prefixes per partition value
BROADCAST_PREFIXES = 1 << 20  # rows of the layout that are broadcast; beyond, it is joined by its keys
HOT_SHARE = 4                # a prefix of more than so many shares of a task is cut by row numbers
CUT_LEVELS = (4, 8, 32)      # digest prefixes counted in turn; the last is the whole digest
CUT_ROWS = 16 ** CUT_LEVELS[0]  # a prefix with no more rows goes straight to whole digests
MAX_CUTS = 64                # partition values whose cuts become plan literals; beyond, rows are ranked


def shuffle_key(df: DataFrame, seed: int, key_cols: list[str]) -> Column:
    return digest(seed, None, *key_cols)


def shuffle_rank(df: DataFrame, seed: int = 42, key_cols: list[str] | None = None,
                 partition_cols: list[str] | tuple = (), rank_col: str = "rank",
                 size_col: str | None = None, hot_share: float = HOT_SHARE) -> DataFrame:
    """O1: add the 0-based position of every row in the seeded permutation.

    ``partition_cols`` ranks independently per value (e.g. per split). ``size_col`` optionally adds the
    partition's row count. The rows come out in order: by partition value and position, from task to task."""
    cols = df.columns
    part = list(partition_cols)
    keys = list(key_cols) if key_cols else [c for c in cols if c not in part]
    rest = [c for c in cols if c not in part and c not in keys]  # rows of equal keys keep one order in every run
    h, prefix, count, before, n, first, task, at, all_before = free_names(
        df, "_digest", "_prefix", "_count", "_before", "_n", "_first", "_task", "_at", "_all",
        taken=(rank_col, size_col or rank_col))
    size = size_col or n
    rows = materialize(df.withColumn(h, shuffle_key(df, seed, keys)))
    counts = materialize(rows.groupBy(*part, F.substring(h, 1, PREFIX_HEX).alias(prefix)).agg(F.count(F.lit(1)).alias(count)))
    prefixes, most, total = counts.agg(F.count(F.lit(1)), F.max(count), F.sum(count)).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, -(-(total or 0) // tasks))
    by_key = [F.asc_nulls_first(h), *[F.asc_nulls_first(c) for c in keys + rest]]
    keep = [*cols, rank_col, *([size_col] if size_col else [])]
    if (most or 0) > hot_share * share + 1:
        row_no = F.monotonically_increasing_id()
        (salt,) = free_names(rows, "_row")
        cut = numbered(rows.withColumn(salt, row_no), [F.asc(h), F.asc(salt)], rank_col, part, size)
        return cut.select(*keep)
    w = Window.partitionBy(*(part or [F.lit(0)]))
    layout = counts.select(*part, prefix, count, (F.sum(count).over(w.orderBy(prefix)) - F.col(count)).alias(before),
                           F.sum(count).over(w).alias(size))
    if part:  # partition values follow each other: one row per value
        values = counts.groupBy(*part).agg(F.sum(count).alias(count))
        so_far = F.sum(count).over(Window.orderBy(*[F.asc_nulls_first(c) for c in part]))
        layout = join_null_safe(layout, values.select(*part, (so_far - F.col(count)).alias(all_before)), part)
    else:
        layout = layout.withColumn(all_before, F.lit(0).cast("bigint"))
    start = F.col(all_before) + F.col(before)
    layout = layout.withColumn(task, F.least(F.floor(start / share), F.lit(tasks - 1)).cast("int"))
    layout = layout.select(*part, prefix, task, (F.min(start).over(Window.partitionBy(task)) - F.col(all_before)).alias(first), size)
    if prefixes <= BROADCAST_PREFIXES:
        layout = F.broadcast(layout)
    placed = join_null_safe(rows.withColumn(prefix, F.substring(h, 1, PREFIX_HEX)), layout, [*part, prefix])
    ordered = (placed.repartitionById(tasks, F.col(task)).sortWithinPartitions(*[F.asc_nulls_first(c) for c in part], *by_key)
               .withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    return ordered.withColumn(rank_col, (F.col(first) + F.col(at)).cast("bigint")).select(*keep)


def _same(part: list[str], values: list) -> Column:
    on = F.lit(True)
    for c, v in zip(part, values, strict=True):
        on = on & F.col(c).eqNullSafe(F.lit(v))
    return on


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _per_part(part: list[str], rows: list[dict], value: Callable[[dict], Column], default: Column) -> Column:
    out = default
    for r in rows:
        out = F.when(_same(part, r["part"]), value(r)).otherwise(out)
    return out


def _cuts(digests: DataFrame, part: list[str], h: str, first: Callable[[Column], Column]) -> list[dict] | None:
    """Per partition value (``part``, a list) the digest ``p`` at position ``first(n)`` of the order, its ``copies``
    and how many of them lie before the position (``left``). Values that are kept whole have none; ``None`` beyond
    MAX_CUTS values.

    Each level counts digest prefixes (map-side combined) inside the prefix found before it; at most
    ``16**4`` of them per value reach the prefix sum, whatever the number of rows.
    """
    names = [f"k{i}" for i in range(len(part))]
    x = digests.select(*[F.col(c).alias(k) for c, k in zip(part, names, strict=True)], F.col(h).alias("h"))
    w = Window.partitionBy(*(names or [F.lit(0)]))
    cuts: list[dict] = []
    for level, length in enumerate(CUT_LEVELS):
        inside = x
        if level:
            if length < CUT_LEVELS[-1] and max(r["copies"] for r in cuts) <= CUT_ROWS:
                continue
            inside = x.filter(_any([_same(names, r["part"]) & F.col("h").startswith(r["p"]) for r in cuts]))
        counts = inside.groupBy(*names, F.substring("h", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("copies")).select(
            "*", F.sum("copies").over(w).alias("n"), (F.sum("copies").over(w.orderBy("p")) - F.col("copies")).alias("before"))
        k = first(F.col("n")) if level == 0 else _per_part(names, cuts, lambda r: F.lit(r["left"]), F.lit(None))
        at = counts.withColumn("left", k.cast("bigint") - F.col("before")).filter("left >= 0 AND left < copies")
        found = at.limit(MAX_CUTS + 1).collect()
        if len(found) > MAX_CUTS:
            return None
        cuts = [{"part": [r[k] for k in names], "p": r["p"], "copies": r["copies"], "left": r["left"]} for r in found]
        if not cuts:
            return []
    return cuts


def mark_first(df: DataFrame, first: Callable[[Column], Column], seed: int = 42, key_cols: list[str] | None = None,
               partition_cols: list[str] | tuple = (), flag_col: str = "first") -> DataFrame:
    """Add whether a row is among the first ``first(n)`` of its partition's ``n`` rows in the seeded permutation.

    Rows keep their place: the flag is a comparison of the row's digest with the digest at the cut. Only when the
    cut falls inside a group of rows with one digest are the rows of that group ranked.
    """
    part = list(partition_cols)
    keys = list(key_cols) if key_cols else [c for c in df.columns if c not in part]
    h, rank, n = free_names(df, "_digest", "_rank", "_n", taken=(flag_col,))
    x = df.withColumn(h, shuffle_key(df, seed, keys))
    cuts = _cuts(x, part, h, first)
    if cuts is None:
        ranked = shuffle_rank(df, seed, keys, part, rank_col=rank, size_col=n)
        return ranked.withColumn(flag_col, F.col(rank) < first(F.col(n))).drop(rank, n)
    out = x.withColumn(flag_col, _per_part(part, cuts, lambda r: F.col(h) < r["p"], F.lit(True)))
    tied = [r for r in cuts if r["left"] > 0]
    if not tied:
        return out.drop(h)
    at_cut = _any([_same(part, r["part"]) & (F.col(h) == r["p"]) for r in tied])
    group = shuffle_rank(x.filter(at_cut).drop(h), seed, keys, part, rank_col=rank)
    group = group.withColumn(flag_col, F.col(rank) < _per_part(part, tied, lambda r: F.lit(r["left"]), F.lit(0)))
    return plan_barrier(out.filter(~at_cut).drop(h).unionByName(group.drop(rank)), "cut")


def _first(df: DataFrame, first: Callable[[Column], Column], seed: int, keys: list[str], part: list[str] = ()) -> DataFrame:
    (flag,) = free_names(df, "_first")
    return mark_first(df, first, seed, keys, part, flag).filter(flag).drop(flag)


def train_test_split(df: DataFrame, test_size: float = 0.1, seed: int = 42,
                     key_cols: list[str] | None = None, split_col: str = "split") -> DataFrame:
    """First ``ceil(test_size * n)`` rows of the permutation are ``test``."""
    (flag,) = free_names(df, "_first")
    marked = mark_first(df, lambda n: F.ceil(F.lit(float(test_size)) * n), seed, key_cols, flag_col=flag)
    return marked.withColumn(split_col, F.when(F.col(flag), "test").otherwise("train")).drop(flag)


def subsample(df: DataFrame, fraction: float, seed: int = 42, key_cols: list[str] | None = None,
              split_col: str | None = "split") -> DataFrame:
    """O2: exactly ``ceil(fraction * n)`` rows per split (per whole table if no split), with their ``rank``.

    Only the kept rows are ranked; being the first of the order, they have the ranks of the whole table."""
    if not 0 < fraction <= 1:
        raise ValueError(f"a share of the rows to keep lies above 0 and is at most 1, not {fraction}")
    part = [split_col] if split_col and split_col in df.columns else []
    keys = key_cols or [c for c in df.columns if c not in part and c != "rank"]
    kept = _first(df.drop("rank"), lambda n: F.ceil(F.lit(float(fraction)) * n), seed, keys, part)
    return shuffle_rank(kept, seed, keys, part)


def sample_n(df: DataFrame, n: int, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """O3: ``n`` rows without replacement (all rows when n >= count)."""
    return _first(df, lambda _: F.lit(int(n)), seed, key_cols or list(df.columns))


def pick_position(df: DataFrame, position: int = 10, seed: int = 42,
                  key_cols: list[str] | None = None) -> DataFrame:
    """The row at ``min(position, n-1)`` of the permutation."""
    keys = key_cols or list(df.columns)
    (n,) = free_names(df, "_n")
    ranked = shuffle_rank(_first(df, lambda _: F.lit(int(position) + 1), seed, keys), seed, keys, size_col=n)
    return ranked.filter(F.col("rank") == F.col(n) - 1).drop(n)


def first_n(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """Stable ``split[:n]`` slice by an explicit order."""
    return df.orderBy(*order_cols).limit(n)
