"""Sequence-length profile.

Everything after tokenisation works on the length histogram ``(length, cnt)``:
one hash aggregate with map-side combine, whose size is bounded by the number
of distinct lengths (not by the number of rows). Percentiles are exact
(``percentile`` with frequencies, linear interpolation), never approximate.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpairs.functions.constants import (
    DEFAULT_MAX_LENGTH,
    GRID_CAP,
    GRID_START,
    GRID_STEP,
    PACKING_WORTHWHILE,
)
from sparkpairs.functions.text import col_, token_count

HIST_BINS = 50


def tokenizer_length(text, factory: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """Token counts from a user tokenizer, loaded once per Python worker.

    ``factory()`` returns a function mapping a list of texts to their lengths
    (e.g. a batch encoder); it runs on Arrow batches, never per row.
    """
    @F.pandas_udf("bigint")
    def _lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = factory()
        for s in batches:
            yield pd.Series(measure(s.fillna("").tolist()), dtype="int64")

    return _lengths(col_(text))


def token_lengths(df: DataFrame, text_col: str = "text", factory=None, length_col: str = "length") -> DataFrame:
    length = token_count(text_col) if factory is None else tokenizer_length(text_col, factory)
    return df.withColumn(length_col, length)


def length_histogram(df: DataFrame, length_col: str = "length") -> DataFrame:
    """``(length, cnt)``: the only distributed pass over the rows."""
    return df.groupBy(F.col(length_col).cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("cnt"))


def length_summary(hist: DataFrame) -> DataFrame:
    """A5 + A6: n, mean, median, population std, min, max, p95, p99, total tokens."""
    dec = "decimal(38,0)"
    s = hist.agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("length") * F.col("cnt")).alias("s1"),
        F.sum(F.col("cnt").cast(dec) * F.col("length").cast(dec) * F.col("length").cast(dec)).alias("s2"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.percentile("length", [0.5, 0.95, 0.99], F.col("cnt")).alias("q"),
    )
    n = F.col("n")
    var_num = (n.cast(dec) * F.col("s2") - F.col("s1").cast(dec) * F.col("s1").cast(dec)).cast("double")
    return s.select(
        n.alias("n"),
        (F.col("s1") / n).alias("mean"),
        F.col("q")[0].alias("median"),
        F.sqrt(var_num / (n.cast("double") * n.cast("double"))).alias("std"),
        F.col("min_length"), F.col("max_length"),
        F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"),
        F.col("s1").alias("total_tokens"),
    )


def length_bins(hist: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """A10: equal-width bins between min and max (last bin closed), all bins listed."""
    mn = hist.select(F.min("length")).scalar()   # scalar sub-queries over the small histogram
    mx = hist.select(F.max("length")).scalar()
    raw = F.floor((F.col("length") - mn) * F.lit(float(bins)) / (mx - mn)) + 1
    b = F.when(mx == mn, F.lit(1)).otherwise(F.least(raw, F.lit(bins))).cast("int")
    counted = hist.groupBy(b.alias("bin")).agg(F.sum("cnt").alias("cnt"))
    spark = hist.sparkSession
    all_bins = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (mx - mn).cast("double") / F.lit(float(bins))
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        (mn + (F.col("bin") - 1) * width).alias("bin_lo"),
        (mn + F.col("bin") * width).alias("bin_hi"),
        F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("cnt"),
    )


def length_boxplot(hist: DataFrame, whis: float = 1.5) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers (most extreme data inside the fences), outlier count."""
    qs = hist.agg(F.percentile("length", [0.25, 0.5, 0.75], F.col("cnt"))).scalar()
    q1, med, q3 = qs[0], qs[1], qs[2]
    lo = q1 - whis * (q3 - q1)
    hi = q3 + whis * (q3 - q1)
    j = hist.select("length", "cnt", q1.alias("q1"), med.alias("median"), q3.alias("q3"))
    return j.groupBy("q1", "median", "q3").agg(
        F.min(F.when(F.col("length") >= lo, F.col("length"))).alias("whisker_lo"),
        F.max(F.when(F.col("length") <= hi, F.col("length"))).alias("whisker_hi"),
        F.sum(F.when((F.col("length") < lo) | (F.col("length") > hi), F.col("cnt")).otherwise(0)).alias("n_outliers"),
    ).select("q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "whisker_lo", "whisker_hi",
             F.col("n_outliers").cast("bigint"))


def max_length_grid(hist: DataFrame, configured: int = DEFAULT_MAX_LENGTH) -> DataFrame:
    """``range(512, min(max+512, 8192), 256)`` plus the configured value, unique.

    At most (8192-512)/256 + 1 = 31 rows, whatever the data size.
    """
    mx = F.max("length")
    # least() skips nulls: with no lengths the range must be empty, not the full grid
    stop = F.when(mx.isNull(), F.lit(GRID_START)).otherwise(F.least(mx + GRID_START, F.lit(GRID_CAP)))
    seq = F.when(stop > GRID_START, F.sequence(F.lit(GRID_START).cast("bigint"), stop - 1, F.lit(GRID_STEP).cast("bigint"))) \
           .otherwise(F.array().cast("array<bigint>"))
    g = hist.agg(F.array_distinct(F.concat(seq, F.array(F.lit(configured).cast("bigint")))).alias("g"))
    return g.select(F.explode("g").alias("max_len"))


def truncation_curve(hist: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """A7 (J3): per max_len, truncated tokens/samples and their percentages.

    The grid (at most 31 rows) is broadcast into a range join ``length > max_len``
    against the histogram; no row-level data is touched here.
    """
    grid = grid if grid is not None else max_length_grid(hist)
    n = hist.select(F.sum("cnt")).scalar()
    total_tokens = hist.select(F.sum(F.col("length") * F.col("cnt"))).scalar()
    over = hist.join(F.broadcast(grid), F.col("length") > F.col("max_len")).groupBy("max_len").agg(
        F.sum(F.col("cnt") * (F.col("length") - F.col("max_len"))).alias("tt"),
        F.sum("cnt").alias("ts"))
    curve = grid.join(over, "max_len", "left")
    tt = F.coalesce(F.col("tt"), F.lit(0)).cast("bigint")
    ts = F.coalesce(F.col("ts"), F.lit(0)).cast("bigint")
    return curve.select(
        "max_len",
        tt.alias("truncated_tokens"),
        ts.alias("truncated_samples"),
        F.try_divide(tt * F.lit(100.0), total_tokens).alias("truncation_percentage"),
        F.try_divide(ts * F.lit(100.0), n).alias("samples_affected_percentage"),
    )


def optimal_max_length(curve: DataFrame, thresholds=(1.0, 5.0)) -> DataFrame:
    """Smallest max_len with token truncation <= threshold, else the largest."""
    aggs = []
    for th in thresholds:
        name = f"optimal_{str(th).rstrip('0').rstrip('.').replace('.', '_')}pct"
        aggs.append(F.coalesce(F.min(F.when(F.col("truncation_percentage") <= th, F.col("max_len"))),
                               F.max("max_len")).alias(name))
    return curve.agg(*aggs)


def packing_report(hist: DataFrame, grid: DataFrame) -> DataFrame:
    """A8 + A9 at every length of ``grid`` (column ``max_len``, a few dozen rows): ascending next-fit packing.

    One fold over the runs of equal lengths, with one state per grid length. Lengths above the largest grid
    length are packed like it, so the array has at most that many runs, whatever the rows; a run is packed
    by division, not row by row."""
    sizes = grid.select(F.array_sort(F.collect_set(F.col("max_len").cast("bigint")))).scalar()
    largest = grid.select(F.max("max_len")).scalar()
    clipped = hist.groupBy(F.least(F.col("length"), largest).cast("bigint").alias("l")).agg(F.sum("cnt").alias("c"))
    one = clipped.agg(F.array_sort(F.collect_list(F.struct("l", "c"))).alias("runs")).withColumn("sizes", sizes)
    zero = F.lit(0).cast("bigint")

    def state(m, n, tokens, packed, cur):
        return F.struct(m.alias("m"), n.alias("n"), tokens.alias("tokens"), packed.alias("packed"), cur.alias("cur"))

    def step(states, run):
        def pack(s):
            m, cur, c = s["m"], s["cur"], run["c"]
            l = F.least(run["l"], m)
            n, tokens = s["n"] + c, s["tokens"] + l * c
            k0 = F.floor((m - cur) / l)  # that still fit into the open sequence
            per = F.floor(m / l)
            left = c - k0
            more = F.ceil(left / per)
            return F.when(l <= 0, state(m, n, tokens, s["packed"], cur)) \
                .when(c <= k0, state(m, n, tokens, s["packed"], cur + c * l)) \
                .otherwise(state(m, n, tokens, (s["packed"] + more).cast("bigint"), ((left - (more - 1) * per) * l).cast("bigint")))
        return F.transform(states, pack)

    init = F.transform("sizes", lambda m: state(m, zero, zero, zero, zero))
    s = one.select(F.explode(F.aggregate("runs", init, step)).alias("s")).select("s.*")
    packed = F.col("packed") + (F.col("cur") > 0).cast("bigint")
    tokens = F.col("tokens").cast("double")
    without = F.try_divide(tokens, F.col("n") * F.col("m"))
    with_ = F.try_divide(tokens, packed * F.col("m"))
    return s.select(
        F.col("m").alias("max_length"),
        without.alias("without_packing"),
        with_.alias("with_packing"),
        F.try_divide(with_, without).alias("improvement"),
        F.col("n").cast("bigint").alias("sequences_without_packing"),
        packed.alias("sequences_with_packing"),
        (F.lit(1.0) - F.try_divide(packed.cast("double"), F.col("n"))).alias("memory_savings"),
    )


def packing_efficiency(hist: DataFrame, max_length: int = DEFAULT_MAX_LENGTH) -> DataFrame:
    """A8 + A9 at one length."""
    return packing_report(hist, hist.sparkSession.range(1).select(F.lit(int(max_length)).alias("max_len")))


def packing_at_advised_lengths(hist: DataFrame, configured: int = DEFAULT_MAX_LENGTH) -> DataFrame:
    """A8 + A9 at the configured length and at those that truncate at most 1 % and 5 % of the tokens:
    a row per distinct length, with flags for what it is."""
    grid = max_length_grid(hist, configured)
    opt = optimal_max_length(truncation_curve(hist, grid))
    uses = opt.select(F.explode(F.array(
        F.struct(F.lit(configured).cast("bigint").alias("max_len"), F.lit("configured").alias("use")),
        F.struct(F.col("optimal_1pct").cast("bigint").alias("max_len"), F.lit("1pct").alias("use")),
        F.struct(F.col("optimal_5pct").cast("bigint").alias("max_len"), F.lit("5pct").alias("use")))).alias("u")).select("u.*")
    lengths = uses.groupBy("max_len").agg(*[F.max(F.col("use") == u).alias(f"is_{u}") for u in ("configured", "1pct", "5pct")])
    return packing_report(hist, lengths).join(F.broadcast(lengths), F.col("max_length") == F.col("max_len")).drop("max_len")


def length_advice(hist: DataFrame, configured: int = DEFAULT_MAX_LENGTH) -> DataFrame:
    """Keep / change / choose, the length to use (the balanced one, unless the configured
    one already meets either goal), and whether packing is worthwhile (> 1.2x)."""
    opt = optimal_max_length(truncation_curve(hist, max_length_grid(hist, configured)))
    improvement = packing_efficiency(hist, configured).select("improvement").scalar()
    j = opt.withColumn("improvement", improvement)
    o1, o5 = F.col("optimal_1pct"), F.col("optimal_5pct")
    rec = F.when(o1 == o5, F.when(o5 != configured, F.lit("change")).otherwise(F.lit("keep"))).otherwise(F.lit("choose"))
    return j.select(
        F.lit(configured).alias("current_max_length"),
        o1.alias("conservative_max_length"),
        o5.alias("balanced_max_length"),
        rec.alias("recommendation"),
        F.when(o1 == configured, o1).otherwise(o5).alias("recommended_max_length"),
        F.col("improvement").alias("packing_improvement"),
        (F.col("improvement") > PACKING_WORTHWHILE).alias("packing_recommended"),
    )
