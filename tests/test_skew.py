"""Hot groups: one run holding most of the log must give the same ordinals and
running aggregates as a direct scan, with the work split into buckets."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkpairs.operators import ordering, runs


def hot_log(spark, n_hot=400, n_cold=20):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = []
    eid = 0
    for run, n in [(1, n_hot), (2, n_cold), (3, n_cold)]:
        for i in range(n):
            rows.append((run, base + dt.timedelta(seconds=17 * i + run), eid, "eval_loss", rng.random()))
            eid += 1
    return spark.createDataFrame(rows, "run_id long, ts timestamp, event_id long, metric string, value double"), rows


def test_ordinals_in_hot_group(spark):
    df, rows = hot_log(spark)
    got = {(r.run_id, r.event_id): r.ordinal for r in ordering.ordinal_within(df, ["run_id"], ["ts", "event_id"]).collect()}
    for run in (1, 2, 3):
        evs = sorted((ts, e) for r, ts, e, _, _ in rows if r == run)
        assert [got[(run, e)] for _, e in evs] == list(range(len(evs)))


def test_one_instant_spreads_over_tasks(spark):
    """All reports of one run at one time: the tie key cuts them into tasks of about equal size."""
    df = spark.range(20_000).select(F.lit(1).alias("run"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id").alias("event"),
                                    F.lit("x").alias("_part"))
    got = ordering.numbered(df, [F.asc("ts"), F.asc("event")], "n", ["run"], "size", partitions=8)
    assert got.where("n = event AND size = 20000 AND _part = 'x'").count() == 20_000
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1
    placed = df.repartitionByRange(8, "run", "ts", "event").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) == 8 and max(r["count"] for r in placed) < 2 * 20_000 / 8


def test_running_agg_of_many_levels(spark):
    """Chunk totals are scanned in chunks themselves: three levels of four."""
    rows = [(g, i, (i * 7919) % 101 if i % 5 else None) for g in (None, "a") for i in range(150)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(3)
    for fn, op in (("min", min), ("max", max), ("sum", sum)):
        for inclusive in (True, False):
            got = {(r.g, r.o): r.m for r in ordering.running_agg(df, ["g"], "o", F.col("v"), fn, "m", inclusive, chunk=4).collect()}
            for g in (None, "a"):
                for i in range(150):
                    seen = [v for h, o, v in rows if h == g and v is not None and (o <= i if inclusive else o < i)]
                    want = op(seen) if seen else (0 if fn == "sum" and inclusive else None)
                    assert got[g, i] == want, (fn, inclusive, g, i)
    plan = ordering.running_agg(df, [], "o", F.col("v"), "sum", "m", chunk=4)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan


def test_history_arrays_are_bounded(spark):
    df, rows = hot_log(spark, n_hot=95)
    got = runs.metric_history_arrays(df, chunk=40).orderBy("run_id", "first_step").collect()
    assert [(r.run_id, r.first_step, len(r["values"])) for r in got] == [(1, 0, 40), (1, 40, 40), (1, 80, 15), (2, 0, 20), (3, 0, 20)]
    assert [v for r in got if r.run_id == 1 for v in r["values"]] == [v for g, _, _, _, v in rows if g == 1]


def test_running_min_across_chunks(spark):
    df, rows = hot_log(spark)
    steps = runs.with_steps(df)
    out = ordering.running_agg(steps, ["run_id"], "step", F.col("value"), "min", "m", inclusive=True, chunk=16)
    got = {(r.run_id, r.step): r.m for r in out.collect()}
    for run in (1, 2, 3):
        vals = [v for r, _, _, _, v in rows if r == run]
        for i in range(len(vals)):
            assert got[(run, i)] == min(vals[: i + 1])


def test_early_stop_hot_run_matches_loop(spark):
    df, rows = hot_log(spark, n_hot=300)
    got = {r.run_id: r.stop_step for r in runs.early_stopping(df, patience=3).collect()}
    for run in (1, 2, 3):
        vals = [v for r, _, _, _, v in rows if r == run]
        best, counter, stop = None, 0, None
        for i, v in enumerate(vals):
            if best is None or v < best:
                best, counter = v, 0
            else:
                counter += 1
            if counter >= 3 and stop is None:
                stop = i
        assert got[run] == stop


def test_tune_for_input(spark):
    from sparkpairs.session import tune_for_input
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = tune_for_input(spark, 100 * (1 << 40))
        assert int(conf["spark.sql.shuffle.partitions"]) == 409600
        small = tune_for_input(spark, 1 << 20)
        assert int(small["spark.sql.shuffle.partitions"]) == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
