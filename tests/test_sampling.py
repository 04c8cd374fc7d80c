"""Exact sizes, partition independence and duplicate handling of the ranks."""

import math

from pyspark.sql import functions as F

from sparkpairs.operators import sampling


def frame(spark, n, parts=4, copies=None):
    rows = [(i % copies if copies else i, f"t{i % copies if copies else i}") for i in range(n)]
    return spark.createDataFrame(rows, "k long, t string").repartition(parts)


def test_ranks_are_a_permutation(spark):
    r = sampling.shuffle_rank(frame(spark, 500), 42, ["k"]).select("rank").collect()
    assert sorted(x.rank for x in r) == list(range(500))


def test_partition_independent(spark):
    a = {(x.k, x.rank) for x in sampling.shuffle_rank(frame(spark, 300, 1), 7, ["k"]).collect()}
    b = {(x.k, x.rank) for x in sampling.shuffle_rank(frame(spark, 300, 8), 7, ["k"]).collect()}
    assert a == b


def test_matches_sort_by_digest(spark):
    df = frame(spark, 200)
    ranked = {x.k: x.rank for x in sampling.shuffle_rank(df, 3, ["k"]).collect()}
    order = df.withColumn("h", sampling.shuffle_key(df, 3, ["k"])).orderBy("h", "k").select("k").collect()
    assert [ranked[x.k] for x in order] == list(range(200))


def test_copies_rank_exactly(spark):
    df = frame(spark, 400, copies=3)                # three rows, ~133 copies each: laid out, or cut by row numbers
    for hot_share in (0.1, 100):
        r = sampling.shuffle_rank(df, 42, hot_share=hot_share).collect()
        assert sorted(x.rank for x in r) == list(range(400))
        assert sorted(x.k for x in r) == sorted(i % 3 for i in range(400))
        assert len({x.k for x in r if x.rank < 133}) <= 2  # copies follow each other


def test_ranks_per_value_with_null_values(spark):
    df = frame(spark, 600).withColumn("split", F.when(F.col("k") < 400, "a").when(F.col("k") < 500, "b"))
    for hot_share in (0.01, 100):
        out = sampling.shuffle_rank(df, 1, ["k"], ["split"], size_col="n", hot_share=hot_share).collect()
        for v, n in (("a", 400), ("b", 100), (None, 100)):
            assert sorted(r.rank for r in out if r.split == v) == list(range(n)) and {r.n for r in out if r.split == v} == {n}


def test_rows_come_out_in_order(spark):
    df = frame(spark, 900).withColumn("split", F.when(F.col("k") < 400, "a").otherwise("b"))
    out = sampling.shuffle_rank(df, 1, ["k"], ["split"]).withColumn("p", F.spark_partition_id()).collect()  # collected task by task
    assert [(r.split, r.rank) for r in out] == sorted((r.split, r.rank) for r in out) and len({r.p for r in out}) > 1


def test_text_is_moved_once(spark, tmp_out):
    frame(spark, 1000).write.parquet(f"{tmp_out}/rows")
    out = sampling.shuffle_rank(spark.read.parquet(f"{tmp_out}/rows"), 1, ["k"])
    out.count()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x and "Reused" not in x]
    assert len([x for x in moved if "REPARTITION_BY_NUM" in x]) == 1


def test_helper_columns_take_free_names(spark):
    taken = ["_h", "_b", "_c", "_ls", "_i", "_n", "_off", "_first", "_rank", "_digest", "_prefix", "_count", "_before", "_task", "_at", "_all",
             "_part", "_rows", "_row", "h", "p", "k0", "copies", "left", "n"]
    df = frame(spark, 60, copies=20).select("*", *[F.lit(i).alias(c) for i, c in enumerate(taken)])
    for out in (sampling.sample_n(df, 7, 1, ["k"]), sampling.pick_position(df, 3, 1, ["k"]).drop("rank"), sampling.subsample(df, 0.5, 1, ["k"]).drop("rank"),
                sampling.train_test_split(df, 0.1, 1, ["k"]).drop("split"), sampling.shuffle_rank(df, 1, ["k"], size_col="size").drop("rank", "size"),
                sampling.shuffle_rank(df, 1, ["k"], hot_share=0).drop("rank")):
        assert out.columns == df.columns
        assert {tuple(r[c] for c in taken) for r in out.collect()} == {tuple(range(len(taken)))}


def test_train_test_split_exact(spark):
    out = sampling.train_test_split(frame(spark, 1001), 0.1, 42, ["k"]).groupBy("split").count().collect()
    sizes = {x.split: x["count"] for x in out}
    assert sizes["test"] == math.ceil(0.1 * 1001) and sizes["train"] == 1001 - sizes["test"]


def test_subsample_per_split(spark):
    df = frame(spark, 300).withColumn("split", F.when(F.col("k") < 100, "test").otherwise("train"))
    out = sampling.subsample(df, 0.05, 42, ["k"], "split").groupBy("split").count().collect()
    assert {x.split: x["count"] for x in out} == {"test": 5, "train": 10}


def test_subsample_rejects_bad_fraction(spark):
    import pytest
    with pytest.raises(ValueError):
        sampling.subsample(frame(spark, 10), 0.0)


def test_sample_n(spark):
    df = frame(spark, 100)
    assert sampling.sample_n(df, 10, 1, ["k"]).count() == 10
    assert sampling.sample_n(df, 1000, 1, ["k"]).count() == 100
    big = sampling.sample_n(df, 50, 1, ["k"]).select("k").collect()
    ranked = sampling.shuffle_rank(df, 1, ["k"]).filter("rank < 50").select("k").collect()
    assert {x.k for x in big} == {x.k for x in ranked}


def test_pick_position(spark):
    assert sampling.pick_position(frame(spark, 5), 10, 42, ["k"]).first().rank == 4
    assert sampling.pick_position(frame(spark, 50), 10, 42, ["k"]).first().rank == 10


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k long, t string")
    assert sampling.shuffle_rank(empty, 1, ["k"]).count() == 0
    assert sampling.train_test_split(empty, 0.1, 1, ["k"]).count() == 0
    assert sampling.sample_n(empty, 5, 1, ["k"]).count() == 0


def marked_by_rank(df, first, seed, keys, part=()):
    r = sampling.shuffle_rank(df, seed, keys, part, size_col="_n")
    return sorted(map(tuple, r.filter(F.col("rank") < first(F.col("_n"))).drop("rank", "_n").collect()), key=repr)


def test_cut_equals_ranks(spark, monkeypatch):
    """Distinct rows, copies around the cut, null keys and null splits, one or several levels of prefixes."""
    distinct = frame(spark, 700).withColumn("split", F.when(F.col("k") < 300, "a").when(F.col("k") < 500, "b"))
    copies = spark.createDataFrame([(i % 3 or None, "x" * (i % 2)) for i in range(400)], "k long, t string").withColumn("split", F.lit("a"))
    for cut_rows, shares in ((16 ** 4, (0.1, 1.0)), (0, (0.37,))):
        monkeypatch.setattr(sampling, "CUT_ROWS", cut_rows)
        for df, keys in ((distinct, ["k"]), (copies, ["k", "t"]), (copies, ["k"])):
            for part in ([], ["split"]):
                for share in shares:
                    first = lambda n: F.ceil(F.lit(share) * n)  # noqa: B023, E731
                    got = sampling._first(df, first, 5, keys, part).collect()
                    assert sorted(map(tuple, got), key=repr) == marked_by_rank(df, first, 5, keys, part)


def test_cut_with_many_partition_values(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_CUTS", 2)
    df = frame(spark, 300).withColumn("split", (F.col("k") % 5).cast("string"))
    out = sampling.subsample(df, 0.1, 42, ["k"], "split").groupBy("split").count().collect()
    assert {x["count"] for x in out} == {6} and len(out) == 5


def test_split_moves_no_rows(spark, tmp_out):
    frame(spark, 1000).write.parquet(f"{tmp_out}/rows")
    out = sampling.train_test_split(spark.read.parquet(f"{tmp_out}/rows"), 0.1, 42, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan ExistingRDD" not in plan and out.count() == 1000


def test_sample_more_or_less_than_there_is(spark):
    df = frame(spark, 100)
    assert sampling.sample_n(df, 0, 1, ["k"]).count() == 0
    assert sampling.sample_n(df, 100, 1, ["k"]).count() == 100
    assert sampling.pick_position(df, 0, 1, ["k"]).first().rank == 0
    assert sampling.pick_position(df.limit(0), 3, 1, ["k"]).count() == 0
