"""Adapters, source filtering, evaluation scoring and run-log analytics."""

import math
from functools import partial

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpairs.operators import evaluation, ordering, pairs, profile, runs
from sparkpairs.functions.text import remove_command


def test_remove_command(spark):
    df = spark.createDataFrame([("Fix grammar: I has a cat. ",), ("  no command ",), ("a: b: c",)], "t string")
    assert [r.x for r in df.select(remove_command("t").alias("x")).collect()] == ["I has a cat.", "no command", "b: c"]


def test_adapters(spark):
    clean = spark.createDataFrame([("s", "c1", "Text.")], "source string, chapter string, text string")
    assert pairs.adapt_clean(clean).collect()[0].asDict() == {"source": "s", "original": "Text.", "corrected": "Text."}
    bad = spark.createDataFrame([("x",)], "foo string")
    with pytest.raises(ValueError):
        pairs.adapt_clean(bad)
    tagged = spark.createDataFrame([("1", "gec", "Fix: a b", "a b"), ("2", "para", "Rewrite: x", "y")],
                                   "_id string, task string, src string, tgt string")
    out = pairs.adapt_tagged(tagged, "tagged").collect()
    assert [(r.original, r.corrected) for r in out] == [("a b", "a b")]
    multi = spark.createDataFrame([("s1", ["c1", "c2"]), ("s2", [])], "sentence string, corrections array<string>")
    assert [r.corrected for r in pairs.adapt_multi(multi, "m").collect()] == ["c1", "c2"]
    scalar = spark.createDataFrame([("s1", "only")], "sentence string, corrections string")
    assert [r.corrected for r in pairs.adapt_multi(scalar, "m").collect()] == ["only"]
    io = spark.createDataFrame([("in", "out")], "input string, output string")
    merged = pairs.merge_pairs([pairs.adapt_clean(clean), pairs.adapt_io(io, "io")])
    assert merged.columns == ["source", "original", "corrected"] and merged.count() == 2


def test_source_filter(spark):
    df = spark.createDataFrame([("a", "x", "x"), ("b", "y", "y")], "source string, original string, corrected string")
    assert pairs.filter_by_source(df, ["a", "zzz"]).count() == 1
    assert pairs.filter_by_source(df, ["zzz"]).count() == 2
    assert pairs.filter_by_source(df, []).count() == 2
    assert [r.source for r in pairs.unknown_sources(df, ["a", "zzz"]).collect()] == ["zzz"]


def scored(spark, flags, sources=None):
    rows = [(i, (sources or ["s"])[i % len(sources or ["s"])], "o", "e", "e " if f else "x", f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "index long, source string, original string, corrected string, generated string, m boolean")
    return evaluation.score(df).drop("m")


def test_accuracy(spark):
    s = scored(spark, [True, False, True, True], ["a", "b"])
    r = evaluation.accuracy_summary(s).first()
    assert (r.total, r.matches, r.accuracy) == (4, 3, 0.75)
    by = {x.source: x.accuracy for x in evaluation.accuracy_by_source(s).collect()}
    assert by == {"a": 1.0, "b": 0.5, None: 0.75}
    empty = evaluation.accuracy_summary(s.filter("false")).first()
    assert (empty.total, empty.accuracy) == (0, 0.0)


def test_running_accuracy(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RUN_CHUNK", 4)
    flags = [i % 3 != 0 for i in range(25)]
    out = evaluation.running_accuracy(scored(spark, flags)).orderBy("index").collect()
    want = [(i, sum(flags[: i + 1]) / (i + 1)) for i in range(25) if i % 10 == 9 or i == 24]
    assert [(r["index"], r.running_accuracy) for r in out] == want


def test_running_agg_chunked(spark):
    df = spark.createDataFrame([(g, i, float((i * 7) % 5)) for g in ("a", "b") for i in range(23)], "g string, o long, v double")
    got = ordering.running_agg(df, ["g"], "o", F.col("v"), "min", "m", inclusive=False, chunk=4).orderBy("g", "o").collect()
    for g in ("a", "b"):
        vals = [float((i * 7) % 5) for i in range(23)]
        exp = [None] + [min(vals[:i]) for i in range(1, 23)]
        assert [r.m for r in got if r.g == g] == exp


def test_example_mix(spark):
    out = evaluation.example_mix(scored(spark, [False, True, False, True, False]), 3).collect()
    assert sorted((r["index"], r.matches_expected) for r in out) == [(0, False), (1, True), (2, False)]


def test_masked_accuracy(spark):
    df = spark.createDataFrame([([1, 2, 3], [-100, 2, 3]), ([9, 2, 4], [-100, 2, 3])],
                               "predictions array<int>, label_ids array<int>")
    r = evaluation.masked_exact_match(df).first()
    assert (r.eval_total_predictions, r.eval_correct_predictions, r.eval_accuracy) == (2, 1, 0.5)


def test_batch_correct(spark):
    df = spark.createDataFrame([("a  ",), ("boom",), ("c",)], "original string")

    def factory():
        def correct(texts):
            if "boom" in texts:
                raise RuntimeError("bad input")
            return [t.upper() + " " for t in texts]
        return correct

    out = sorted(r.generated for r in evaluation.batch_correct(df, factory).collect())
    assert out == ["A", "C", "[ERROR: bad input]"]


def test_corrector_batches_and_outputs(spark):
    """Short, long, raising and non-text outputs become error rows of their own; every other text is corrected, in
    batches that keep to the budget; other columns pass unchanged."""
    rows = [(i, None if i == 7 else " ".join(["w"] * (i % 13 + 1)) + f" {i}", None if i % 2 else i) for i in range(60)]
    bad = {3: "raise", 17: "few", 30: "many", 44: "none"}
    df = spark.createDataFrame(rows, "k long, original string, extra long").coalesce(1)

    def factory():
        def correct(texts, max_new_tokens, temperature):
            assert max_new_tokens == 9 and temperature == 0.3
            words = max(len(t.split()) for t in texts) * len(texts)
            if len(texts) > 1 and words > 40 or len(texts) > 8:
                raise AssertionError("over budget")
            kinds = {bad.get(int(t.split()[-1])) if t else None for t in texts}
            if "raise" in kinds:
                raise RuntimeError("bad input")
            out = [f" {t.upper()} b{len(texts)} " for t in texts]
            return out[1:] if "few" in kinds else [*out, "x"] if "many" in kinds else [None] * len(texts) if "none" in kinds else out
        return correct

    out = evaluation.batch_correct(df, factory, generation={"max_new_tokens": 9, "temperature": 0.3}, batch_tokens=40, batch_rows=8)
    assert out.schema.simpleString() == "struct<k:bigint,original:string,extra:bigint,generated:string>"
    got = {r.k: r for r in out.collect()}
    assert len(got) == 60 and all((got[k].original, got[k].extra) == (t, x) for k, t, x in rows)
    assert got[3].generated == "[ERROR: bad input]" and got[17].generated == "[ERROR: 0 outputs for 1 texts]"
    assert got[30].generated == "[ERROR: 2 outputs for 1 texts]" and got[7].generated.startswith("b")
    broken = {k for k, r in got.items() if r.generated.startswith("[ERROR")}
    assert set(bad) <= broken and all("not a text" in got[k].generated for k in broken - {3, 17, 30})
    assert any(r.generated.endswith(" b8") or r.generated.endswith(" b6") for r in got.values() if not r.generated.startswith("["))
    assert evaluation.batch_correct(df.limit(0), factory).count() == 0
    again = evaluation.batch_correct(out, factory, generation={"max_new_tokens": 9, "temperature": 0.3}, batch_tokens=40, batch_rows=8)
    assert again.columns == out.columns  # an output column of that name is replaced


def test_masked_match_of_ragged_arrays_decoded_and_as_text(spark):
    rows = [([5, 1, 2], [-100, 1, 2], True, True), ([1, 2], [1, 2, 3], False, False), ([1, 2, 3, 4], [1, 2, 3], True, True),
            ([9, 9], [-100, -100], True, True), ([], [], True, True), (None, [4], False, False), ([4], None, True, True),
            ([1, 0, 2], [1, 2, 0], False, True), ([3, 7], [3, -100], True, True), ([1, 2], [2, 1], False, False)]
    df = spark.createDataFrame([(i, p, l) for i, (p, l, _, _) in enumerate(rows)], "k int, predictions array<int>, label_ids array<bigint>")
    calls = spark.sparkContext.accumulator(0)

    def decoder():  # id 0 is a special token that decoding leaves out
        calls.add(1)
        return lambda many: [" " + " ".join(str(i) for i in ids if i) + "  " for ids in many]

    ids = {r.k: r.ok for r in evaluation.with_masked_match(df.withColumn("_pairs", F.lit(1)), out="ok").collect()}
    assert [ids[i] for i in range(len(rows))] == [r[2] for r in rows]
    texts = {r.k: r.ok for r in evaluation.with_masked_match(df.coalesce(1), decoder=decoder, out="ok").collect()}
    assert [texts[i] for i in range(len(rows))] == [r[3] for r in rows] and calls.value == 1
    r = evaluation.masked_exact_match(df, decoder=decoder).first()
    assert (r.eval_total_predictions, r.eval_correct_predictions) == (10, sum(x[3] for x in rows))
    plain = spark.createDataFrame([(" a", "a "), ("a", "b"), (None, ""), ("x", None)], "predictions string, label_ids string")
    assert evaluation.masked_exact_match(plain).first().eval_correct_predictions == 2
    assert evaluation.masked_exact_match(df.limit(0), decoder=decoder).first().eval_accuracy == 0.0


def log(spark, values):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(r, base + dt.timedelta(minutes=i), i, "eval_loss", float(v)) for r, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run_id long, ts timestamp, event_id long, metric string, value double")


def test_early_stopping(spark):
    vals = {1: [5, 4, 4.5, 4.2, 4.1, 3], 2: [3, 2, 1, 0.5], 3: [1, 1, 1, 1, 1]}
    got = {r.run_id: (r.stop_step, r.best_value, r.n_evals) for r in runs.early_stopping(log(spark, vals)).collect()}
    assert got == {1: (4, 3.0, 6), 2: (None, 0.5, 4), 3: (3, 1.0, 5)}


def test_best_and_history(spark):
    vals = {1: [5, 4, 6], 2: [3, 7]}
    l = log(spark, vals)
    b = {r.run_id: (r.best_eval_loss, r.total_eval_steps) for r in runs.best_metrics(l).collect()}
    assert b == {1: (4.0, 3), 2: (3.0, 2)}
    h = [(r.run_id, r.step, r.value) for r in runs.metric_history(l).orderBy("run_id", "step").collect()]
    assert h == [(1, 0, 5.0), (1, 1, 4.0), (1, 2, 6.0), (2, 0, 3.0), (2, 1, 7.0)]
    t = runs.best_trial(runs.final_values(l)).first()
    assert (t.best_trial, t.best_value, t.n_trials) == (1, 6.0, 2)


def test_best_trial_nan_and_ties(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, 1.0), (3, 1.0)], "trial int, value double")
    r = runs.best_trial(df).first()
    assert (r.best_trial, r.best_value, r.n_trials) == (2, 1.0, 4)


def test_rungs(spark):
    assert runs.rungs(4, 18, 3) == [4, 12]
    vals = {i: [float(i)] * 12 for i in range(9)}
    out = runs.rung_survivors(log(spark, vals)).collect()
    promoted = sorted((r.rung, r.run_id) for r in out if r.promoted)
    assert promoted == [(4, 0), (4, 1), (4, 2), (12, 0), (12, 1), (12, 2)]


def test_history_arrays(spark):
    l = log(spark, {1: [5, 4, 6], 2: [3, 7]})
    got = {r.run_id: list(r["values"]) for r in runs.metric_history_arrays(l).collect()}
    assert got == {1: [5.0, 4.0, 6.0], 2: [3.0, 7.0]}


def test_source_filter_is_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", "x", "x"), ("b", "y", "y")], "source string, original string, corrected string") \
        .write.parquet(f"{tmp_path}/p")
    df = pairs.filter_by_source(spark.read.parquet(f"{tmp_path}/p"), ["a"])
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,a)]" in df._jdf.queryExecution().toString() \
        or "In(source, [a])" in df._jdf.queryExecution().toString()
    assert [r.source for r in df.collect()] == ["a"]


def test_fingerprint_counts_equal_rows(spark):
    def of(rows):
        return profile.dataset_fingerprint(spark.createDataFrame(rows, "a string, b string")).first()

    assert of([("a", "b"), ("a", "b")]) != of([("c", "d"), ("c", "d")])
    assert of([("a", "b"), ("c", None)]) == of([("c", None), ("a", "b")])
    assert of([("a", None)]) != of([("a", "\u0002")]) != of([("a", "-")])
    assert of([("ab", "c")]) != of([("a", "bc")])


def test_best_trial_carries_its_params(spark):
    t = spark.createDataFrame([(0, 0.2, {"lr": "1"}), (1, None, {"lr": "2"}), (2, 0.2, {"lr": "3"})],
                              "trial int, value double, params map<string,string>")
    assert runs.best_trial(t).first().asDict() == {"best_trial": 0, "best_value": 0.2, "best_params": {"lr": "1"}, "n_trials": 3}


def test_corpora_by_name(spark):
    known = {"io": pairs.Corpus(partial(pairs.adapt_io, source_name="io"), {"validation": "train", "test": "test"})}
    stored = spark.createDataFrame([("a", "A", "validation"), ("b", "B", "test"), ("c", "C", "extra"), ("d", "D", None)],
                                   "input string, output string, split string")
    got = {tuple(r) for r in pairs.load_corpora(["io"], known, lambda name: stored).collect()}
    assert got == {("train", "io", "a", "A"), ("test", "io", "b", "B")}
    for names in (["io", "other"], []):
        with pytest.raises(ValueError):
            pairs.load_corpora(names, known, lambda name: pytest.fail("read before the names were checked"))
