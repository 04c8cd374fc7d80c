"""Training-run and tuning-log analytics (A12-A15, W3-W5, K7 records).

The log is long-form ``(run_id, ts, event_id, metric, value)``. Ordinals and
running minima use the helpers in ``ordering``, whose tasks are cut by row counts, so
neither one very long run nor very many reports at one instant end up in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkpairs.operators.ordering import ordinal_within, running_agg
from sparkpairs.session import materialize

HISTORY_CHUNK = 10_000


def with_steps(log: DataFrame, run_col: str = "run_id", metric_col: str = "metric",
               ts_col: str = "ts", tie_col: str = "event_id") -> DataFrame:
    """0-based evaluation step per (run, metric) in time order (ties by ``tie_col``)."""
    return ordinal_within(log, [run_col, metric_col], [ts_col, tie_col], "step")


def metric_history(log: DataFrame) -> DataFrame:
    """A13 in long form: ``(run_id, metric, step, value)``; ordered by step."""
    return with_steps(log.select("run_id", "metric", "ts", "event_id", "value")).select("run_id", "metric", "step", "value")


def metric_history_arrays(log: DataFrame, chunk: int = HISTORY_CHUNK) -> DataFrame:
    """A13 in the original shape: per run and metric, the values in step order.

    Arrays hold ``chunk`` values at most; ``first_step`` is the step of an array's first value. A run with
    up to ``chunk`` reports has one array, a longer one several, so no task gathers a whole run."""
    steps = metric_history(log).withColumn("first_step", F.floor(F.col("step") / chunk).cast("bigint") * chunk)
    return steps.groupBy("run_id", "metric", "first_step").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda x: x["value"]).alias("values"))


def best_metrics(log: DataFrame, loss_metric: str = "eval_loss", acc_metric: str = "eval_accuracy") -> DataFrame:
    """A12 + A14: best (min) loss, best (max) accuracy, eval count, mean loss; null when absent."""
    m = F.col("metric")
    return log.groupBy("run_id").agg(
        F.min(F.when(m == loss_metric, F.col("value"))).alias("best_eval_loss"),
        F.max(F.when(m == acc_metric, F.col("value"))).alias("best_eval_accuracy"),
        F.count(F.when(m == loss_metric, F.lit(1))).alias("total_eval_steps"),
        F.avg(F.when(m == loss_metric, F.col("value"))).alias("mean_eval_loss"),
    )


def early_stopping(log: DataFrame, metric: str = "eval_loss", patience: int = 3, threshold: float = 0.0,
                   greater_is_better: bool = False) -> DataFrame:
    """First step at which ``patience`` consecutive evaluations brought no
    improvement over the best earlier value (by more than ``threshold``)."""
    sign = -1.0 if greater_is_better else 1.0
    # each two-level scan reads its input twice: materialise the inputs once
    steps = materialize(with_steps(log.filter(F.col("metric") == metric))
                        .select("run_id", "step", (F.col("value") * F.lit(sign)).alias("_v")))
    prev = running_agg(steps, ["run_id"], "step", F.col("_v"), "min", "_prev_best", inclusive=False)
    improved = F.col("_prev_best").isNull() | ((F.col("_v") < F.col("_prev_best")) &
                                              (F.abs(F.col("_v") - F.col("_prev_best")) > threshold))
    marked = materialize(prev.withColumn("_imp", F.when(improved, F.col("step"))))
    last = running_agg(marked, ["run_id"], "step", F.col("_imp"), "max", "_last_imp", inclusive=True)
    counter = F.col("step") - F.col("_last_imp")
    return last.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_evals"),
        F.min(F.when(counter >= patience, F.col("step"))).alias("stop_step"),
        (F.min("_v") * F.lit(sign)).alias("best_value"),
    )


def final_values(log: DataFrame, metric: str = "eval_loss") -> DataFrame:
    """Trial records: the last reported value of ``metric`` per run."""
    return log.filter(F.col("metric") == metric).groupBy("run_id").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"),
        F.count(F.lit(1)).alias("n_reports"),
    ).withColumnRenamed("run_id", "trial")


def best_trial(trials: DataFrame, direction: str = "minimize") -> DataFrame:
    """Best trial number and value, and its params where ``trials`` has them;
    NaN and missing values never win."""
    v = F.coalesce(F.col("value"), F.lit(float("nan")))
    key = F.when(F.isnan(v), F.lit(float("inf")) if direction == "minimize" else F.lit(float("-inf"))).otherwise(v)
    # ties go to the lowest trial number (the first one reported)
    if direction == "minimize":
        pick, order = F.min_by, F.struct(key.alias("k"), F.col("trial").alias("t"))
    else:
        pick, order = F.max_by, F.struct(key.alias("k"), (-F.col("trial")).alias("t"))
    best = pick(F.struct("trial", "value", *(["params"] if "params" in trials.columns else [])), order)
    return trials.agg(best.alias("best"), F.count(F.lit(1)).alias("n_trials")).select(
        F.col("best.trial").alias("best_trial"),
        F.col("best.value").alias("best_value"),
        *([F.col("best.params").alias("best_params")] if "params" in trials.columns else []),
        "n_trials",
    )


def rungs(min_resource: int = 4, max_resource: int = 18, reduction_factor: int = 3) -> list[int]:
    out, r = [], min_resource
    while r <= max_resource:
        out.append(r)
        r *= reduction_factor
    return out


def rung_survivors(log: DataFrame, metric: str = "eval_loss", min_resource: int = 4, max_resource: int = 18,
                   reduction_factor: int = 3) -> DataFrame:
    """At each rung (4, 12 evaluations) a run is promoted when its value is
    within the best ``max(n // reduction_factor, 1)`` of the runs reaching the rung.

    The window is per rung over one row per run (the number of trials), never
    over log rows.
    """
    rs = rungs(min_resource, max_resource, reduction_factor)
    steps = with_steps(log.filter(F.col("metric") == metric))
    at = steps.filter(F.col("step").isin([r - 1 for r in rs])).select(
        "run_id", (F.col("step") + 1).alias("rung"), "value")
    w = Window.partitionBy("rung")
    k = F.greatest(F.floor(F.count(F.lit(1)).over(w) / reduction_factor), F.lit(1))
    rank = F.rank().over(w.orderBy("value"))
    return at.select("run_id", "rung", "value", (rank <= k).alias("promoted"))
