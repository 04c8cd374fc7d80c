"""Evaluation (L3): source filter -> sample -> corrector -> exact match ->
summary, per-source accuracy, running accuracy, example mix, records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkpairs.operators import evaluation, pairs, sampling
from sparkpairs.session import materialize


def evaluate(pairs_df: DataFrame, corrector_factory, sources: list[str] | None = None, n_samples: int | None = None,
             seed: int = 42, n_examples: int = 3, generation: dict | None = None) -> dict[str, DataFrame]:
    picked = pairs.filter_by_source(pairs_df, sources or [])
    rows = picked.select(*pairs.PAIR_COLS)
    if n_samples is not None:
        rows = sampling.sample_n(rows, n_samples, seed)  # the first of the order, so only those are ranked
    ranked = sampling.shuffle_rank(rows, seed, rank_col="index")
    generated = evaluation.batch_correct(ranked, corrector_factory, generation=generation)
    scored = materialize(evaluation.score(generated))  # model output computed once for all reports
    return {
        "records": evaluation.eval_records(scored),
        "summary": evaluation.accuracy_summary(scored),
        "by_source": evaluation.accuracy_by_source(scored),
        "running": evaluation.running_accuracy(scored),
        "examples": evaluation.example_mix(scored, n_examples),
    }
