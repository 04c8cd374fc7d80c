"""Scoring model output (X6, F15, F16, A3, A4, A14, W2, O7, K3 records)."""

from __future__ import annotations

from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sparkpairs.functions.names import free_names
from sparkpairs.functions.text import exact_match, py_strip
from sparkpairs.operators.ordering import running_agg

BATCH_TOKENS = 8192  # texts of a batch times the longest one's tokens, at most
BATCH_ROWS = 64


def _batches(texts: list[str], measure: Callable[[str], int], most_tokens: int, most_rows: int) -> Iterator[list[int]]:
    """Row numbers of batches of similar length whose padded size keeps to the budget (one text at least)."""
    sizes = [measure(t) for t in texts]
    batch: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: (sizes[i], i)):  # the next one is the longest so far
        if batch and (len(batch) == most_rows or max(1, sizes[i]) * (len(batch) + 1) > most_tokens):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def _corrected(correct: Callable[..., list[str]], texts: list[str], generation: dict) -> list[str]:
    """Outputs of a batch. When it fails or returns another number of texts, its halves are tried, so that a bad
    row costs a logarithm of calls and becomes ``[ERROR: message]``."""
    try:
        out = list(correct(texts, **generation))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} outputs for {len(texts)} texts")
    except Exception as e:  # noqa: BLE001 - the error text is the result
        if len(texts) == 1:
            return [f"[ERROR: {e}]"]
        half = len(texts) // 2
        return _corrected(correct, texts[:half], generation) + _corrected(correct, texts[half:], generation)
    return [o.strip() if isinstance(o, str) else f"[ERROR: {type(o).__name__} is not a text]" for o in out]


def batch_correct(df: DataFrame, factory: Callable[[], Callable[..., list[str]]], input_col: str = "original",
                  output_col: str = "generated", generation: dict | None = None, batch_tokens: int = BATCH_TOKENS,
                  batch_rows: int = BATCH_ROWS, measure: Callable[[str], int] | None = None) -> DataFrame:
    """Run a corrector over Arrow batches; the model loads once per task.

    ``factory()`` returns ``correct(texts, **generation) -> texts``; ``generation`` holds its arguments (largest
    number of new tokens, temperature, top p, top k). Texts of similar length go together, up to ``batch_rows``
    and, padded to the longest, ``batch_tokens`` (``measure`` counts a text's tokens; by default its words).
    Results are stripped; a null text is corrected as an empty one. A text whose call fails, also because the
    number of outputs is not that of the texts, becomes ``[ERROR: message]``. The other columns pass as they are."""
    schema = StructType([*[f for f in df.schema.fields if f.name != output_col], StructField(output_col, StringType())])
    count = measure or (lambda text: len(text.split()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        correct = factory()
        for b in batches:
            texts = [t or "" for t in b.column(input_col).to_pylist()]
            out: list[str | None] = [None] * len(texts)
            for rows in _batches(texts, count, batch_tokens, batch_rows):
                for i, o in zip(rows, _corrected(correct, [texts[i] for i in rows], generation or {}), strict=True):
                    out[i] = o
            kept = [n for n in b.schema.names if n != output_col]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(out, pa.string())], names=[*kept, output_col])

    return df.mapInArrow(run, schema)


def score(df: DataFrame, expected_col: str = "corrected", generated_col: str = "generated") -> DataFrame:
    """``matches_expected`` = stripped equality."""
    return df.withColumn("matches_expected", exact_match(generated_col, expected_col))


def eval_records(df: DataFrame, index_col: str = "index") -> DataFrame:
    """K3 record shape."""
    return df.select(F.col(index_col).cast("bigint").alias("index"), "source", "original",
                     F.col("corrected").alias("expected"), "generated", "matches_expected")


def accuracy_summary(scored: DataFrame) -> DataFrame:
    """A3: total, matches, accuracy (0.0 when empty)."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("matches_expected").cast("bigint")), F.lit(0)).alias("matches"),
        F.coalesce(F.avg(F.col("matches_expected").cast("double")), F.lit(0.0)).alias("accuracy"),
    )


def accuracy_by_source(scored: DataFrame) -> DataFrame:
    """A4: per source plus an overall row (``source`` null) in one rollup."""
    return scored.rollup("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("matches_expected").cast("bigint")).alias("matches"),
        F.avg(F.col("matches_expected").cast("double")).alias("accuracy"),
    )


def running_accuracy(scored: DataFrame, index_col: str = "index", every: int = 10) -> DataFrame:
    """Accuracy so far at every ``every``-th row and at the last row.

    ``index`` must be dense from 0; the running sum is chunked (no global window).
    """
    r = running_agg(scored, [], index_col, F.col("matches_expected").cast("bigint"), "sum", "_hits")
    n = scored.select(F.count(F.lit(1))).scalar()
    keep = (F.col(index_col) % every == every - 1) | (F.col(index_col) == n - 1)
    return r.filter(keep).select(
        F.col(index_col).cast("bigint").alias("index"),
        F.col("_hits").cast("bigint").alias("matches_so_far"),
        (F.col("_hits") / (F.col(index_col) + 1)).alias("running_accuracy"),
    )


def example_mix(scored: DataFrame, n: int = 3, index_col: str = "index") -> DataFrame:
    """The first ``n // 2`` correct rows by index, then incorrect rows up to
    ``n`` in total (no backfill with correct ones). Each side is a top-k."""
    good = scored.filter(F.col("matches_expected")).orderBy(index_col).limit(n // 2)
    bad = scored.filter(~F.col("matches_expected")).orderBy(index_col).limit(n)
    n_good = good.select(F.count(F.lit(1))).scalar()
    bad = bad.withColumn("_r", F.row_number().over(Window.orderBy(index_col)))  # at most n rows
    bad = bad.filter(F.col("_r") <= F.lit(n) - n_good).drop("_r")
    return good.unionByName(bad)


def with_masked_match(df: DataFrame, pred_col: str = "predictions", label_col: str = "label_ids", pad: int = -100,
                      decoder: Callable[[], Callable[[list[list[int]]], list[str]]] | None = None, out: str = "matches") -> DataFrame:
    """Whether prediction and label are the same once positions labelled ``pad`` are dropped from both.

    With a ``decoder`` (a factory, called once per Python worker, of a function from id lists to texts) the decoded
    texts are compared without white space around them, else the ids. Text columns are compared as texts. A
    label position without prediction is a mismatch, a prediction beyond the labels does not count; a null array
    is an empty one."""
    types = [df.schema[c].dataType for c in (pred_col, label_col)]
    if not all(isinstance(t, ArrayType) for t in types):
        return df.withColumn(out, exact_match(F.coalesce(F.col(pred_col).cast("string"), F.lit("")), F.coalesce(F.col(label_col).cast("string"), F.lit(""))))
    (pairs_,) = free_names(df, "_pairs", taken=(out,))
    none = F.array().cast("array<bigint>")
    zipped = F.arrays_zip(F.coalesce(F.col(pred_col).cast("array<bigint>"), none).alias("p"), F.coalesce(F.col(label_col).cast("array<bigint>"), none).alias("l"))
    x = df.withColumn(pairs_, F.filter(zipped, lambda x: x["l"] != pad))
    pred, label = F.transform(pairs_, lambda x: x["p"]), F.transform(pairs_, lambda x: x["l"])
    if decoder is None:
        return x.withColumn(out, pred == label).drop(pairs_)

    @F.arrow_udf("boolean")
    def same(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        decode = decoder()
        for p, l in batches:
            texts = [[t.strip() for t in decode([[i for i in ids if i is not None] for ids in a.to_pylist()])] for a in (p, l)]
            yield pa.array([a == b for a, b in zip(*texts, strict=True)], pa.bool_())

    return x.withColumn(out, same(pred, label)).drop(pairs_)


def masked_exact_match(df: DataFrame, pred_col: str = "predictions", label_col: str = "label_ids", pad: int = -100,
                       decoder: Callable[[], Callable[[list[list[int]]], list[str]]] | None = None) -> DataFrame:
    """F16 + A3: accuracy over rows of ``with_masked_match``."""
    (ok,) = free_names(df, "_ok")
    scored = with_masked_match(df, pred_col, label_col, pad, decoder, ok)
    return scored.agg(
        F.count(F.lit(1)).alias("eval_total_predictions"),
        F.coalesce(F.sum(F.col(ok).cast("bigint")), F.lit(0)).alias("eval_correct_predictions"),
        F.coalesce(F.avg(F.col(ok).cast("double")), F.lit(0.0)).alias("eval_accuracy"),
    )


__all__ = ["batch_correct", "score", "eval_records", "accuracy_summary", "accuracy_by_source",
           "running_accuracy", "example_mix", "with_masked_match", "masked_exact_match", "py_strip"]
