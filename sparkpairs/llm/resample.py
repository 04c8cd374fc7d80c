"""Target-distribution importance resampling by hashed n-grams (operator 13).

A 256-byte table lower-cases A-Z and blanks every separator in the UTF-8 bytes; ``bytes.split``
gives the words; the CRC of an n-gram is chained from that of its first n-1 words, and numpy
adds up the features, ``COUNT_AT`` at a time. The corpus and the target are counted in one pass each; the counts of the
``buckets`` (a fixed number of rows) give each bucket's gain, the log ratio of the smoothed target
and corpus shares. A second pass adds the gains of each document's features, a keyed Gumbel draw
is added, and the highest scores are drawn without replacement.

Skew: a task counts what it reads and sends one row per bucket at most; ranks come from range
partitions, so no key holds many rows.

Edge cases: null or empty texts have no feature, weight 0 and are never drawn (``min_words``);
texts of any length are counted in parts of ``PART`` bytes; ties go to the smaller doc_id, then to
fewer features; repeated rows are drawn one by one; a null doc_id is drawn with the key of the empty
text and comes last among ties; an empty corpus gives an empty result, an empty target only the
smoothing; other columns are ignored (the result has the columns named in ``resample``).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpairs.llm.common import plain, slices
from sparkpairs.llm.ordered import numbered
from sparkpairs.session import materialize

#: Bytes of a text that are split at a time.
PART = 1 << 20
#: Features counted at a time.
COUNT_AT = 1 << 16
#: Lower-case A-Z; keep 0-9, a-z and all bytes of characters beyond ASCII; blank the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class ResampleSettings:
    max_n: int = 1          # features are runs of 1 to max_n words
    buckets: int = 10_000   # a few thousand to a few million: the gains are held by every worker
    min_words: int = 20     # shorter documents are never drawn
    percent: int = 10       # of the documents with enough words
    seed: int = 2024


def features(text: bytes, max_n: int) -> Iterator[tuple[int, list[int]]]:
    """Words and CRCs of all their runs, one part of the text after the other."""
    clean = text.translate(TABLE)
    tail: list[bytes] = []
    at = 0
    while at < len(clean):
        end = len(clean) if at + PART >= len(clean) else clean.find(b" ", at + PART)
        end = len(clean) if end < 0 else end
        words = clean[at:end].split()
        at = end
        crcs = list(map(zlib.crc32, words))
        out = list(crcs)
        for k in range(1, max_n):  # runs that end in this part, chained word by word from those one word shorter
            both = tail[len(tail) - min(k, len(tail)):] + words
            runs = list(map(zlib.crc32, both))
            for j in range(1, k + 1):
                runs = [zlib.crc32(b" " + w, c) for c, w in zip(runs, both[j:], strict=False)]
            out += runs
        tail = (tail + words)[-(max_n - 1):] if max_n > 1 else []
        yield len(words), out


def _texts(arr: pa.Array) -> Iterator[bytes]:
    for part in slices(plain(arr), PART):
        yield from part.cast(pa.large_binary()).to_pylist()


def bucket_counts(df: DataFrame, s: ResampleSettings = ResampleSettings(), text_col: str = "text") -> DataFrame:
    """``bucket, n``: features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        waiting: list[int] = []
        for b in batches:
            for text in _texts(b.column(0)):
                for _, crcs in features(text, s.max_n):
                    waiting += crcs
                    if len(waiting) > COUNT_AT:  # a bounded number of features at a time
                        _add(total, waiting)
                        waiting = []
        _add(total, waiting)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["bucket", "n"])

    return df.select(text_col).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _add(total: np.ndarray, crcs: list[int]) -> None:
    total += np.bincount(np.fromiter(crcs, np.int64, len(crcs)) % len(total), minlength=len(total))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Per bucket floor(1000 ln of the ratio of the smoothed shares)."""
    total_s, total_t = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * total_s / ((corpus.get(b, 0) + 1) * total_t)))
                     for b in range(buckets)], np.int64)


def fit(docs: DataFrame, target: DataFrame, s: ResampleSettings = ResampleSettings(), text_col: str = "text") -> np.ndarray:
    """Gains of all buckets. ``s.buckets`` rows of counts reach the driver, whatever the size of the tables."""
    read = lambda df: {r["bucket"]: r["n"] for r in bucket_counts(df, s, text_col).collect()}
    return gains(read(docs), read(target), s.buckets)


def weigh(docs: DataFrame, gain: np.ndarray, s: ResampleSettings = ResampleSettings(), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_features, weight`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("n_words bigint, n_features bigint, weight bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        value = shared.value
        for arr in batches:
            rows = []
            for text in _texts(arr):
                words = found = weight = 0
                for n, crcs in features(text, s.max_n):
                    words += n
                    found += len(crcs)
                    weight += int(value[np.fromiter(crcs, np.int64, len(crcs)) % s.buckets].sum())
                rows.append((words, found, weight))
            cols = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.StructArray.from_arrays([pa.array(c) for c in cols.T], ["n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("i"), run(F.col(text_col)).alias("w")).select(
        F.col("i").alias(id_col), "w.n_words", "w.n_features", "w.weight")


def resample(docs: DataFrame, target: DataFrame, s: ResampleSettings = ResampleSettings(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Every row's ``id_col, n_words, n_features, weight, score, rank`` (rank from 1 in the drawn order, null: not drawn)."""
    key = F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = weigh(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), fit(docs, target, s, text_col), s, "id", "t")
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise))
    enough = F.col("n_words") >= s.min_words
    most = int(scored.where(enough).count()) * s.percent // 100
    order = [F.when(enough, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features")]
    at = numbered(scored, order, "position")
    return at.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score",
                     F.when(F.col("position") < most, F.col("position") + 1).alias("rank"))
