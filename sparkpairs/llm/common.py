"""Shared helpers: table reads, per-column Arrow functions and flat word arrays.

The text operators run per Arrow batch on flat arrays (one code per word of
the batch, one offset per text) instead of one Python object per text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but space and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in slices of about this many bytes, to bound memory.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(key: Column, folds: int) -> Column:
    """``crc32(key as text) mod folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"{name}_"
    return name


def plain(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string array without nulls (null: empty), in one chunk whose data starts at offset zero
    (some Arrow functions, ``ascii_lower`` among them, misread arrays that start elsewhere)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    arr = pc.fill_null(arr, "")
    if len(arr) and (arr.offset or np.frombuffer(arr.buffers()[1], np.int64, 1)[0]):
        arr = pa.concat_arrays([arr, pa.array([], arr.type)])
    return arr


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a string array of about ``limit`` bytes (one text at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(arr), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield plain(arr.slice(start, i - start))
            start, total = i, 0
        total += int(n)
    if start < len(arr):
        yield plain(arr.slice(start))


class FlatWords:
    """Words of a slice of texts: ``codes[offsets[i]:offsets[i+1]]`` index ``words``."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(plain(texts))
        enc = lists.flatten().dictionary_encode()
        codes = np.asarray(enc.indices)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        self.dictionary = enc.dictionary
        empty = np.flatnonzero(np.asarray(pc.binary_length(enc.dictionary)) == 0)
        self.codes, self.offsets = codes, offsets
        if len(empty):  # beside white space at the ends of a text
            gone = np.flatnonzero(codes == empty[0])
            self.codes = np.delete(codes, gone)
            self.offsets = offsets - np.searchsorted(gone, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i+1]]`` for each i, empty segments 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def with_struct(df: DataFrame, text_col: str, out: str, schema: str,
                work: Callable[[pa.Array], pa.StructArray]) -> DataFrame:
    """``df`` with a struct column ``out`` computed from one text column per Arrow batch.

    The other columns stay in the JVM. A column already named ``out`` is replaced.
    """

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            parts = [work(part) for part in slices(plain(arr), SLICE_BYTES // 2)]
            yield pa.concat_arrays(parts) if parts else work(plain(arr))

    return df.withColumn(out, run(F.col(text_col)))
