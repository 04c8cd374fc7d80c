"""Best-fit packing by the sum of squares (operator 4).

Documents become token ids plus an end id; only those longer than a sequence
are cut. Each piece goes where the sum over all residual gaps g of (number of
open sequences with gap g) squared becomes smallest: into an open sequence of
the gap that lowers it most, or into a new one. Ties go to the smallest gap
left, then to an open sequence.

Pieces are dealt by hash into groups of about ``GROUP_PIECES`` that are packed
side by side, largest piece first; a group leaves a few open sequences, a few
in ten thousand of its pieces. Only ids and lengths are shuffled for that. The
token ids are written once, to a table in the shared folder, and joined to
their places when sequences are wanted (``sequences``).

Edge cases: a null or empty text is the end id alone; repeated rows and doc_ids
are packed one by one (told apart by ``row``); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpairs.llm.common import plain, slices
from sparkpairs.llm.tokens import SLICE, TOKENIZER, encoder
from sparkpairs.session import scratch_path

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 16_384
PIECES = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"


# ---------------------------------------------------------------- pieces
def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens (``PIECES``); ids are little-endian uint32.

    The rows are read back from a table that the pieces are written to once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            at = 0
            for part in slices(plain(b.column("t")), SLICE):
                ids, off = enc.encode(part)
                n = len(part)
                data = np.insert(ids, off[1:], np.uint32(end_id))  # the end id after each text
                off = off + np.arange(n + 1)
                lens = np.diff(off)
                count = -(-lens // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(lens[doc] - start, capacity)
                edges = np.concatenate([off[doc] + start, off[-1:]]) * 4
                keys = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(keys), b.column("id").take(keys), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), binary(data, edges)],
                    names=["row", "doc_id", "piece", "start", "length", "ids"])
                at += n

    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("id"),
                       F.col("text").alias("t"))
    path = scratch_path(spark, f"pieces-{uuid.uuid4().hex}")
    rows.mapInArrow(cut, PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary array of consecutive parts of ``data``, cut at byte positions ``edges``."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data.astype("<u4").tobytes())])


# ---------------------------------------------------------------- packing
def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order given."""
    open_ = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            seq[i], made = made, made + 1
            continue
        # change of the sum when a sequence of gap s + k becomes one of gap k (gap 0 is closed, not counted)
        after = 2 * open_[: capacity + 1 - s] + 1
        after[0] = 0
        before = open_[s:]
        cost = np.where(before > 0, after - 2 * before + 1, np.iinfo(np.int64).max)
        cost[-1] = after[-1]  # a new sequence; none of gap `capacity` is open
        left = int(cost.argmin())
        if left == capacity - s:
            seq[i], made = made, made + 1
        else:
            open_[left + s] -= 1
            seq[i] = stacks[left + s].pop()
            offset[i] = capacity - left - s
        if left:
            open_[left] += 1
            stacks[left].append(int(seq[i]))
    return seq, offset


def places(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``row, piece, length, sequence_id, offset`` of each piece."""
    groups = max(1, -(-parts.count() // group_pieces))

    def pack(pdf):
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        seq, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (pdf["g"].to_numpy() << 32) + seq
        pdf["offset"] = offset
        return pdf[["row", "piece", "length", "sequence_id", "offset"]]

    keyed = parts.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece", F.lit(3)), F.lit(groups)).alias("g"))
    return keyed.groupBy("g").applyInPandas(pack, "row bigint, piece int, length bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every piece (``PIECES``) with its ``sequence_id`` and ``offset``."""
    parts = pieces(docs, tokenizer, end_id, capacity)
    where = places(parts, capacity).select(F.col("row").alias("r"), F.col("piece").alias("p"), "sequence_id", "offset")
    return parts.join(where, (F.col("row") == F.col("r")) & (F.col("piece") == F.col("p"))).drop("r", "p")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids (little-endian uint32) and the doc_id, piece and offset of each part."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    s = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return s.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda x: x.dropFields("ids")).alias("parts"))
