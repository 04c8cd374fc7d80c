"""Exact top-k search by inner product, columnar branch and bound (operator 1).

Components are quantised to whole numbers (floor(scale * x)); rows are held
column by column. Scores are accumulated one block of dimensions after another,
those with the most query mass first. After each block a candidate survives
only if its partial score plus the largest remainder that the rest can add
(product of the norms of what is left, Cauchy-Schwarz) still reaches the
query's k-th best score; survivors are compacted and only they go on.

Queries are searched in blocks of at most ``QUERY_BLOCK`` (the only data that is
sent to all tasks), one pass over the table each; a task returns its k best of
each query, and the k best of those remain. Each pass is written to the shared
folder, so a lost executor repeats one pass at most.

Edge cases: rows with a null id or vector, or with a null or non-finite
component, take no part; vectors of different lengths are compared over their
common leading components; rows of one id are candidates each on its own, and a
repeated query id is searched once (its smallest vector); ties go to the smaller
id; an empty table or no query gives an empty result; other columns are ignored.
Scores are exact: where a sum of products could reach 2**53 (by the norms of query and row), the search
raises instead. Vectors of any length are read whole, a block of rows at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkpairs.session import materialize, scratch_path

QUERY_BLOCK = 4096
ROW_BLOCK = 1024
DIM_BLOCK = 8
SPARSE = 0.2  # share of surviving pairs below which they are followed one by one
RESULT = "query_id bigint, vec_id bigint, score bigint"


def _valid(vec: str) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(vec).isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(vectors: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """Quantised components, one column per vector, cut or padded with zeros to ``dims`` rows."""
    off = np.asarray(vectors.offsets).astype(np.int64)
    flat = np.floor(scale * np.asarray(vectors.values).astype(np.float64))
    out = np.zeros((dims, len(vectors)))
    lens = np.minimum(np.diff(off), dims)
    for d in range(dims):
        has = lens > d
        out[d, has] = flat[off[:-1][has] + d]
    return out


class Search:
    """The k best rows of a stream of row blocks for one block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        order = np.argsort(-(queries**2).sum(1), kind="stable")  # dimensions with the most mass first
        self.order, self.q, self.ids, self.k = order, queries[order], ids, k
        self.cuts = list(range(0, len(order), DIM_BLOCK)) + [len(order)]
        self.q_left = self._norms(self.q)
        self.threshold = np.full(len(ids), -np.inf)
        self.best = np.zeros((0, 3), np.int64)  # query number, score, id

    def _norms(self, m: np.ndarray) -> np.ndarray:
        """Norm of what is left of each column after each block of dimensions."""
        squares = np.vstack([m**2, np.zeros((1, m.shape[1]))])
        left = np.cumsum(squares[::-1], axis=0)[::-1]
        return np.sqrt(left[self.cuts])

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        x = rows[self.order]
        x_left = self._norms(x)
        if self.q_left.size and x_left.size and self.q_left[0].max() * x_left[0].max() >= 2.0**53:
            raise ValueError("scores of 2**53 and more are not exact in doubles: choose a smaller scale")
        score = np.zeros((len(self.ids), len(ids)))
        alive = self.ids[:, None] != ids[None, :]
        pairs = None
        for j in range(len(self.cuts) - 1):
            dims = slice(self.cuts[j], self.cuts[j + 1])
            if pairs is None:  # most pairs are alive: all of them, block by block
                score += self.q[dims].T @ x[dims]
                reach = score + (self.q_left[j + 1][:, None] * x_left[j + 1][None, :] * (1 + 1e-9) + 0.5)
                alive &= reach >= self.threshold[:, None]
                if alive.mean() < SPARSE:
                    pairs = np.nonzero(alive)
                    part = score[pairs]
            else:  # compacted: one gather per dimension
                for d in range(dims.start, dims.stop):
                    part += self.q[d][pairs[0]] * x[d][pairs[1]]
                keep = part + self.q_left[j + 1][pairs[0]] * x_left[j + 1][pairs[1]] * (1 + 1e-9) + 0.5 >= self.threshold[pairs[0]]
                pairs, part = (pairs[0][keep], pairs[1][keep]), part[keep]
        if pairs is None:
            pairs = np.nonzero(alive)
            part = score[pairs]
        found = np.column_stack([pairs[0], part.astype(np.int64), ids[pairs[1]]])
        both = np.vstack([self.best, found])
        both = both[np.lexsort((both[:, 2], -both[:, 1], both[:, 0]))]
        first = np.searchsorted(both[:, 0], both[:, 0])
        rank = np.arange(len(both)) - first
        self.best = both[rank < self.k]
        last = both[rank == self.k - 1]
        self.threshold[last[:, 0]] = last[:, 1]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows of each query."""
    spark = rows.sparkSession
    r = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & _valid("v"))
    q = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & _valid("v"))
    q = materialize(q.groupBy("id").agg(F.min("v").alias("v")))  # the blocks are dealt from it, not from the table
    blocks = max(1, -(-2 * q.count() // block))
    while True:  # blocks of the ids' hash, none of which is longer than `block`
        dealt = q.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        if (dealt.groupBy("b").count().agg(F.max("count")).first()[0] or 0) <= block:
            break
        blocks *= 2
    path = scratch_path(spark, f"topk-{uuid.uuid4().hex}")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for n in range(blocks):
        got = dealt.where(F.col("b") == n).toArrow()
        if not got.num_rows:
            continue
        ids = np.asarray(got.column("id"))
        vectors = pa.concat_arrays(got.column("v").chunks)
        dims = int(np.diff(np.asarray(vectors.offsets)).max())
        held = spark.sparkContext.broadcast((ids, matrix(vectors, dims, scale)))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            query_ids, m = held.value
            s = Search(query_ids, m, k)
            for b in batches:
                for at in range(0, b.num_rows, ROW_BLOCK):
                    c = b.slice(at, ROW_BLOCK)
                    v = pa.concat_arrays([c.column("v")])  # offsets from zero
                    s.add(np.asarray(c.column("id")), matrix(v, len(m), scale))
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[s.best[:, 0]]), pa.array(s.best[:, 2]), pa.array(s.best[:, 1])],
                                             names=["query_id", "vec_id", "score"])

        r.mapInArrow(scan, RESULT).write.mode("append").parquet(path)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = spark.read.schema(RESULT).parquet(path).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
