"""Token-ID files: Parquet with list columns (operator 7).

Documents are range-partitioned by doc_id, tokenised in that order and written
as one Parquet file per partition: ``ids`` is a list column with dictionary
encoding (or delta encoding, ``encoding="delta"``: the version-2 writer without
dictionary), row groups and pages have set sizes, and the writer's page indexes
let a reader fetch the ids or the metadata of a few documents only
(``read_documents``). Files sort by name in ascending doc_id order, nulls first;
``offset`` is the number of ids before a document in its file, so a document's
place in the whole token stream is that and the ids of the files before.

Edge cases: a null or empty text is the end id alone; repeated doc_ids follow
each other by text hash; rows without doc_id come first; texts of any length are
one list (encoded a slice of texts at a time); an empty table gives an empty
result; other columns are not written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkpairs.llm.common import plain, slices
from sparkpairs.llm.tokens import SLICE, TOKENIZER, encoder
from sparkpairs.session import scratch_path

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
FILE_SCHEMA = "shard int, offset bigint, doc_id bigint, n_tokens bigint, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 encoding: str = "dictionary", shards: int | None = None) -> None:
    """Writes ``FILE_SCHEMA`` files. ``shards``: number of files (default: shuffle partitions)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        before = 0  # a partition is a file
        for b in batches:
            at = 0
            for part in slices(plain(b.column("t")), SLICE):
                ids, off = enc.encode(part)
                n = len(part)
                data = np.insert(ids, off[1:], np.uint32(end_id)).astype(np.int32)
                off = off + np.arange(n + 1)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(data))
                yield pa.RecordBatch.from_arrays(
                    [b.column("shard").slice(at, n), pa.array(before + off[:-1]), b.column("id").slice(at, n), pa.array(np.diff(off)), lists],
                    names=["shard", "offset", "doc_id", "n_tokens", "ids"])
                at += n
                before += int(off[-1])

    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))
               .repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h")
               .select(F.spark_partition_id().alias("shard"), "id", "t"))
    writer = (ordered.mapInArrow(tokenize, FILE_SCHEMA).write.option("compression", "zstd")
              .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
              .option("parquet.page.row.count.limit", PAGE_ROWS))
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    else:
        writer = writer.option("parquet.enable.dictionary", "true")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str, first: int, last: int, ids: bool = True) -> DataFrame:
    """Documents with ``first <= doc_id <= last``: row groups and pages outside the range
    are skipped by their statistics; without ``ids`` no token is read."""
    cols = ["doc_id", "n_tokens", *(["ids"] if ids else [])]
    return read_tokens(spark, path).where(F.col("doc_id").between(first, last)).select(*cols)


def with_crc(tokens: DataFrame) -> DataFrame:
    """``shard, offset, doc_id, n_tokens, ids_crc32`` computed from the ids in the files."""
    import zlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            off = np.asarray(ids.offsets).astype(np.int64)
            data = memoryview(np.asarray(ids.values).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * x:4 * y]) for x, y in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("offset"), b.column("doc_id"), pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                                             names=["shard", "offset", "doc_id", "n_tokens", "ids_crc32"])

    return tokens.select("shard", "offset", "doc_id", "ids").mapInArrow(
        digest, "shard int, offset bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")


def positions(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` (with ``shard`` and ``offset``) with ``start``: the ids of all documents before each.

    ``tokens``: the files; only their token counts are read, added up to one row per file."""
    shards = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = shards.select(F.col("shard").alias("s"), (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return rows.join(before, F.col("shard") == F.col("s")).withColumn("start", F.col("before") + F.col("offset")) \
        .drop("s", "before", "shard", "offset")


def scratch(spark: SparkSession) -> str:
    return scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
