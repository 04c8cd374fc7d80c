"""Error injection on a stream.

Randomness is keyed on row content, so the batch operators are stateless and
run unchanged on ``readStream``: a row gets the same corruption whether it is
processed in a batch job or in any micro-batch. No event-time state is kept.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkpairs.operators.errors import ErrorConfig, insert_errors
from sparkpairs.session import checkpoint_dir


def stream_insert_errors(spark: SparkSession, source_dir: str, schema, out_dir: str, name: str = "inject",
                         text: str = "text", key_cols=("doc_id",), config: ErrorConfig | dict | None = None,
                         seed: int = 42, available_now: bool = True, max_files_per_trigger: int | None = None
                         ) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    out = insert_errors(src, text, key_cols, config, seed)
    writer = (out.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", os.path.join(checkpoint_dir(spark), "streams", name))
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stream_apply(spark: SparkSession, source_dir: str, schema, out_dir: str, transform, name: str = "apply",
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Run any stateless batch operator (chat rendering, HTML conversion,
    adapters, error injection...) on a file stream: ``transform(df) -> df``.
    Keyed randomness makes the result identical to the batch run."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = transform(reader.parquet(source_dir))
    writer = (out.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", os.path.join(checkpoint_dir(spark), "streams", name))
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
