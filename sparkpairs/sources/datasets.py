"""Dataset folders, markdown trees, source lists and prompts."""

from __future__ import annotations

import os
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpairs.functions.constants import EXPORT_FALLBACK_PROMPT
from sparkpairs.functions.names import free_names
from sparkpairs.functions.text import py_strip
from sparkpairs.sinks.writers import MANIFEST


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: How a folder of rows without a value is called by partitioned writes.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def split_folders(spark: SparkSession, path: str) -> dict[str | None, str]:
    """Folder of each split of a dataset folder, in either layout (``<dir>/<split>`` or ``<dir>/split=<split>``).

    Names as partitioned writes escape them are read back; the folder of rows without split is that of None."""
    fs, p = _fs(spark, path)
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    out: dict[str | None, str] = {}
    for st in sorted(fs.listStatus(p), key=lambda st: st.getPath().getName()):
        name = st.getPath().getName()
        if not st.isDirectory() or name.startswith(("_", ".")):
            continue
        split = unescape(name.removeprefix("split=")) if name.startswith("split=") else name
        out[None if name == f"split={NULL_FOLDER}" else split] = f"{path}/{name}"
    return out


def _read_folder(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def read_dataset(spark: SparkSession, path: str, split: str | None = None, limit: int | None = None,
                 order_cols: list[str] | None = None) -> DataFrame:
    """One split of a dataset folder, or all splits with a ``split`` column (null kept).

    Every split is a branch with its name as a literal, so a filter on ``split`` drops the other branches from the
    plan before any of their files is opened. ``limit`` takes the first rows: of ``order_cols``, else of the stored
    order if the folder has one (only the files that hold those rows are read), else of all columns."""
    folders = split_folders(spark, path)
    if split is not None:
        if split not in folders:
            raise ValueError(f"no split {split!r} in {path}; there are {', '.join(sorted(str(k) for k in folders)) or 'none'}")
        if limit is not None and not order_cols and _has_manifest(spark, path):
            return read_in_order(spark, path, split, limit).drop("rank")
        df = _read_folder(spark, folders[split])
    elif folders:
        frames = [_read_folder(spark, folder).withColumn("split", F.lit(name).cast("string")) for name, folder in folders.items()]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    else:
        df = spark.read.parquet(path)
    if limit is not None:
        df = df.orderBy(*(order_cols or df.columns)).limit(limit)
    return df


def _has_manifest(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/{MANIFEST}")
    return fs.exists(p)


def read_in_order(spark: SparkSession, path: str, split: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a split (None: of a dataset without splits) with their ``rank`` in the stored order.

    The manifest, one row per file, tells where each file begins; ``limit`` leaves out files that begin after it."""
    folder = path if split is None else split_folders(spark, path)[split]
    manifest = spark.read.parquet(f"{path}/{MANIFEST}").where(F.col("folder") == folder.rsplit("/", 1)[1])
    if limit is not None:
        manifest = manifest.where((F.col("start") < limit) | (F.col("start") == 0))
        files = [f"{folder}/{r['file']}" for r in manifest.select("file").collect()]  # as many as hold the first rows
        rows = spark.read.parquet(*files)
    else:
        rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    columns = rows.columns
    file, at, start, of = free_names(rows, "_file", "_at", "_start", "_of", taken=("rank",))
    rows = rows.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
    out = rows.join(manifest.select(F.col("file").alias(of), F.col("start").alias(start)), F.col(file) == F.col(of))
    out = out.select(*columns, (F.col(start) + F.col(at)).alias("rank"))
    return out if limit is None else out.where(F.col("rank") < limit)


def read_markdown_tree(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """S3: every ``*.md`` below each directory, one row per file: ``source`` = the directory as given,
    ``chapter`` = the file's path below it (so files of one name in several folders stay apart), ``text``."""
    frames = []
    for d in dirs:
        df = spark.read.text(d, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
        fs, p = _fs(spark, d)
        root = fs.makeQualified(p).toUri().getPath().rstrip("/")
        below = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        frames.append(df.select(F.lit(d).alias("source"), F.substring_index(below, f"{root}/", -1).alias("chapter"), F.col("value").alias("text")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """Names without white space around them; blank lines and lines starting with '#' skipped."""
    lines = spark.read.text(path)
    return lines.filter(~F.col("value").startswith("#") & (py_strip("value") != "")).select(
        py_strip("value").alias("name"))


def load_prompt(path: str | None, fallback: str | None = EXPORT_FALLBACK_PROMPT) -> str:
    """Stripped prompt text; a missing file falls back with a warning
    (or raises when no fallback is given)."""
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return f.read().strip()
    if fallback is None:
        raise FileNotFoundError(path)
    warnings.warn(f"{path!r} holds no prompt; the built-in one is used: {fallback}")
    return fallback
