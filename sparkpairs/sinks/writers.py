"""Dataset, chat-export, results, card, lineage and trial writers (K1-K7).

Data is written by executors (``DataFrameWriter``); only summaries of a fixed size
(the largest groups of a card) reach the driver to be put into a README.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpairs.operators.profile import dataset_fingerprint

CARD_ROWS = 100  # groups shown by a dataset card


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text_file(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8").removesuffix("\n")
    finally:
        stream.close()


#: Names that begin with "_" are passed over by readers of the folder.
CARD = "_README.md"
COUNTS = "_counts"
MANIFEST = "_manifest"
#: What a split is called in a chat export.
CHAT_FILES = {"train": "train.jsonl", "test": "valid.jsonl"}


def write_dataset(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """K1: one Parquet folder per split (``<dir>/split=<name>``), many files each."""
    if split_col in df.columns:
        df.write.mode(mode).partitionBy(split_col).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_ordered(ranked: DataFrame, path: str, rank_col: str = "rank", split_col: str = "split") -> None:
    """K1 with a stored order: the files of a split, by number, hold its rows in the order of ``rank_col``.

    ``ranked`` comes from ``sampling.shuffle_rank`` with the split as partition column, whose rows are in order
    already, so nothing is moved here. The rank is not written: ``_manifest`` keeps the position of each file's
    first row, and a row's place in its file gives the rest."""
    write_dataset(ranked.drop(rank_col), path, split_col)
    spark = ranked.sparkSession
    at = F.regexp_extract("file", r"part-([0-9]+)", 1).cast("bigint")
    by_split = Window.partitionBy("folder").orderBy("number", "file")  # one row per file
    files = (spark.read.option("recursiveFileLookup", "true").parquet(path)  # footers only: no column is read
             .groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("rows"))
             .select(F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("folder"),
                     F.regexp_extract("file_path", r"([^/]+)$", 1).alias("file"), "rows"))
    files = files.withColumn("number", at).withColumn("start", F.sum("rows").over(by_split) - F.col("rows"))
    files.select("folder", "file", "start", "rows").coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def write_chat_jsonl(df: DataFrame, path: str, split_col: str = "split", text_col: str = "text",
                     mode: str = "overwrite", files: dict[str, str] | None = None) -> None:
    """K2: ``train.jsonl`` and ``valid.jsonl`` (from ``test``), in one pass; rows ``{"text": ...}``.

    ``files`` names another file per split. A row of a split without a file, or of none, ends the write with an
    error that names the split: no row is left out."""
    if split_col not in df.columns:
        raise ValueError(f"no column {split_col!r} to tell train from test rows")
    files = files or CHAT_FILES
    name = F.raise_error(F.concat(F.lit("no chat file for split "), F.coalesce(F.col(split_col).cast("string"), F.lit("(null)"))))
    for split, file in files.items():
        name = F.when(F.col(split_col) == split, F.lit(file)).otherwise(name)
    spark = df.sparkSession
    part = f"{path}/_writing-{uuid.uuid4().hex}"
    df.select(F.col(text_col).alias(text_col), name.alias("file" if text_col != "file" else "file_")) \
        .write.partitionBy("file" if text_col != "file" else "file_").option("ignoreNullFields", "false").json(part)
    fs, at = _fs(spark, part)
    key = "file" if text_col != "file" else "file_"
    jvm = spark.sparkContext._jvm
    for file in files.values():
        made, to = jvm.org.apache.hadoop.fs.Path(f"{part}/{key}={file}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{file}")
        if fs.exists(to):
            if mode != "overwrite":
                raise FileExistsError(f"{path}/{file}")
            fs.delete(to, True)
        if fs.exists(made):
            fs.rename(made, to)
        else:
            fs.mkdirs(to)
    fs.delete(at, True)


def write_results_json(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """K3: evaluation records as JSON lines (non-ASCII kept); only json is supported."""
    if fmt != "json":
        raise ValueError(f"results are written as json, not as {fmt!r}")
    df.write.mode(mode).json(path)


def write_dataset_card(df: DataFrame, path: str, title: str, sources: list[str] | None = None,
                       params: dict | None = None, split_col: str = "split", top: int = CARD_ROWS) -> str:
    """K4: README with sources, columns, parameters and the rows per split and source.

    The whole table of counts is written beside it (``_counts``, Parquet, largest first in each split); the card
    shows the ``top`` largest groups and one line for all others, so its size does not grow with the sources."""
    groups = [c for c in (split_col, "source") if c in df.columns]
    lines = [f"# {title}", ""]
    if sources:
        lines += ["## Sources", ""] + [f"- {s}" for s in sources] + [""]
    lines += ["## Format", ""] + [f"- `{c}`" for c in df.columns] + [""]
    if params:
        lines += ["## Parameters", ""] + [f"- {k}: {v}" for k, v in params.items()] + [""]
    if groups:
        by = [F.asc_nulls_first(split_col)] if split_col in groups else []
        largest = [*by, F.desc("n"), *[F.asc_nulls_first(g) for g in groups]]
        counts = f"{path}/{COUNTS}"
        profile_counts(df, groups).orderBy(*largest).write.mode("overwrite").parquet(counts)
        stats = df.sparkSession.read.parquet(counts)
        shown = stats.orderBy(F.desc("n"), *[F.asc_nulls_first(g) for g in groups]).limit(top).collect()
        n_groups, n_rows = stats.agg(F.count(F.lit(1)), F.sum("n")).first()
        shown.sort(key=lambda r: [(r[g] is not None, str(r[g])) for g in groups])
        lines += ["## Rows", "", "| " + " | ".join(groups) + " | rows |", "|" + " --- |" * (len(groups) + 1)]
        lines += ["| " + " | ".join(str(r[g]) for g in groups) + f" | {r['n']} |" for r in shown]
        if n_groups > len(shown):
            rest = n_rows - sum(r["n"] for r in shown)
            lines += ["| " + " | ".join([f"{n_groups - len(shown)} others", *[""] * (len(groups) - 1)]) + f" | {rest} |"]
    text = "\n".join(lines) + "\n"
    write_text_file(df.sparkSession, f"{path}/{CARD}", text)
    return text


def profile_counts(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def copy_dataset_card(spark: SparkSession, src_dir: str, dst_dir: str) -> bool:
    """K5: carry the card along with a subset."""
    text = read_text_file(spark, f"{src_dir}/{CARD}")
    if text is None:
        return False
    write_text_file(spark, f"{dst_dir}/{CARD}", text + "\n")
    return True


def register_fingerprint(df: DataFrame, lineage_path: str, run_id: str, split_col: str = "split") -> DataFrame:
    """K6: append ``(run_id, split, n, fingerprint, schema)`` to a lineage table."""
    groups = [split_col] if split_col in df.columns else []
    fp = dataset_fingerprint(df, groups)
    fp = fp.select(F.lit(run_id).alias("run_id"),
                   (F.col(split_col) if groups else F.lit(None).cast("string")).alias("split"),
                   "n", "fingerprint", F.lit(df.schema.json()).alias("schema_json"),
                   F.lit(_dt.datetime.now(_dt.timezone.utc).isoformat()).alias("registered_at"))
    fp.write.mode("append").parquet(lineage_path)
    return fp


def export_trials(trials: DataFrame, path: str, direction: str = "minimize") -> None:
    """K7: best trial, best value, best params and every trial in one JSON record.

    ``trials``: ``trial, value, params (map), user_attrs (map)``; one row per
    trial, so the single output record is bounded by the tuning budget.
    """
    signed = F.col("value") if direction == "minimize" else -F.col("value")
    key = F.when(F.col("value").isNull() | F.isnan("value"), F.lit(float("inf"))).otherwise(signed)
    order = F.struct(key.alias("k"), F.col("trial").alias("t"))  # ties go to the lowest trial
    best = F.min_by(F.struct("trial", "value", "params"), order)
    rec = trials.agg(
        best["trial"].alias("best_trial"),
        best["value"].alias("best_value"),
        best["params"].alias("best_params"),
        F.array_sort(F.collect_list(F.struct("trial", "value", "params", "user_attrs")),
                     lambda a, b: F.when(a["trial"] < b["trial"], -1).when(a["trial"] > b["trial"], 1).otherwise(0)
                     ).alias("all_trials"),
    )
    rec.coalesce(1).write.mode("overwrite").json(path)


def trials_from_json(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Helper for tests and small studies: trial dicts to a DataFrame."""
    rows = [(int(r["trial"]), float(r["value"]) if r.get("value") is not None else None,
             {k: json.dumps(v) for k, v in (r.get("params") or {}).items()},
             {k: json.dumps(v) for k, v in (r.get("user_attrs") or {}).items()}) for r in records]
    return spark.createDataFrame(rows, "trial int, value double, params map<string,string>, user_attrs map<string,string>")
