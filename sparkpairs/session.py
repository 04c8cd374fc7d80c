"""Session construction and lineage cutting.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; it is
read from the session and only filled in with a scratch folder when unset (local
tests). Lineage is cut with reliable ``checkpoint()``, never ``localCheckpoint``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes of a logical plan that run behind an exchange (``Repartition n, false`` is a coalesce).
_EXCHANGES = re.compile(r"^[ :+-]*(Aggregate|Join|Window|WindowGroupLimit|Sort|GlobalLimit|Distinct|Except|Intersect|RepartitionByExpression|"
                        r"RebalancePartitions|RepartitionById|Repartition [0-9]+, true)\b", re.MULTILINE)

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints taken inside operators are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the error chain is a deep statement, resolved a level per iteration
    "spark.sql.analyzer.maxIterations": "2000",
    # Python workers (epub parsing, user tokenizers/correctors) get Arrow batches.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def get_session(app: str = "sparkpairs", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that it need not be installed on the executors or lie in
    the folder the driver was started from. A context gets it once."""
    context = spark.sparkContext
    if getattr(context, "_sparkpairs_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="sparkpairs-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)  # read by the driver, which hands it to the executors
    context._sparkpairs_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="sparkpairs-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    jsc = spark.sparkContext._jsc
    current = jsc.sc().getCheckpointDir()
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    return os.path.join(checkpoint_dir(spark), name)


def plan_barrier(df: DataFrame, tag: str) -> DataFrame:
    """An optimizer fence: predicates and projections are not pushed through it.

    Used after long per-row expression chains (so a later filter is not
    substituted into every step, which grows expressions exponentially) and
    after unions (so a later chain is not planned once per branch). It is a
    metrics observation node costing one counter per task.
    """
    return df.observe(f"sparkpairs_{tag}_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))


def filter_barrier(df: DataFrame, made: list[str]) -> DataFrame:
    """An optimizer fence around the columns ``made`` only.

    They pass through a generator of one row, behind which no expression is substituted; a predicate on the
    other columns goes below it, down to the scan."""
    kept = [F.col(c) for c in df.columns if c not in made]
    one = F.inline_outer(F.array(F.struct(*made)))
    return df.select(*kept, one).select(*df.columns)


def spread(df: DataFrame, key: str | list[str], per_core: int = 4) -> DataFrame:
    """Hash-distribute rows before CPU-heavy per-row text work when the input
    is narrower than the cluster (few large files or row groups).

    Decided at plan time from the scan's partition count: on a large input the
    scan is already wide and no shuffle is added. An input that comes out of a join, an aggregate or another
    exchange is left as it is: its partitions would be known only after running it, which this never does.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism * per_core
    if _EXCHANGES.search(df._jdf.queryExecution().optimizedPlan().toString()) or df.rdd.getNumPartitions() >= want:
        return df
    keys = [key] if isinstance(key, str) else list(key)
    return df.repartition(want, *keys)


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions for work that needs memory in proportion to a partition's rows: one for each ``bytes_each`` bytes that
    the scan reports (files as stored), the session's shuffle partitions at least. What comes out of an exchange has
    no known size before it runs; the session's number holds then, and the scan's own for rows of a collection or RDD."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    if _EXCHANGES.search(plan.toString()):
        return least
    size = int(str(plan.stats().sizeInBytes()))
    if size >> 50:  # Spark's mark of an unknown size
        return max(least, df.rdd.getNumPartitions())
    return max(least, size // bytes_each + 1)


def tune_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20,
                   text_heavy: bool = True) -> dict[str, str]:
    """Size shuffles and scans for a given input volume (e.g. 100 TB).

    * shuffle partitions: enough that each holds ~``target_partition_bytes``
      (never fewer than twice the cores), so sorts and hash aggregates fit in
      executor memory without spilling to death;
    * scan splits: smaller for text-heavy per-row work (regex chains are
      CPU-bound, so more, smaller tasks balance better);
    * AQE coalescing and skew splitting stay on; the advisory size follows
      the target.
    Returns the settings applied.
    """
    cores = max(spark.sparkContext.defaultParallelism, 1)
    partitions = max(2 * cores, -(-int(input_bytes) // int(target_partition_bytes)))
    split = (64 << 20) if text_heavy else (128 << 20)
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
