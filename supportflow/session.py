"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: AQE (runtime coalescing and skew-join splitting),
# UTC session time, Arrow for the few pandas steps, no UI server.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_settings(input_bytes: int, executor_cores: int = 1000 * 4) -> dict:
    """Settings for a cluster run over ``input_bytes`` of input (pass them to the session
    builder or spark-submit; ``spark.checkpoint.dir`` must name a shared folder as well).

    Scan splits of 512 MB; about one shuffle partition per 2 GB of input, at least two waves
    of tasks and at most 50,000 partitions (the map x reduce block count grows with the
    product, and AQE splits what turns out skewed); AQE coalesces small partitions
    towards 128 MB at run time and splits skewed join partitions (five times the median and
    over 512 MB). Broadcasts stay behind the planner's size check (10 MB); the library only
    forces a broadcast for tables with a stated bound.
    """
    parts = min(50000, max(2 * executor_cores, -(-input_bytes // (2 << 30))))
    return {
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(10 << 20),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def get_spark(cpus: int | str = "*", shuffle_partitions: int | None = None,
              app: str = "supportflow", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's session."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.setdefault("spark.driver.memory", os.environ.get("SUPPORTFLOW_DRIVER_MEM", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of this run deleted when the application ends, on any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


BROADCAST_ROWS = 200_000


def small_side(df, rows: int = BROADCAST_ROWS):
    """``df`` with a broadcast hint while it has at most ``rows`` rows, else as it is (the
    planner then joins by shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df):
    """The rows over all cores if the input has fewer partitions than there are cores (a small
    table, or one file of one row group); a large input stays where it is read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def written(df, what: str = "table"):
    """``df`` written once as Parquet to the shared folder and read back (deleted when the
    application ends): cuts the lineage and keeps columns prunable."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def _workers_see_package(sc, root: str) -> bool:
    """Local mode only: workers start in the driver's working folder with its PYTHONPATH."""
    if not sc.master.startswith("local"):
        return False
    paths = [os.getcwd()] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return any(os.path.realpath(p) == os.path.realpath(root) for p in paths)


def ship_package(spark: SparkSession) -> None:
    """Make ``supportflow`` importable on every executor's Python workers (the pandas steps
    run library code there). On a cluster, and in local mode when the workers' folder and
    path do not hold the package, it is zipped in memory, written into the shared checkpoint
    folder and added with ``addPyFile``, as ``--py-files`` would. (A local run from the
    repository skips it: imports from a zip cannot cache compiled modules.) Once per
    application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import io
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    if _workers_see_package(sc, root):
        _SHIPPED.add(sc.applicationId)
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles/supportflow.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local-mode session without that setting (tests, bench) gets a scratch folder of
    its own; a cluster session must name a shared folder, otherwise this raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir() or named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative jobs")
    path = tempfile.mkdtemp(prefix="supportflow-ckpt-")
    delete_on_exit(spark, path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
