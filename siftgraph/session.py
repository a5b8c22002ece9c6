"""Session construction and checkpoint placement."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SPREAD_BYTES = 64 << 20
ARROW_BYTES = 4 << 20


def build_session(app: str = "siftgraph", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators assume.

    Only a local master pins the number of shuffle partitions; on a cluster it is
    left to the cluster's own setting and AQE coalescing.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers then import it wherever the driver was started from. Arrow batches are
    bounded in bytes, because texts are long and both the JVM and the worker hold a batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if getattr(context, "_siftgraph_shipped", False):
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    target = Path(folder) / f"{package.name}.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    context._siftgraph_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineages: the cluster's setting, else a test folder.

    A machine-local folder is used only where nothing is configured and the master
    is local.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY, None
    )
    if configured:
        root = configured
    else:
        active = spark.sparkContext._jsc.sc().getCheckpointDir()
        if active.isDefined():
            return active.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative job's state."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later uses neither recompute nor depend on the executors that wrote it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def narrow_batches(spark: SparkSession):
    """For jobs run inside on many small rows: Arrow batches are bounded in rows alone.

    The bound in bytes is looked up for every row, which costs more than a small row itself.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scanned_bytes(df: DataFrame) -> int:
    """Size of the tables that a plan scans, each as often as it is scanned; rows of an RDD have no known size."""
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [plan.apply(i) for i in range(plan.size())]
    return sum(int(str(x.stats().sizeInBytes())) for x in leaves if x.nodeName() != "LogicalRDD")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy row work on a small file at least one partition per core.

    Only scans of at most ``SPREAD_BYTES`` with fewer partitions than cores (a file in one
    row group) are redistributed by ``keys``; anything larger is read as it lies.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
