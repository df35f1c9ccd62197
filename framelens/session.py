"""Session and lineage helpers.

The library never assumes local mode: the only settings it writes are the
ones a test or a laptop run is missing (the checkpoint folder). On a cluster
``spark.checkpoint.dir`` names a shared folder and is taken as given.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "framelens") -> SparkSession:
    """Session for tests, the bench and local runs (UI off, AQE on, UTC)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FRAMELENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session has none (tests, local runs) is a fresh folder
    created; on a cluster the configured shared folder is used unchanged.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Connect session manages checkpoints server-side
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith(("local[", "local-cluster")) and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="framelens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Jobs of queries begun inside delete their shuffle files when they end, not when the driver collects its garbage."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (the data is in the shared folder, not on the
    executors' local disks), unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table into the shared checkpoint folder and rereads it.

    For long loops: a reread table starts a new plan, while a checkpoint
    hands the old plan's constraints on, which multiply from round to round.
    The tables are deleted on leaving, so a result has to be kept outside;
    the shuffle files of a write go with its job.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    numbers = itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(numbers)}"
        with shuffles_released(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
