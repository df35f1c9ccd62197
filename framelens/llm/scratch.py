"""Intermediate tables in the shared folder, deleted as soon as nothing reads them.

Each table is Parquet under ``spark.checkpoint.dir``: it survives lost
executors, is compressed, and its size is known to the planner. The shuffle
files of the job that wrote it are released with the job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, shuffles_released


class Scratch:
    """Tables of one operator run. ``keep`` writes one, ``drop`` deletes those named, ``close`` all but those named."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.live: dict[str, DataFrame] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns it as read back; a name is used once."""
        path = f"{self.folder}/{name}"
        with shuffles_released(self.spark):
            df.write.parquet(path)
        self.live[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.live[name]

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self.live.pop(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, *but: str) -> None:
        self.drop(*[name for name in self.live if name not in but])
