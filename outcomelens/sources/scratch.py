"""Intermediate tables that outlive the loss of an executor.

A result that several jobs read is written once, as Parquet, to the shared folder the cluster names
in ``spark.checkpoint.dir``: lineage ends there and later jobs prune its columns. A session without that
setting uses a folder in its warehouse, which is shared as well unless it is a local folder: that is refused on a cluster.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not context.master.startswith("local"):
            raise ValueError(f"executors do not share {warehouse}: set spark.checkpoint.dir to a folder that they do")
        folder = f"{warehouse.rstrip('/')}/_scratch"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes tables to the shared folder. They go at the end of a ``with`` block or of the application.

    >>> with Scratch(spark) as scratch:
    ...     rows = scratch.table(df)
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.folder(name)
        # the shuffles behind a table are of no use once it is written, so their files go at once
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A path of its own for files that tasks write; they go with the tables."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid4().hex}"
        self.paths.append(path)
        files, place = self._files(path)
        files.deleteOnExit(place)
        return path

    def release(self, path: str) -> None:
        """Deletes one table before the others; nothing may read it any more."""
        files, place = self._files(path)
        files.delete(place, True)
        self.paths.remove(path)

    def drop(self) -> None:
        for path in self.paths:
            files, place = self._files(path)
            files.delete(place, True)
        self.paths = []

    def _files(self, path: str):
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(context._jsc.hadoopConfiguration()), place

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_exc) -> None:
        self.drop()
