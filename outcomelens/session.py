"""Session settings used by the tests and the benchmark; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str, cores: int | str = "*", memory: str = "8g") -> SparkSession:
    n = cores if isinstance(cores, int) else 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "localhost")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
