"""Sessions for local use; on a cluster, pass your own session to every function."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "4g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodeglass")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
