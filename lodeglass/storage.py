"""Tables kept between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FILES_PER_CORE = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without that setting, a temporary one in local mode (tests); a cluster's executors share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodeglass-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: later plans start there, and lost executors lose nothing.

    Where the number of cores is fixed, a table has at most `FILES_PER_CORE` files for each: rounds over narrow rows would else leave a small file per shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeglass/{tag}-{uuid.uuid4().hex}"
    fixed = spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() != "true"
    (df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism) if fixed else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` gave and that no plan reads any more."""
    for t in tables:
        if path := getattr(t, "_table", None):
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh_name(df: DataFrame, wish: str) -> str:
    """A column name that `df` does not have yet (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, wish
    while name.lower() in taken:
        name = "_" + name
    return name
