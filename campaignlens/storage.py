"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local session gets a folder of its own; on a cluster it is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="campaignlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: this cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Lines of a task where tables lie in buckets: it sorts them in memory.
LINES = 500_000
BUCKETS = "campaignlens.buckets"


def size_buckets(spark: SparkSession, lines: int) -> None:
    """Tables that are ``placed`` from here on have a bucket for each ``LINES`` of so many, and at least ``spark.sql.shuffle.partitions``, so that tasks do not spill."""
    spark.conf.set(BUCKETS, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // LINES))))


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get(BUCKETS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def placed(df: DataFrame, *keys: str, spread: bool = True) -> DataFrame:
    """Like ``materialize``, in buckets by ``keys``: what is read again is joined and grouped by them and more columns without a shuffle.

    Joins merge it, whatever its size: a file of a few MB may be millions of rows, which a broadcast would hold in the driver.
    ``spread`` is false for rows that lie by ``keys`` already, though Spark does not know it. The catalogue keeps no entry.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n = buckets(spark)
    name = f"placed_{uuid.uuid4().hex}"
    rows = df.repartition(n, *keys) if spread else df
    rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name).hint("merge")
    spark.sql(f"DROP TABLE {name}")
    out.written_to = f"{shared_dir(spark)}/{name}"
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
