"""Tables written in the folder that the cluster shares, to cut lineage and survive lost executors."""

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: of a local session a temporary folder, on a cluster one
    in the warehouse, which executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            where = tempfile.mkdtemp(prefix="lexforge-")
        else:
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lexforge"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again; deleted when the application ends, if drop() hasn't done so before."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexforge_path = path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by saved() that no later result reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lexforge_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of jobs that have ended, before others take as much disk again. The driver's
    cleaner works beside this thread, hence the pauses."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)
