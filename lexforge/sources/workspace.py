"""Places for files that a query writes and reads again."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, deleted when the application ends. Where that is unset: of a local session in a
    temporary folder, on a cluster in the warehouse, which executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        where = tempfile.mkdtemp(prefix="lexforge-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lexforge"
        spark.conf.set("spark.checkpoint.dir", where)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()
