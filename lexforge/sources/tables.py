"""Keyed tables on Parquet: upsert, lookup, delete, tensor segments. A change writes a new version beside the old one."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new: columns that new has replace those of the same keys, other rows are added. Of several new
    rows of a key the last by all columns counts."""
    new = new.groupBy(*keys).agg(*(F.max_by(c, F.struct(*new.columns)).alias(c) for c in new.columns if c not in keys))
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")

    def value(c: str):
        sides = ([F.col(f"b.{c}")] if c in new.columns else []) + ([F.col(f"a.{c}")] if c in old.columns else [])
        if len(sides) == 1:
            return sides[0].alias(c)
        return F.when(F.col("b._new"), sides[0]).otherwise(sides[1]).alias(c)

    return joined.select(*map(value, columns))


def merged_arrays(old: DataFrame, new: DataFrame, key: str, values: str) -> DataFrame:
    """(key, union of both arrays)."""
    both = old.select(key, values).unionByName(new.select(key, values)).groupBy(key).agg(F.flatten(F.collect_list(values)).alias(values))
    return both.select(key, F.array_sort(F.array_distinct(values)).alias(values))


class VersionedTable:
    """A table in path; a write makes a version and then names it, so readers see the old or the new one whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in (fs.listStatus(where) if fs.exists(where) else []) if s.getPath().getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def read(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        number = int(self._versions()[-1][1:9]) + 1 if self._versions() else 0
        df.write.parquet(f"{self.path}/v{number:08d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        self.write(upserted(self.read(), new, keys))

    def delete(self, condition: str) -> None:
        self.write(self.read().where(f"NOT coalesce({condition}, FALSE)"))

    def first(self, condition: str):
        return self.read().where(condition).first()

    def add(self, rows: DataFrame) -> None:
        self.write(self.read().unionByName(rows))

    def update(self, values: DataFrame, keys: list[str]) -> bool:
        """An upsert; whether a row that was there has changed (False where all were new or the same)."""
        old = self.read()
        columns = [c for c in values.columns if c not in keys]
        both = old.alias("a").join(values.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
        differ = F.lit(False)
        for c in columns:
            differ |= ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c in old.columns else F.lit(True)
        changed = not both.where(differ).isEmpty()
        self.upsert(values, keys)
        return changed

    def delete_first(self, condition: str, order: list[str]) -> bool:
        """Deletes the first row, in that order, that meets the condition; of equal rows one."""
        table = self.read()
        row = table.where(condition).orderBy(*order, *(c for c in table.columns if c not in order)).limit(1)
        if row.isEmpty():
            return False
        self.write(table.exceptAll(row))
        return True

    def records(self, condition: str = "TRUE") -> tuple[DataFrame, int, int]:
        """The rows that meet the condition, the number of all rows, and theirs."""
        table = self.read()
        total, met = table.agg(F.count("*"), F.count_if(F.coalesce(F.expr(condition), F.lit(False)))).first()
        return table.where(condition), total, met


class Store:
    """Named tables in one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def collection(self, name: str, schema: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}", schema)


SEGMENTS = "segment_id string, shape array<int>, dtype string, num_elements bigint, chunk_no int, data array<float>"
CHUNK = 100_000


def segment_rows(spark: SparkSession, segment_id: str, values: list[float], shape: list[int]) -> DataFrame:
    rows = [(segment_id, shape, "float32", len(values), n // CHUNK, values[n : n + CHUNK]) for n in range(0, max(1, len(values)), CHUNK)]
    return spark.createDataFrame(rows, SEGMENTS)


def segment(table: DataFrame, segment_id: str) -> tuple[list[float], list[int]]:
    """Values and shape of a segment; ValueError for an unknown one."""
    row = table.where(F.col("segment_id") == segment_id).groupBy("shape").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "data"))), lambda x: x["data"])).alias("data")).first()
    if row is None:
        raise ValueError(f"no segment {segment_id}")
    return row.data, row["shape"]


class SegmentStore:
    """Tensors in a folder of Parquet parts or, as a container, in parts that are one file for each save."""

    def __init__(self, spark: SparkSession, path: str, container: bool = False) -> None:
        self.spark, self.path, self.container = spark, path, container

    def save(self, rows: DataFrame) -> None:
        """Rows of SEGMENTS; chunks are dealt to files by segment, so that a segment's chunks stand together."""
        rows = rows.coalesce(1) if self.container else rows.repartition("segment_id")
        rows.sortWithinPartitions("segment_id", "chunk_no").write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SEGMENTS).parquet(self.path)

    def ids(self) -> DataFrame:
        return self.read().select("segment_id").distinct()

    def info(self, segment_id: str) -> dict:
        """Shape, dtype and number of elements; ValueError for an unknown segment."""
        row = self.read().where(F.col("segment_id") == segment_id).select("shape", "dtype", "num_elements").first()
        if row is None:
            raise ValueError(f"no segment {segment_id}")
        return row.asDict()

    def load(self, segment_id: str) -> tuple[list[float], list[int]]:
        return segment(self.read(), segment_id)


def tensors(table: DataFrame) -> DataFrame:
    """(segment_id, shape, dtype, num_elements, data) of all segments, each whole: for segments that fit a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "data"))), lambda x: x["data"])
    return table.groupBy("segment_id", "shape", "dtype", "num_elements").agg(F.flatten(parts).alias("data"))
