"""Similarity, retrieval and clusters of vectors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.plans.dialect import Dialect, built, plan

#: Queries of a block that is sent to executors: 64-dimensional vectors make 512 KB.
BLOCK, TOP = 1024, 10


def dot(d: Dialect, a: str, b: str) -> str:
    if d.spark:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@plan("V01 V02 V09 X4")
def neighbour_similarity(d: Dialect) -> str:
    """Cosine of each vector and the next by id; 0 where a norm is nearly 0."""
    n = f"sqrt({dot(d, 'a.embedding', 'a.embedding')}) * sqrt({dot(d, 'b.embedding', 'b.embedding')})"
    return f"SELECT a.vec_id, round(CASE WHEN {n} < 1e-10 THEN 0 ELSE {dot(d, 'a.embedding', 'b.embedding')} / ({n}) END, 5) + 0.0 AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@plan("V04 V05 J21")
def label_centroids(d: Dialect) -> str:
    """Mean of each place of the vectors of a label."""
    return f"SELECT label, CAST(place AS BIGINT) AS place, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 5) + 0.0 AS mean FROM embeddings {d.each_at('embedding', 'place', 'x')} GROUP BY label, place"


MOST_SIMILAR = f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(e, embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS c FROM q, embeddings WHERE query_id <> vec_id)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, vec_id) AS place, round(c, 4) AS similarity FROM s QUALIFY place <= {TOP}"""


def most_similar_to(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, vec_id, place and cosine of the k nearest of all vectors: queries in blocks, a matrix product a batch, the
    best k of each batch and then of all."""
    spark = vectors.sparkSession
    found, block = None, []

    def nearest(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries_, unit = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(len(own), -1).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                cosine = np.where(norm > 1e-10, unit @ x.T / np.maximum(norm, 1e-30), 0)
                for i, q in enumerate(queries_):
                    keep = np.lexsort((own, -np.round(cosine[i], 6)))[: k + 1]
                    keep = keep[own[keep] != q][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), q)), pa.array(own[keep]), pa.array(cosine[i][keep])], names=["query_id", "vec_id", "cosine"])

        return vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "query_id long, vec_id long, cosine double")

    rows = queries.select("vec_id", "embedding").where("embedding is not null").toLocalIterator()
    for row in rows:
        block.append((row.vec_id, row.embedding))
        if len(block) == BLOCK:
            part = nearest(np.array([i for i, _ in block]), np.array([e for _, e in block], np.float64))
            found, block = part if found is None else found.unionByName(part), []
    if block:
        part = nearest(np.array([i for i, _ in block]), np.array([e for _, e in block], np.float64))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, vec_id long, place long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.round("cosine", 6).desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k).select("query_id", "vec_id", "place", F.round("cosine", 4).alias("similarity"))


@built("O03 V01 J21 X2", MOST_SIMILAR)
def most_similar(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return most_similar_to(vectors, vectors.where("vec_id % 20 = 0"))


@built("V03 V05 V08")
def clusters(spark, sf_dir: str) -> DataFrame:
    """k-means of all vectors, and the size of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=8, seed=1, maxIter=10).fit(vectors)
    return model.transform(vectors).groupBy(F.col("prediction").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"))


@built("J21")
def nearest_in_cluster(spark, sf_dir: str) -> DataFrame:
    """Each query's most similar vector among those of its label's cluster: an equi-join on the cluster, then the best."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    unit = lambda e: F.transform(e, lambda x: x.cast("double"))
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", unit("embedding").alias("q"))
    c = v.select("vec_id", "label", unit("embedding").alias("e"))
    cosine = inner(F.col("q"), F.col("e")) / F.sqrt(inner(F.col("q"), F.col("q"))) / F.sqrt(inner(F.col("e"), F.col("e")))
    pairs = q.join(c, "label").where("query_id <> vec_id").select("query_id", "vec_id", F.round(cosine, 6).alias("c"))
    return pairs.groupBy("query_id").agg(F.max_by("vec_id", F.struct("c", -F.col("vec_id"))).alias("vec_id"), F.max("c").alias("similarity"))
