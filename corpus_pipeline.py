"""From raw documents to a training order: five stages, each written as Parquet and read again by the next.

Rows, not ids, are judged: rows of one doc_id and text are one document for the near-duplicate stage, which keeps one of
them; different texts of one doc_id are different documents. Rows of a null doc_id are kept by every filter that doesn't
reject their own text. An empty table stays empty; a text of any length is one document; of further columns, none is read
or returned.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm import decontamination, mixture, near_duplicates, pseudonyms, quality, scratch

#: Similarity of word shingles from which documents are one.
SIMILARITY = 0.8
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likely, by a model of the labelled ones."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs.select(*COLUMNS), model)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near duplicates."""
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null").withColumn("id", F.col("doc_id"))
    texts = named.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("first"), F.max(F.xxhash64("text")).alias("other"))
    if not texts.where("first <> other").isEmpty():
        # Further texts of an id come after all ids, under 62 bits of a hash.
        own = F.when(F.xxhash64("text") == F.col("first"), F.col("doc_id")).otherwise(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62))
        named = named.drop("id").join(texts, "doc_id").withColumn("id", own)
    kept = near_duplicates.near_duplicates(named.select(F.col("id").alias("doc_id"), "text"), SIMILARITY).where("kept").select(F.col("doc_id").alias("id")).distinct()
    first = Window.partitionBy("id").orderBy("source", "lang", "n_chars")
    single = named.join(kept, "id", "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").select(*COLUMNS)
    return single.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words are benchmark passages."""
    docs = docs.select(*COLUMNS)
    found = decontamination.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = decontamination.contaminated(found).where("contaminated").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    return docs.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_hash") == F.xxhash64("text")), "left_anti")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data under format-preserving pseudonyms."""
    return pseudonyms.pseudonymise(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, in training order."""
    return mixture.mix(docs.select(*COLUMNS))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_copy),
    ("decontamination", drop_contaminated),
    ("pseudonyms", hide_personal_data),
    ("mixture", mix_sources),
]
#: No stage but the last can be said in SQL: models, sketches and keyed permutations; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
