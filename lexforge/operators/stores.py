"""Sources and sinks at work: each query writes a whole table in one of the formats, reads it again and returns what it read."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators import registry, roots
from lexforge.operators.affixes import word_frequencies
from lexforge.plans.dialect import CATALOGUE, DUCKDB, SPARK, built
from lexforge.sources import files, tables
from lexforge.sources.workspace import place
from lexforge.streaming import state


@built("S01 S02 S04 S05 S06", "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS part, length(text) AS n FROM documents")
def parquet_parts_again(spark, sf_dir: str) -> DataFrame:
    """Documents in two named parts of bounded files, read as one table, and built once more only where missing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = place(spark, "parts")
    for n, name in enumerate(("even", "odd")):
        files.save_parts(docs.where(F.pmod("doc_id", F.lit(2)) == n).select("doc_id", "lang", F.lit(name).alias("part"), F.length("text").cast("long").alias("n")), files.part_name(f"{path}/docs", n), 64, 4096)
    made = files.build_if_missing(spark, f"{path}/built", lambda: files.parquet_parts(spark, f"{path}/docs"))
    return files.build_if_missing(spark, f"{path}/built", lambda: made.limit(0)).select("doc_id", "lang", "part", "n")


@built("S07 S08", "SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS title, c_mktsegment AS segment FROM customer")
def tab_separated_customers(spark, sf_dir: str) -> DataFrame:
    """Customers as tab-separated lines under a header, some blank or of another width, parsed again."""
    path = f"{place(spark, 'tsv')}/t"
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    odd = spark.createDataFrame([("code\tname\tsegment",), ("",), ("a\tb",), ("a\tb\tc\td",)], "value string")
    rows.unionByName(odd).write.text(path)
    return files.tab_separated(spark, path, ["code", "name", "segment"], {"name": "title"})


def _dump(spark, sf_dir: str) -> DataFrame:
    """Parts as pages of a compressed dump, in wikitext, read again."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat_ws("\n", F.concat(F.lit("=="), F.col("p_type"), F.lit("==")), F.lit("===Noun==="), F.concat(F.lit("* "), F.col("p_name")), F.concat(F.lit("# <"), F.col("p_brand"), F.lit("> & more")), F.concat(F.lit("==Other "), F.col("p_size"), F.lit("==")), F.lit("* last"))
    path = f"{place(spark, 'dump')}/d.xml"
    files.save_dump(parts.select(F.concat(F.lit("P"), F.col("p_partkey")).alias("title"), F.col("p_brand").alias("comment"), text.alias("text")), path)
    return files.xml_pages(spark, path)


@built("S09 S11 S12 S13 S14 S15", "SELECT 'P' || p_partkey AS title, p_brand AS comment, 6::BIGINT AS n_lines, '==' || p_type || '==' AS first_line, p_type || ',Other ' || p_size AS languages FROM part")
def dump_pages(spark, sf_dir: str) -> DataFrame:
    """Pages of a bzip2 XML dump: title, comment, lines, and the languages that their headings name."""
    return _dump(spark, sf_dir).select("title", "comment", F.size("lines").cast("long").alias("n_lines"), F.element_at("lines", 1).alias("first_line"), F.array_join("languages", ",").alias("languages"))


@built("S11", "SELECT language, count(*) AS n_pages, min(title) AS first_title FROM (SELECT 'P' || p_partkey AS title, p_type AS language FROM part UNION ALL SELECT 'P' || p_partkey, 'Other ' || p_size FROM part) x GROUP BY language")
def dump_languages(spark, sf_dir: str) -> DataFrame:
    """The pages of each language, of all that a page has."""
    rows = _dump(spark, sf_dir).select("title", F.explode("languages").alias("language"))
    return rows.groupBy("language").agg(F.count("*").alias("n_pages"), F.min("title").alias("first_title"))


@built("N14 N17", "SELECT 'P' || p_partkey AS title, p_type AS language, '' AS code, 'Etymology' AS grp, 'noun' AS section, '' AS meaning, item FROM part, LATERAL (SELECT unnest([p_name, '<' || p_brand || '> & more']) AS item) UNION ALL SELECT 'P' || p_partkey, 'Other ' || p_size, '', 'Etymology', '', '', 'last' FROM part")
def lexical_entries(spark, sf_dir: str) -> DataFrame:
    """The items of a dump's pages under their language, etymology group, section and meaning."""
    return files.sections(_dump(spark, sf_dir))


@built("S10 S16 S17 S18 S19 S20 S21 U06", """WITH base AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT -1, 'new', 'NONE', 0.5::DOUBLE),
moved AS (SELECT k, name, CASE WHEN k % 7 = 0 THEN 'MOVED' ELSE segment END AS segment, balance FROM base UNION ALL SELECT -2, 'late', 'MOVED', NULL), gone AS (SELECT min(k) AS k FROM moved WHERE balance > 1000),
kept AS (SELECT * FROM moved WHERE k <> (SELECT k FROM gone))
SELECT segment, count(*) AS n, round(sum(balance), 2) AS balance, (SELECT count(*) FROM kept) AS total, (SELECT count(*) FROM kept WHERE segment = 'MOVED') AS met, TRUE AS changed, FALSE AS changed_again, (SELECT k FROM gone) AS deleted, (SELECT name FROM kept WHERE k = -1) AS found
FROM kept GROUP BY segment""")
def kept_collection(spark, sf_dir: str) -> DataFrame:
    """A named table of customers through adding, bulk and repeated updates, deletion of the first match, lookup and a filtered scan."""
    table = tables.Store(spark, place(spark, "store")).collection("customers", "k long, name string, segment string, balance double")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    table.write(customers.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    table.add(spark.createDataFrame([(-1, "new", "NONE", 0.5)], table.schema))
    moved = customers.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("k"), F.lit("MOVED").alias("segment"))
    changed = table.update(moved, ["k"])
    again = table.update(moved, ["k"])
    table.update(spark.createDataFrame([(-2, "late", "MOVED")], "k long, name string, segment string"), ["k"])
    first = table.read().where("balance > 1000").agg(F.min("k")).first()[0]
    table.delete_first("balance > 1000", ["k"])
    _, total, met = table.records("segment = 'MOVED'")
    found = table.first("k = -1").name
    out = table.read().groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))
    return out.select("*", F.lit(total).cast("long").alias("total"), F.lit(met).cast("long").alias("met"), F.lit(changed).alias("changed"), F.lit(again).alias("changed_again"), F.lit(first).alias("deleted"), F.lit(found).alias("found"))


@built("S22 S23 S24 S25 S26 S27 S28", "SELECT CAST(vec_id AS VARCHAR) AS segment_id, CASE WHEN vec_id % 2 = 0 THEN '8x8' ELSE '64' END AS shape, 'float32' AS dtype, 64::BIGINT AS num_elements, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(embedding[64]::DOUBLE, 4) AS last, (SELECT count(*) FROM embeddings) AS n_ids FROM embeddings")
def stored_segments(spark, sf_dir: str) -> DataFrame:
    """Vectors as tensors of one or two dimensions, half of them in a container, chunked, saved and loaded again."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shape = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(8), F.lit(8))).otherwise(F.array(F.lit(64)))
    whole = rows.select(F.col("vec_id").cast("string").alias("segment_id"), shape.alias("shape"), F.lit("float32").alias("dtype"), F.lit(64).cast("long").alias("num_elements"), "embedding")
    chunks = whole.select("segment_id", "shape", "dtype", "num_elements", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk_no"), "embedding").withColumn("data", F.slice("embedding", F.col("chunk_no") * 16 + 1, F.lit(16))).drop("embedding")
    path = place(spark, "segments")
    stores = [tables.SegmentStore(spark, f"{path}/folder"), tables.SegmentStore(spark, f"{path}/container", True)]
    for n, store in enumerate(stores):
        store.save(chunks.where(F.pmod(F.col("segment_id").cast("long"), F.lit(2)) == n))
    read = stores[0].read().unionByName(stores[1].read())
    ids = stores[0].ids().unionByName(stores[1].ids()).count()
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return tables.tensors(read).select("segment_id", F.array_join("shape", "x").alias("shape"), "dtype", "num_elements", F.round(total, 4).alias("total"), F.round(F.element_at("data", -1).cast("double"), 4).alias("last"), F.lit(ids).cast("long").alias("n_ids"))


@built("S29 S30 S31 S32", CATALOGUE["word_frequencies"].plan(DUCKDB).replace("SELECT lang, word, freq FROM corpus", "SELECT word, sum(freq)::BIGINT AS freq FROM corpus GROUP BY word"))
def json_frequencies(spark, sf_dir: str) -> DataFrame:
    """The words' counts as a JSON object, read again."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    path = f"{place(spark, 'json')}/f"
    files.save_frequencies(spark.sql(word_frequencies(SPARK)).groupBy("word").agg(F.sum("freq").alias("freq")), path)
    return files.frequencies(spark, path)


@built("S33 S34 S35 S36 S37", "SELECT DISTINCT p_brand AS kind, p_type AS morpheme FROM part")
def json_morphemes(spark, sf_dir: str) -> DataFrame:
    """Lists by kind as a JSON object, read again, saved and read once more."""
    path = place(spark, "json")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("morpheme"))
    files.save_morphemes(rows, f"{path}/a")
    files.save_morphemes(files.morphemes(spark, f"{path}/a"), f"{path}/b")
    return files.morphemes(spark, f"{path}/b")


@built("S38", "WITH x AS (SELECT c_mktsegment AS root, count(*) AS freq, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS share FROM customer GROUP BY 1) SELECT root, freq::VARCHAR AS freq, printf('%.1f%%', share * 100) AS share FROM x WHERE share >= 0.19")
def exported_csv(spark, sf_dir: str) -> DataFrame:
    """Shares over a bound as CSV with percentages, read again."""
    path = f"{place(spark, 'csv')}/c"
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = rows.count()
    files.export_csv(rows.groupBy(F.col("c_mktsegment").alias("root")).agg(F.count("*").alias("freq")).withColumn("share", F.col("freq") / n), path, "share", 0.19)
    return spark.read.option("header", True).csv(path)


@built("S46 S47 S48 S49", f"SELECT skill_id, name, task_class, languages, confidence, CASE WHEN skill_id = 's1' THEN 'brief,sum,tldr' WHEN skill_id = 's2' THEN 'label' ELSE '' END AS keywords FROM {registry.skills(DUCKDB)} s")
def skill_files(spark, sf_dir: str) -> DataFrame:
    """Skills saved in a file by class and loaded again, with their keywords from a table that is merged twice."""
    path = place(spark, "skills")
    given = spark.sql(f"SELECT skill_id, name, task_class, split(languages, ',') AS languages, CAST(confidence AS DOUBLE) AS confidence FROM {registry.skills(SPARK)} s")
    files.save_skills(given, f"{path}/s")
    shape = "skill string, keywords array<string>"
    words = tables.Store(spark, path).collection("keywords", shape)
    for rows in ([("s1", ["sum", "tldr"]), ("s2", ["label"])], [("s1", ["brief", "sum"])]):
        words.write(tables.merged_arrays(words.read(), spark.createDataFrame(rows, shape), "skill", "keywords"))
    loaded = files.skills(spark, f"{path}/s").join(words.read().withColumnRenamed("skill", "skill_id"), "skill_id", "left")
    return loaded.select("skill_id", "name", "task_class", F.array_join("languages", ",").alias("languages"), "confidence", F.coalesce(F.array_join("keywords", ","), F.lit("")).alias("keywords"))


@built("S51 S52", CATALOGUE["word_roles"].plan(DUCKDB))
def cached_profiles(spark, sf_dir: str) -> DataFrame:
    """The words' roles, written as a cache and read from it."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    path = place(spark, "profiles")
    files.build_if_missing(spark, f"{path}/p", lambda: spark.sql(roots.word_roles(SPARK)))
    return files.build_if_missing(spark, f"{path}/p", lambda: 1 / 0)


@built("S55", r"SELECT lower(regexp_extract(url, '//([^/:?#]*)', 1)) AS host, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def indexed_pages(spark, sf_dir: str) -> DataFrame:
    """Pages by host in folders, sorted by id within files: a filter on the host reads its folder only, one on the id few row groups."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", F.lower(F.regexp_extract("url", r"//([^/:?#]*)", 1)))
    path = f"{place(spark, 'index')}/p"
    pages.repartition("host").sortWithinPartitions("host", "page_id").write.partitionBy("host").parquet(path)
    return spark.read.schema("page_id long, host string").parquet(path).groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@built("S39 T07 T08 T09 T10", CATALOGUE["routed_events"].plan(DUCKDB))
def streamed_routes(spark, sf_dir: str) -> DataFrame:
    """The events as a stream, routed by the first condition that they meet and written batch by batch to each route's table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = place(spark, "routes")
    stream = spark.readStream.schema(events).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events*.parquet")
    routes = {"large": "value > 100", "p": "event_type LIKE 'p%'", "even": "user_id % 2 = 0"}
    state.write_to(state.routed(stream, routes), f"{path}/check", lambda batch: batch.write.mode("append").partitionBy("route").parquet(f"{path}/out")).awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
