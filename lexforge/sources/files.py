"""Readers and writers of files: Parquet parts, tab-separated, JSON and XML, each with a declared schema."""

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet_parts(spark: SparkSession, prefix: str) -> DataFrame | None:
    """All files prefix_part*.parquet, or None where there is none."""
    try:
        return spark.read.parquet(f"{prefix}_part*.parquet")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def save_parts(df: DataFrame, path: str, megabytes: int = 1024, row_bytes: int = 1024) -> None:
    """Files of about megabytes each, by an estimate of a row; nested arrays are flattened."""
    nested = [c for c, t in df.dtypes if t.startswith("array<array")]
    df = df.withColumns({c: F.flatten(c) for c in nested})
    df.write.option("maxRecordsPerFile", max(1, megabytes * 2**20 // row_bytes)).option("compression", "snappy").mode("overwrite").parquet(path)


def build_if_missing(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; build() makes it where it is missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def tab_separated(spark: SparkSession, path: str, header: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Lines of as many fields as header has; blank lines, others, and the header's own line are left out; no quoting."""
    fields = F.split(F.trim("value"), "\t", -1)
    rows = spark.read.text(path).where(F.trim("value") != "").select(fields.alias("f")).where(F.size("f") == len(header))
    rows = rows.where(F.array_join("f", "\t") != "\t".join(header))
    return rows.select(*(F.col("f")[i].alias((rename or {}).get(name, name)) for i, name in enumerate(header)))


def json_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON document of a declared schema; no rows where the file is missing or broken."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) from a JSON object of counts."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "freq"))


def save_frequencies(df: DataFrame, path: str) -> None:
    """One JSON object of counts: for dictionaries, which fit a row."""
    whole = df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "freq")))).alias("m"))
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def morphemes(spark: SparkSession, path: str) -> DataFrame:
    """(kind, morpheme) from a JSON object of lists."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("kind", "list")).select("kind", F.explode("list").alias("morpheme"))


def save_morphemes(df: DataFrame, path: str) -> None:
    kinds = df.groupBy("kind").agg(F.array_sort(F.collect_set("morpheme")).alias("list"))
    kinds.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "list")))).alias("m")).select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def xml_pages(spark: SparkSession, path: str, language: str = r"^==([^=]+)==$") -> DataFrame:
    """(title, comment, lines, languages) of the page elements of an XML dump, compressed or not."""
    shape = "title string, revision struct<comment: string, text: string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(shape).load(path)
    lines = F.split(F.coalesce("revision.text", F.lit("")), "\n")
    heads = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, language, 1)), lambda x: x != "")
    return pages.select("title", F.col("revision.comment").alias("comment"), lines.alias("lines"), heads.alias("languages"))


#: Headings of languages and sections, language codes in templates, definitions and rows of translations, sizes of files.
LANGUAGE = r"^[^=]*==([\p{L}\p{M}\p{N}\s\p{P}&&[^=]]*)==[^=]*$"
SECTION = r"===+([^=]+)===+"
CODE = r"\{\{(?:syn|lb|l|lang=|head|hyph(?:enation)?|alter|audio|IPA)\|([a-z]{2,3})\|"
MEANING = r"\{\{trans-top\|([^}]+)\}\}"
TRANSLATION = r"\*:? ([^:{]+):.*?\{\{t\+?\|([a-z]{2,3})\|([^|}]+)"
FILE_SIZE = r"(?i)\b\d+(?:\.\d+)?(?:MB|GB|KB|TB)\b"
#: Lines within which a page must name a language's code.
CODE_LINES = 100


def sections(pages: DataFrame) -> DataFrame:
    """(title, language, code, grp, section, meaning, item) of wikitext pages: the list items and translations under each language,
    etymology group and section heading; sections of pronunciation are left out, and so are pages that name no code early on."""
    rows = pages.select("title", F.posexplode("lines").alias("place", "line"))
    before = Window.partitionBy("title").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda p: F.nullif(F.trim(F.regexp_extract("line", p, 1)), F.lit(""))
    last = lambda c: F.last(c, True).over(before)
    part = first(SECTION)
    rows = rows.withColumn("head", F.when(part.isNull(), first(LANGUAGE))).withColumn("part", part)
    rows = rows.withColumn("language", last(F.col("head"))).withColumn("code", last(F.when(F.col("head").isNotNull(), F.lit("")).otherwise(first(CODE))))
    rows = rows.withColumn("grp", last(F.when(F.col("head").isNotNull(), F.lit("Etymology")).when(F.col("part").contains("Etymology"), F.col("part"))))
    rows = rows.withColumn("section", last(F.when(F.col("head").isNotNull(), F.lit("")).when(~F.col("part").contains("Etymology"), F.lower("part"))))
    rows = rows.withColumn("meaning", last(F.when(F.col("head").isNotNull() | F.col("part").isNotNull(), F.lit("")).otherwise(first(MEANING))))
    early = F.max(F.when((F.col("place") < CODE_LINES) & (F.col("code") != ""), F.lit(True))).over(Window.partitionBy("title"))
    long = F.max("place").over(Window.partitionBy("title")) >= CODE_LINES
    found = rows.withColumn("kept", F.coalesce(early, F.lit(False)) | ~long)
    translated = F.when(F.regexp_extract("line", TRANSLATION, 2) != "", F.concat(F.trim(F.regexp_extract("line", TRANSLATION, 1)), F.lit(" ("), F.regexp_extract("line", TRANSLATION, 2), F.lit("): "), F.trim(F.regexp_extract("line", TRANSLATION, 3))))
    item = F.when(F.col("section") == "translations", translated).otherwise(F.nullif(F.regexp_extract("line", r"^[*#:]+\s*(.+)$", 1), F.lit("")))
    kept = found.where("kept and language is not null and section <> 'pronunciation' and head is null and part is null").select("title", "language", "code", "grp", "section", "meaning", item.alias("item"))
    return kept.where("item is not null")


def export_csv(df: DataFrame, path: str, share: str, least: float = 0.0, by: str = "freq") -> None:
    """Rows whose share reaches least, the largest first, the share as a percentage."""
    out = df.where(F.col(share) >= least).orderBy(F.desc(by), *[c for c in df.columns if c != by])
    out.withColumn(share, F.format_string("%.1f%%", F.col(share) * 100)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def lines_of(column: str | Column) -> Column:
    return F.split(column, "\n")


def part_name(prefix: str, number: int) -> str:
    """The name of a part that parquet_parts() finds."""
    return f"{prefix}_part{number}.parquet"


def save_skills(df: DataFrame, path: str) -> None:
    """(task_class, skill_id, name, languages, confidence) as JSON objects, a line for each class, skills by id."""
    one = F.struct("name", "languages", "confidence")
    by_class = df.groupBy("task_class").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("skill_id", one)))).alias("skills"))
    by_class.select(F.to_json(F.create_map("task_class", "skills")).alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def skills(spark: SparkSession, path: str) -> DataFrame:
    """What save_skills() wrote; a skill of no languages serves all."""
    shape = "map<string,map<string,struct<name:string,languages:array<string>,confidence:double>>>"
    nested = spark.read.text(path).select(F.explode(F.from_json("value", shape)).alias("task_class", "skills"))
    return nested.select("task_class", F.explode("skills").alias("skill_id", "s")).select("skill_id", "s.name", "task_class", "s.languages", "s.confidence")


def save_dump(pages: DataFrame, path: str) -> None:
    """(title, comment, text) as a bzip2-compressed XML dump of page elements."""
    safe = lambda c: F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<page><title>"), safe(F.col("title")), F.lit("</title><revision><comment>"), safe(F.col("comment")), F.lit("</comment><text>"), safe(F.col("text")), F.lit("</text></revision></page>"))

    def rooted(batches):
        """One root element for each file."""
        yield pd.DataFrame({"value": ["<pages>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</pages>"]})

    pages.select(page.alias("value")).mapInPandas(rooted, "value string").write.option("compression", "bzip2").text(path)
