"""Mixing sources to target weights over a time-varying curriculum, with DataFrame functions only.

A source's weight runs linearly over training from its schedule's first to its second value; the integral is its weight
in the mix. Targets share the words of all documents by these weights, none above cap times its source's words (the rest
is shared again by weight: a water level, found in one pass over the sources sorted by where they fill up). A source's
documents stand in the order of a keyed hash and are taken in passes until its target is met; the last document taken
may be cut at a word. The share of its source's demand that lies before a copy, put through the inverse of the
schedule's integral, is the copy's training position in 0..1, and documents are range-sorted by it.

No source is gathered in one task: running totals go by source and one of 4096 hash buckets, then over the buckets. The hash
is of doc_id and text, so rows share a bucket by chance or because they are equal in both. Texts are read once where the
caller's columns are few enough to be written with the sizes (keep).

Defined results: null or wordless texts have size 0 and are never taken; the null source is a source, the last; rows that
repeat are placed one by one; null doc_ids are kept; the caller's further columns stay apart from those computed here; an empty
table has no rows; a text of any length is one document.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.scratch import saved

#: Weight at the start and at the end of training, repeating over the sources; the means are 5, 2 and 1.
SCHEDULE = ((6.0, 4.0), (1.5, 2.5), (0.5, 1.5))
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that orders a source's documents, and of those that name a bucket.
ORDER_BITS, BUCKET_BITS = 60, 12


def position(share: Column, first: Column, last: Column) -> Column:
    """The time by which a linear schedule has spent a share of its integral."""
    return F.when(first == last, share).otherwise(F.try_divide(F.sqrt(first * first + (last * last - first * first) * share) - first, last - first))


def order(seed: int) -> Column:
    """A number of ORDER_BITS from doc_id and text, by a hash that SQL engines share."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    return F.conv(F.substring(digest, 1, ORDER_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, schedule: tuple, cap: float) -> DataFrame:
    """sources(key, source, source_size), a row for each source, with its schedule (first, last) and target."""
    by_name, everything = Window.orderBy(F.col("source").isNull(), "source"), Window.partitionBy(F.lit(1))
    turn = (F.row_number().over(by_name) - 1) % len(schedule)
    firsts, lasts = (F.array(*(F.lit(float(s[i])) for s in schedule)) for i in (0, 1))
    with_weight = sources.withColumn("turn", turn).withColumn("first", F.element_at(firsts, F.col("turn") + 1)).withColumn("last", F.element_at(lasts, F.col("turn") + 1)).withColumn("weight", (F.col("first") + F.col("last")) / 2)
    fill = F.col("source_size") * F.lit(float(cap)) / F.col("weight")
    filling = Window.orderBy("fill", "key")
    before = F.coalesce(F.sum(F.col("source_size") * F.lit(float(cap))).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = with_weight.withColumn("fill", fill).withColumn("level", (F.sum("source_size").over(everything) - before) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    reached = level.withColumn("level", F.when(F.col("level") <= F.col("fill"), F.col("level"))).withColumn("fill_if", F.when(F.col("level").isNotNull(), F.col("fill")))
    found = F.coalesce(F.min_by("level", "fill_if").over(everything), F.max("fill").over(everything))
    return reached.withColumn("found", found).select("key", "source_size", "first", "last", F.least(F.col("source_size") * F.lit(float(cap)), F.col("found") * F.col("weight")).alias("target"))


def allocate(docs: DataFrame, schedule: tuple = SCHEDULE, cap: float = CAP, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """row (the caller's columns, or those of keep), size, source_size, target, taken, copies (pass, taken, position)."""
    key = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), size.alias("size"), key.alias("key"), F.col("source").alias("source"), order(seed).alias("h")).withColumn("bucket", F.shiftright("h", ORDER_BITS - BUCKET_BITS))
    if keep:
        rows = saved(rows, "sizes")
    parts = rows.groupBy("key", "bucket").agg(F.sum("size").alias("part"), F.first("source").alias("source"))
    sources = targets(parts.groupBy("key").agg(F.first("source").alias("source"), F.sum("part").alias("source_size")), schedule, cap)
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "bucket", F.coalesce(F.sum("part").over(ahead), F.lit(0)).alias("ahead")).join(sources, "key")
    within = Window.partitionBy("key", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(parts, ["key", "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("target"), F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))).cast("long")

    def copy(n: Column) -> Column:
        taken = F.when(n < F.col("passes"), F.col("size")).otherwise(last)
        middle = n * F.col("source_size") + F.col("start") + taken / 2
        return F.struct(n.alias("pass"), taken.alias("taken"), position(F.least(F.lit(1.0), F.try_divide(middle, F.col("target"))), F.col("first"), F.col("last")).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), copy), lambda c: c["taken"] > 0)
    return placed.select("row", "size", "source_size", "target", (F.col("passes") * F.col("size") + last).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, schedule: tuple = SCHEDULE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """The documents in training order: a row for each copy taken, with repeat (long), taken (long) and position (double)
    beside the columns of docs of other names."""
    placed = allocate(docs, schedule, cap, seed).select("row", F.explode("copies").alias("copy"))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("repeat", "taken", "position")]
    return placed.select(*own, F.col("copy.pass").alias("repeat"), F.col("copy.taken").alias("taken"), F.col("copy.position").alias("position")).sort("position", "doc_id", "repeat")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    first = F.try_element_at(F.col("copies.position"), F.lit(1))
    placed = allocate(docs, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", first.alias("position"))
    return placed.sort(F.col("position").asc_nulls_last(), "doc_id")


def oracle() -> str:
    """The same result in DuckDB's SQL, plainly: windows over whole sources."""
    firsts, lasts = (", ".join(str(float(x[i])) for x in SCHEDULE) for i in (0, 1))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key,
  ('0x' || substr(md5(concat_ws('|', '7', doc_id::VARCHAR, text)), 1, {ORDER_BITS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
t AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(SCHEDULE)} AS turn FROM s),
w AS (SELECT *, ([{firsts}]::DOUBLE[])[turn + 1] AS first, ([{lasts}]::DOUBLE[])[turn + 1] AS last FROM t),
f AS (SELECT *, (first + last) / 2 AS weight, source_size * {float(CAP)}::DOUBLE / ((first + last) / 2) AS fill FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size * {float(CAP)}::DOUBLE) OVER (ORDER BY fill, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fill, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT coalesce(arg_min(level, fill) FILTER (level <= fill), max(fill)) AS found FROM l),
m AS (SELECT key, source_size, first, last, least(source_size * {float(CAP)}::DOUBLE, found * weight) AS target FROM l, g),
p AS (SELECT doc_id, size, source_size, target, first, last, coalesce(sum(size) OVER (PARTITION BY key ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM d JOIN m USING (key)),
q AS (SELECT *, greatest(0, least(size, round(target - passes * source_size)::BIGINT - start)) AS rest FROM p),
r AS (SELECT *, passes * size + rest AS taken, least(1.0::DOUBLE, (start + CASE WHEN passes > 0 THEN size ELSE rest END / 2.0::DOUBLE) / target) AS share FROM q)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN CASE WHEN first = last THEN share ELSE (sqrt(first * first + (last * last - first * first) * share) - first) / (last - first) END END AS position FROM r"""
