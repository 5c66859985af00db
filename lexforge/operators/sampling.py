"""Seeded rearrangements of token rows: the same seed gives the same rows, whatever the partitions."""

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.plans.dialect import SPARK, built

PRE, SUF, MID, RATE = 4, 5, 6, 0.5


def fill_in_middle(ids: list[int], rng: random.Random, rate: float = RATE) -> tuple[list[int], list[int]]:
    """(row, labels): prefix, suffix and middle behind their marks, labels only on the middle; or the row as it was."""
    if len(ids) < 3 or rng.random() >= rate:
        return list(ids), [*ids[1:], -100] if ids else []
    a, b = sorted(rng.sample(range(1, len(ids) + 1), 2))
    row = [PRE, *ids[:a], SUF, *ids[b:], MID, *ids[a:b]]
    return row, [-100] * (len(row) - (b - a)) + ids[a:b]


@built("C04 C05 C07")
def fill_in_middle_rows(spark, sf_dir: str) -> DataFrame:
    """Turns as word counts by place, rearranged; each turn's seed is its own key."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select("conv_id", "turn", F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(50_000)) + 10).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [fill_in_middle([int(x) for x in ids], random.Random(f"{c}/{t}")) for c, t, ids in zip(pdf.conv_id, pdf.turn, pdf.ids, strict=True)]
            yield pd.DataFrame({"conv_id": pdf.conv_id, "turn": pdf.turn, "row": [r for r, _ in made], "labels": [x for _, x in made]})

    return rows.mapInPandas(run, "conv_id long, turn long, row array<int>, labels array<int>")


@built("")
def sampled_candidates(spark, sf_dir: str) -> DataFrame:
    """Of the most frequent followers of a word the first, second or third, with 85, 10 and 5 %, by a hash of the word."""
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    pairs = spark.sql(f"SELECT conv_id, turn, place, token FROM conversations {SPARK.each_at(SPARK.found('lower(text)', r'\p{L}+'), 'place', 'token')}")
    by_turn = Window.partitionBy("conv_id", "turn").orderBy("place")
    counts = pairs.withColumn("next", F.lead("token").over(by_turn)).where("next is not null").groupBy("token", "next").count()
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("count"), "next"))).where("rank <= 3")
    draw = F.pmod(F.xxhash64("token", F.lit("slot")), F.lit(100))
    slot = F.when(draw < 85, 1).when(draw < 95, 2).otherwise(3)
    return ranked.withColumn("slot", F.least(slot, F.max("rank").over(Window.partitionBy("token")))).where("rank = slot").select("token", "next", "count", "rank")
