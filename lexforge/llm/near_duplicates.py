"""Near duplicates: HyperMinHash registers, banded, compared with collision correction, then verified on full sets.

A document's set holds its distinct shingles. Identical sets are one class, met by fingerprint, so copies cost one row
each. Each class has 128 registers: a shingle's hash picks the register, and the register keeps, of its smallest value,
the count of leading zeros and nine bits of mantissa. Registers that no shingle hit are filled by further rounds
of hashing, so short texts are compared as well as long ones. 25 bands of five registers name the candidates: a pair at
the threshold of 0.85 is missed once in two million. Every class of a bucket meets the bucket's smallest one; where that
leaves a bucket with several components, the classes outside its largest component meet all others of another component.
Pairs whose corrected estimate is above the threshold less 4.5 standard errors are verified on full sets.

Defined results: null or wordless texts have empty sets and link with nothing; null doc_ids link with nothing and keep a
null component; rows that share a doc_id are one node, linked with whatever one of them is near to, and have a set size each;
further columns are ignored. At the pipeline's 0.8 the bands miss a link five times in 100,000.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import kernels as K
from lexforge.llm.scratch import drop, release, saved

REGISTERS, BAND, BANDS, MANTISSA = 128, 5, 25, 9
SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, registers binary"
#: Rows of a block in which registers are compared pair by pair, and of the largest bucket that is one block.
BLOCK, SMALL = 512, 32


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, a row of REGISTERS 16-bit codes for each set; at: where each set begins."""
    rows = len(at) - 1
    none = np.uint64(1 << 63)
    least = np.full(rows * REGISTERS, none)
    row = np.repeat(np.arange(rows), np.diff(at))
    np.minimum.at(least, row * REGISTERS + (hashes & np.uint64(REGISTERS - 1)).astype(np.int64), hashes >> np.uint64(7))
    out = np.zeros(rows * REGISTERS, np.uint16)
    filled = least != none
    value = least[filled]
    bits = 57 - np.minimum(np.frexp(value.astype(np.float64))[1], 57)
    mantissa = np.where(value > 0, (value << (bits + 8).astype(np.uint64)) >> np.uint64(64 - MANTISSA), 0)
    out[filled] = (bits.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    open_rows = np.flatnonzero(~filled.reshape(rows, REGISTERS).all(1) & (np.diff(at) > 0))
    turn = 0
    while len(open_rows):
        turn += 1
        sizes = np.diff(at)[open_rows]
        own = np.repeat(np.arange(len(open_rows)), sizes)
        take = np.repeat(at[open_rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        h = K.mix(hashes[take] + np.uint64(turn * int(K.BASE) & (1 << 64) - 1))
        slot = (h & np.uint64(REGISTERS - 1)).astype(np.int64) if turn < REGISTERS else np.full(len(h), turn - REGISTERS)
        best = np.full(len(open_rows) * REGISTERS, none)
        np.minimum.at(best, own * REGISTERS + slot, h >> np.uint64(7))
        where = (open_rows[:, None] * REGISTERS + np.arange(REGISTERS)).ravel()
        fill = (best != none) & ~filled[where]
        out[where[fill]] = np.uint16(0x8000) | np.uint16((turn & 0xFF) << 7) | (best[fill] >> np.uint64(50)).astype(np.uint16)
        filled[where[fill]] = True
        open_rows = open_rows[~filled.reshape(rows, REGISTERS)[open_rows].all(1)]
    return out.reshape(rows, REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, less those expected to be equal by chance."""
    chance = 4 * na * nb / (na + nb) ** 2 / 3 * 2.0**-MANTISSA
    return ((a == b).mean(-1) - chance) / (1 - chance)


def sets_of(column: pa.Array, width: int, pw: K.Powers, values: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.utf8(column)
    for lo, hi in K.slices(offsets):
        part = offsets[lo : hi + 1]
        words, first = K.word_hashes(data[part[0] : part[-1]], part - part[0], K.SPACED, values, pw)
        yield lo, hi, *K.shingle_sets(words, first, width)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw, values = K.Powers(), K.byte_values(True)
        for batch in batches:
            for lo, hi, hashes, at in sets_of(batch.column(1), width, pw, values):
                sizes = np.diff(at)
                sums = K.running(K.mix(hashes ^ K.BASE))
                more = K.running(K.mix(hashes + K.BASE) ** np.uint64(3))
                rows = registers(hashes, at)
                regs = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)), pa.array((more[at[1:]] - more[at[:-1]]).view(np.int64)), regs], names=["doc_id", "n_shingles", "fp1", "fp2", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def close(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Of pairs (a, b), those whose estimate reaches floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                na, nb = (batch.column(i).to_numpy() for i in (4, 5))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(estimate(ra, rb, na, nb) >= floor))

    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw, values = K.Powers(), K.byte_values(True)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # few texts at once
                batch = whole.slice(at, 256)
                sets: list[list[np.ndarray]] = [[], []]
                for side in (0, 1):
                    for _, _, hashes, first in sets_of(batch.column(2 + side), width, pw, values):
                        sets[side] += [hashes[first[i] : first[i + 1]] for i in range(len(first) - 1)]
                keep = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(*sets, strict=True)):
                    both = np.concatenate((x, y))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep[i] = shared > 0 and 1000 * shared >= round(1000 * threshold) * (len(x) + len(y) - shared)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): each round sends every node to its smallest neighbour and
    contracts, until no link is left; the smallest node of a component is never sent elsewhere."""
    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        step = saved(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("to")), "step")
        before, old = labels, links
        labels = step.withColumnRenamed("to", "component") if labels is None else labels.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = saved(labels, "labels")
        sent = lambda x, step=step: step.select(F.col("node").alias(x), F.col("to").alias(f"{x}2"))
        links = saved(links.join(sent("a"), "a").join(sent("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "links")
        drop(step, old, *([before] if before is not None else []))
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def close_pairs(table: pa.Table, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows marked out, each with the other rows of another component whose estimate reaches floor."""
    parts, n = (table.column(c).to_numpy() for c in ("component", "n_shingles"))
    regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    out = table.column("out").to_numpy().astype(bool)
    others = np.flatnonzero(~out)
    for x in np.flatnonzero(out):
        near = others[parts[others] != parts[x]]
        yield x, near[estimate(regs[near], regs[x], n[near], n[x]) >= floor]


def leftovers(buckets: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, width: int, threshold: float, floor: float) -> DataFrame:
    """Links between different components within buckets that hold several. A small bucket's close pairs are verified
    one by one. Large buckets of one largest component are joined; those outside it meet every other member, block by
    block, on full sets where registers are close, and a block returns no more links than it has rows."""
    held = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    by_key = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.component").alias("main"), "total")
    rows = saved(held.join(by_key, "key").select("key", "doc_id", "component", "main", "total"), "leftovers")
    known = classes.select("doc_id", "registers", "n_shingles")
    small = rows.where(F.col("total") <= SMALL).join(known, "doc_id")
    small = small.withColumn("out", F.explode(F.when(F.col("component") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))

    def pairs(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        found = [np.stack((np.minimum(ids[x], ids[near]), np.maximum(ids[x], ids[near]))) for x, near in close_pairs(table, floor)]
        both = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    some = small.groupBy("key").applyInArrow(pairs, "a long, b long").distinct()
    linked = verified(some, texts, width, threshold)

    large = rows.where(F.col("total") > SMALL).select("main", "doc_id", "component").distinct()
    sizes = large.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("component") != F.col("main")) / BLOCK).cast("int").alias("outer"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw, values = K.Powers(), K.byte_values(True)
        for batch in batches:
            for lo, hi, hashes, at in sets_of(batch.column(1), width, pw, values):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], names=["doc_id", "hashes"])

    sets = texts.join(large.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(packed, "doc_id long, hashes binary")
    large = large.join(sizes, "main").join(known, "doc_id").join(sets, "doc_id")
    spread = F.abs(F.xxhash64("doc_id"))
    fields = ["main", "doc_id", "component", "registers", "n_shingles", "hashes"]
    left = large.where("component <> main").select(*fields, (spread % F.col("outer")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("out"))
    right = large.select(*fields, F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), (spread % F.col("blocks")).cast("int").alias("j"), F.lit(False).alias("out"))

    def links(table: pa.Table) -> pa.Table:
        ids, parts = (table.column(c).to_numpy() for c in ("doc_id", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        parent = {int(p): int(p) for p in parts}

        def root(p: int) -> int:
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            return p

        found = []
        for x, near in close_pairs(table, floor):
            own = sets[x]
            sizes = np.array([len(sets[y]) for y in near], np.int64)
            every = np.concatenate([sets[y] for y in near]) if len(near) else own[:0]
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes) if len(near) else sizes
            for y in near[1000 * shared >= round(1000 * threshold) * (len(own) + sizes - shared)]:
                p, q = root(int(parts[x])), root(int(parts[y]))
                if p != q:
                    parent[p] = q
                    found.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    more = left.unionByName(right).groupBy("main", "i", "j").applyInArrow(links, "a long, b long")
    return linked.unionByName(more)


def near_duplicates(docs: DataFrame, threshold: float = 0.85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least threshold), kept."""
    floor = threshold - 4.5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    signed = saved(signatures(docs, width), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    same = saved(full.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")
    classes = full.join(same.select(F.col("rep").alias("doc_id"), "n_shingles", "fp1", "fp2"), ["doc_id", "n_shingles", "fp1", "fp2"], "left_semi").dropDuplicates(["doc_id", "fp1", "fp2"])
    bands = classes.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * (2 * BAND) + 1, F.lit(2 * BAND))))).alias("key"))
    firsts = bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("key", "a")
    buckets = saved(bands.join(firsts, "key"), "buckets")
    held = saved(classes.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"), "held")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = saved(texts.join(held.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    release(docs.sparkSession)
    stars = buckets.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    links = saved(verified(close(stars, held, floor), texts, width, threshold), "links")
    labels = components(links)
    more = saved(leftovers(buckets.select("key", "doc_id"), labels, held, texts, width, threshold, floor), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    drop(buckets, held, texts)
    release(docs.sparkSession)
    named = same.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "fp1", "fp2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(named, ["n_shingles", "fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
