"""Benchmark decontamination with an FM-index for each shard of the training texts.

Words outside the benchmark's vocabulary end every match, so a shard (an Arrow batch of documents) is indexed as the runs
of in-vocabulary words that are long enough to hold a test phrase, with separators between. Its Burrows-Wheeler transform
stands in a wavelet matrix; test phrases are searched backward through its ranks, all at once; occurrences are located by
walking to the nearest sampled suffix position; their word spans are merged.

Test phrases are an item's windows of 13 words, or all its words where it has fewer. The benchmark is a query set: it is
read in blocks of at most BLOCK_BYTES of text (or one longer item), of which each is a broadcast and a pass over the documents.
A block's phrases are held as arrays; on 2.2 MB of random words they took 54 times the text while they were made, 24 times once made
(190 MB for a whole block) and 11 times when sent.

Defined results: a null text has no words; items without words, or of a null id or text, have no phrases; items that
repeat an id count once; documents are judged row by row, whatever their ids; an empty table has no rows, and against an empty
benchmark nothing is hit; texts of any length are read whole; further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import kernels as K

WINDOW = 13
BLOCK_BYTES = 8 << 20
SAMPLE = 16
FOUND = "doc_id long, text_hash long, n_words long, spans array<struct<start:long,end:long,first:long,last:long>>, items array<string>"


class WaveletMatrix:
    """Ranks of symbols below 2 ** bits in a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.n, self.bits, self.ones, self.zeros = len(symbols), bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for i in range(self.bits):
            one = ((symbols >> (self.bits - 1 - i)) & 1).astype(bool)
            ones_lo, ones_hi = self.ones[i][lo], self.ones[i][hi]
            lo, hi = np.where(one, self.zeros[i] + ones_lo, lo - ones_lo), np.where(one, self.zeros[i] + ones_hi, hi - ones_hi)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Of a sequence of symbols from 1; 0 ends it."""

    def __init__(self, text: np.ndarray) -> None:
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.ranks = WaveletMatrix(self.bwt, max(1, int(text.max()).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.before = np.concatenate(([0], np.cumsum(self.sampled)))
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases of one length, the ranges of suffixes that they begin."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k].astype(np.int64)
            known = symbol < len(self.below) - 1
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], symbol[known]
            lo[live], hi[live] = self.below[symbol] + self.ranks.rank(symbol, lo[live]), self.below[symbol] + self.ranks.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Where suffixes begin: steps back to a sampled one, counted."""
        at, out = suffixes.copy(), np.zeros(len(suffixes), np.int64)
        left = np.arange(len(suffixes))
        steps = 0
        while len(left):
            hit = self.sampled[at[left]]
            out[left[hit]] = self.positions[self.before[at[left[hit]]]] + steps
            left = left[~hit]
            symbol = self.bwt[at[left]]
            at[left] = self.below[symbol] + self.ranks.rank(symbol, at[left])
            steps += 1
        return out


class Phrases:
    """Test phrases of a block of benchmark items, by length, as numbers of vocabulary words."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        data, offsets = K.utf8(pa.array([t for _, t in items], pa.string()))
        hashes, first = K.word_hashes(data, offsets, K.ALNUM, K.byte_values(True), K.Powers())
        self.vocabulary = np.unique(hashes)
        numbers = (np.searchsorted(self.vocabulary, hashes) + 2).astype(np.int32)  # 1 separates
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.vocabulary >> np.uint64(42)).astype(np.int64)] = True
        self.names = [name for name, _ in items]
        size = np.diff(first)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        holders, known = [], 0
        for length in sorted(set(np.minimum(size, window).tolist()) - {0}):
            of = np.flatnonzero(np.minimum(size, window) == length)
            count = size[of] - length + 1
            item = np.repeat(of, count).astype(np.int32)
            start = np.repeat(first[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            table = np.lib.stride_tricks.sliding_window_view(numbers, length)[start]
            table, which = np.unique(table, axis=0, return_inverse=True)
            self.by_length[length] = np.arange(known, known + len(table)), table
            holders.append(np.unique(np.stack((which.reshape(-1) + known, item)), axis=1))
            known += len(table)
        phrase, self.holder = np.concatenate(holders, 1) if holders else np.zeros((2, 0), np.int64)
        self.held = np.searchsorted(phrase, np.arange(known + 1))
        #: For each phrase length, whether a vocabulary number occurs in a phrase of it: a run must be that long.
        self.members = {}
        for length, (_, table) in self.by_length.items():
            self.members[length] = np.zeros(len(self.vocabulary) + 2, bool)
            self.members[length][table.ravel()] = True

    def items(self, phrase: int) -> list[str]:
        """Ids of the items that have a phrase."""
        return [self.names[i] for i in self.holder[self.held[phrase] : self.held[phrase + 1]]]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, 0 for others."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.sieve[(hashes >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 2, 0)
        return out

    def wanted(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which words stand in a run, within its document, that may hold a phrase."""
        keep = np.zeros(len(numbers), bool)
        for length, member in self.members.items():
            inside = np.zeros(len(numbers) + 2, bool)
            inside[1:-1] = member[numbers]
            edge = np.zeros(len(numbers) + 1, bool)
            edge[first] = True
            starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
            ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
            for lo, hi in zip(starts[ends - starts >= length], ends[ends - starts >= length], strict=True):
                keep[lo:hi] = True
        return keep


def shard(batch: pa.RecordBatch, phrases: Phrases, pw: K.Powers, values: np.ndarray) -> pa.RecordBatch:
    data, offsets = K.utf8(batch.column(1))
    n = batch.num_rows
    n_words, kept, starts, ends = np.zeros(n, np.int64), [], [], []
    owner, index, fresh = [], [], []
    for lo, hi in K.slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        own = offsets[lo : hi + 1] - offsets[lo]
        s, e, first = K.word_bounds(part, own, K.ALNUM)
        n_words[lo:hi] = np.diff(first)
        numbers = phrases.numbers(K.mix(K.span_hashes(K.prefix_hashes(part, values, pw), s, e, pw)))
        keep = np.flatnonzero(phrases.wanted(numbers, first))
        row = np.searchsorted(first, keep, "right") - 1
        kept.append(numbers[keep])
        starts.append(s[keep] - own[row])
        ends.append(e[keep] - own[row])
        owner.append(row + lo)
        index.append(keep - first[row])
        if len(keep):
            fresh.append(np.concatenate(([True], (np.diff(keep) > 1) | (np.diff(row) > 0))))
    number, start, end, row, nth = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept, starts, ends, owner, index))
    spans: list[list] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    if len(number):
        breaks = np.concatenate(fresh)
        at = np.arange(len(number)) + np.cumsum(breaks)  # a separator before each run
        text = np.ones(len(number) + int(breaks.sum()) + 1, np.int64)
        text[at] = number
        back = np.zeros(len(text), np.int64)
        back[at] = np.arange(len(number))
        fm = FMIndex(text)
        which, where, long = [], [], []
        for length, (names, table) in phrases.by_length.items():
            lo, hi = fm.search(table)
            size = hi - lo
            suffixes = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            which.append(np.repeat(names, size))
            where.append(back[fm.locate(suffixes)])
            long.append(np.full(len(suffixes), length))
        which, where, long = (np.concatenate(x) for x in (which, where, long))
        for r, p in np.unique(np.stack((row[where], which)), axis=1).T.tolist() if len(where) else ():
            items[r] += phrases.items(p)
        order = np.argsort(where, kind="stable")
        if len(order):
            left, right = where[order], np.maximum.accumulate((where + long)[order])
            fits = (left[1:] < right[:-1]) | ((left[1:] == right[:-1]) & ~breaks[left[1:]])  # spans of two runs stay apart
            cut = np.flatnonzero(np.concatenate(([True], ~fits)))
            for a, b in zip(left[cut].tolist(), right[np.concatenate((cut[1:], [len(left)])) - 1].tolist(), strict=True):
                spans[row[a]].append({"start": int(start[a]), "end": int(end[b - 1]), "first": int(nth[a]), "last": int(nth[b - 1]) + 1})
    sets = [sorted(set(x)) for x in items]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words), pa.array(spans, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "first", "last")]))), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "spans", "items"])


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    block, held = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct().toLocalIterator():
        size = len(text.encode())
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((name, text))
        held += size
    yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, spans (bytes start..end, words first..last; merged), items (ids, sorted as strings)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = []
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pw, values = K.Powers(), K.byte_values(True)
            for batch in batches:
                yield shard(batch, sent.value, pw, values)

        found.append(rows.mapInArrow(run, FOUND))
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # A row that repeats has the same text and so the same spans in every block.
    merged = every.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(found)).cast("int").alias("times"))
    return merged.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times").withColumn("spans", F.expr(JOINED))


#: Merges sorted spans that overlap or touch.
JOINED = """aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>), (done, s) ->
  CASE WHEN size(done) > 0 AND element_at(done, -1).last >= s.first THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
    'end', greatest(element_at(done, -1).end, s.end), 'first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last))))
  ELSE concat(done, array(s)) END)"""


def contaminated(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated: at least a twentieth of the words hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    out = found.select("doc_id", "text_hash", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(find_passages(docs, benchmark)).drop("text_hash")
