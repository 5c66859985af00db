"""Removal of passages that an earlier document has: suffixes compared by prefix hashes, in a merge sort.

A passage is a string of LENGTH bytes. Sorting every suffix of a corpus would shuffle it many times over, so suffixes are
first brought together by content. The anchor of a passage is the least 24-byte gram in it, by hash, the leftmost of
equals; equal passages have equal anchors at the same place. Neighbouring passages of one anchor form a context.

Steps 1 to 3 take contexts for equal by 64-bit hashes, without their bytes: of the n contexts of a batch or of one anchor
two are mistaken for each other with a chance of n ** 2 / 2 ** 65, 2e-9 for the 300,000 of a batch, 2e-5 for all batches
of 30 GB. Step 4 compares bytes.

1. Documents stand in batches, by a hash of doc_id. A batch sends (anchor, context hash, least doc_id) once for each
   context it holds, so that copies are aggregated before the shuffle.
2. By anchor: a context that another batch holds in a smaller document is answered with that doc_id; where an anchor
   has several contexts, each is asked for by the smallest document that has it.
3. Batches mark what lies in a context that a smaller document has, and send the bytes of contexts that were asked for.
4. By anchor again: the suffixes that begin at the passages of these contexts, but for those whose hash no other has, are
   merge-sorted. Two suffixes are compared
   by their common extension, found by binary search over polynomial prefix hashes. Suffixes next to each other with an
   extension of LENGTH are one passage once their bytes agree; all but its smallest document's are marked.
5. Marked bytes are joined into runs and removed.

The contexts of one anchor that differ meet in one task of step 4: 100 bytes for each different context.

Defined results: a null text is empty; texts under LENGTH bytes stay whole; a null doc_id neither loses nor removes
anything; rows of one doc_id don't remove each other's passages; further columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import kernels as K
from lexforge.llm.scratch import drop, release, saved

LENGTH, GRAM = 50, 24
#: Bytes of text in a batch, and for each part of the anchors.
BATCH, PART = 4 << 20, 8 << 20
#: Suffixes that are sorted at once, if one anchor hasn't more.
SORTED = 1 << 18
WORK = "kind int, key long, text_hash long, text binary, data binary"


def anchors(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, pw: K.Powers) -> tuple[np.ndarray, ...]:
    """For each context: row, anchor's place, first and last passage's place, anchor hash, context hash."""
    counts = np.maximum(0, np.diff(offsets) - LENGTH + 1)
    if not counts.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = K.prefix_hashes(data, values, pw)
    grams = K.mix((prefix[GRAM:] - prefix[:-GRAM]) * pw.down[: len(data) - GRAM + 1])
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width, target = 1, LENGTH - GRAM + 1
    while width * 2 <= target:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < target:
        least = np.minimum(least[: width - target], least[target - width :])
    place = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    at = (least[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    first, last, at = place[head], place[np.concatenate((head[1:], [len(place)])) - 1], at[head]
    shape = K.mix((at - first + 64 * (last - first)).astype(np.uint64) + K.BASE)
    context = K.mix(K.span_hashes(prefix, first, last + LENGTH, pw) ^ shape)
    return np.searchsorted(offsets, first, "right") - 1, at, first, last, grams[at], context


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte of each, so that high zero bytes compress."""
    n = len(columns[0])
    return n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns)


def unpack(raw: bytes, *types: type) -> tuple[list[np.ndarray], bytes]:
    """The columns, and what follows them."""
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(t))
        at += n * size
    return out, raw[at:]


def gathered(blobs: list[bytes], *types: type) -> list[np.ndarray]:
    parts = [unpack(b, *types)[0] for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in types]


class Batch:
    """The contexts of a batch's documents."""

    def __init__(self, table: pa.Table) -> None:
        pw, values = K.Powers(), K.byte_values(False)
        self.ids = table.column("doc_id").to_numpy()
        self.data, self.offsets = K.utf8(table.column("text"))
        found = []
        for lo, hi in K.slices(self.offsets):
            base = self.offsets[lo]
            row, at, first, last, anchor, context = anchors(self.data[base : self.offsets[hi]], self.offsets[lo : hi + 1] - base, values, pw)
            found.append((row + lo, at - first, first + base, last + base, anchor, context))
        self.row, self.lead, self.first, self.last, self.anchor, self.context = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
        self.doc = self.ids[self.row]
        self.key = pair(self.anchor, self.context)
        self.order = np.argsort(self.key, kind="stable")
        self.heads = np.flatnonzero(np.concatenate(([True], np.diff(self.key[self.order]) != 0))) if len(self.key) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(self.doc[self.order], self.heads) if len(self.key) else np.zeros(0, np.int64)


def pair(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    return anchor ^ K.mix(context + K.BASE)


def work(kind: int, rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    key, text_hash, text, data = ([r[i] for r in rows] for i in range(4))
    return pa.table({"kind": pa.array([kind] * len(rows), pa.int32()), "key": pa.array(key, pa.int64()), "text_hash": pa.array(text_hash, pa.int64()), "text": pa.array(text, pa.binary()), "data": pa.array(data, pa.binary())})


def split(parts: int, anchor: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns, anchor first, by part."""
    part = (K.mix(anchor) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            own = order[cuts[p] : cuts[p + 1]]
            yield p, [c[own] for c in (anchor, *columns)]


def answer(table: pa.Table) -> pa.Table:
    """Step 2: for each batch, contexts with a smaller document elsewhere, and contexts to be sent."""
    blobs, batches = table.column("data").to_pylist(), table.column("batch").to_pylist()
    anchor, context, doc = gathered(blobs, np.uint64, np.uint64, np.int64)
    batch = np.repeat(batches, [int.from_bytes(b[:8], "little") for b in blobs])
    order = np.lexsort((context, anchor))
    anchor, context, doc, batch = anchor[order], context[order], doc[order], batch[order]
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new = new_anchor | np.concatenate(([True], context[1:] != context[:-1]))
    heads = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.concatenate((heads, [len(doc)]))))
    groups = np.flatnonzero(new_anchor)
    several = np.repeat(np.add.reduceat(new.astype(np.int64), groups) > 1, np.diff(np.concatenate((groups, [len(doc)]))))
    later, asked = doc > least, several & (doc == least)
    rows = []
    by_batch = np.argsort(batch, kind="stable")
    by_batch = by_batch[later[by_batch] | asked[by_batch]]
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(batch[by_batch]) != 0))) if len(by_batch) else []
    for own in np.split(by_batch, cuts[1:]) if len(by_batch) else []:
        key = pair(anchor[own], context[own])
        rows.append((int(batch[own[0]]), 0, b"", pack(key, least[own], asked[own].astype(np.uint8))))
    return work(2, rows)


def mark(docs: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """Step 3: texts with the spans marked so far (kind 0), and contexts that were asked for (kind 1)."""
    key, least, asked = gathered(answers.column("data").to_pylist(), np.uint64, np.int64, np.uint8)
    if not docs.num_rows:
        return work(0, [])
    b = Batch(docs)
    order = np.argsort(key, kind="stable")
    key, least, asked = key[order], least[order], asked[order].astype(bool)
    own_key = b.key[b.order][b.heads]
    at = np.minimum(np.searchsorted(key, own_key), max(0, len(key) - 1))
    known = key[at] == own_key if len(key) else np.zeros(len(own_key), bool)
    smallest = np.where(known, np.minimum(b.least, least[at]), b.least) if len(key) else b.least
    sizes = np.diff(np.concatenate((b.heads, [len(b.key)])))
    smallest_of, asked_of = np.empty(len(b.key), np.int64), np.zeros(len(b.key), bool)
    smallest_of[b.order] = np.repeat(smallest, sizes)
    asked_of[b.order] = np.repeat(known & (asked[at] if len(key) else False), sizes)
    marked, sent = b.doc > smallest_of, asked_of & (b.doc == smallest_of)
    hashes = docs.column("text_hash").to_numpy()
    rows = []
    for row in np.unique(b.row[marked | sent]):
        lo, hi = np.searchsorted(b.row, (row, row + 1))
        own = np.arange(lo, hi)[marked[lo:hi]]
        base = b.offsets[row]
        rows.append((int(b.ids[row]), int(hashes[row]), b.data[base : b.offsets[row + 1]].tobytes(), pack(b.first[own] - base, b.last[own] + LENGTH - base)))
    out = [work(0, rows)]
    own = np.flatnonzero(sent)
    rows = []
    for p, (anchor, index) in split(parts, b.anchor[own], own) if len(own) else ():
        first, windows = b.first[index], b.last[index] - b.first[index] + 1
        size = windows + LENGTH - 1
        take = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        rows.append((p, 0, b"", pack(anchor, b.doc[index], hashes[b.row[index]], first - b.offsets[b.row[index]], b.lead[index].astype(np.uint8), windows.astype(np.uint8)) + b.data[take].tobytes()))
    return pa.concat_tables([*out, work(1, rows)])


class Suffixes:
    """Suffixes of a text, at most LENGTH bytes of each, compared by prefix hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.pw = data, K.Powers()
        self.prefix = K.prefix_hashes(data, K.byte_values(False), self.pw)

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        p, down = self.prefix, self.pw.down
        return (p[a + length] - p[a]) * down[a] == (p[b + length] - p[b]) * down[b]

    def met_twice(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which suffixes have the hash of another one's first LENGTH bytes in their group: others need no sorting."""
        key = K.mix((self.prefix[at + LENGTH] - self.prefix[at]) * self.pw.down[at]) + K.mix(group.astype(np.uint64) + K.BASE)
        order = np.argsort(key, kind="stable")
        same = np.concatenate(([False], np.diff(key[order]) == 0, [False]))
        out = np.empty(len(at), bool)
        out[order] = same[1:] | same[:-1]
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension: binary search for the longest equal prefix."""
        out = np.full(len(a), LENGTH, np.int64)
        left = np.flatnonzero(~self.same(a, b, out))
        lo, hi = np.zeros(len(left), np.int64), np.full(len(left), LENGTH - 1, np.int64)
        while (lo < hi).any():
            middle = (lo + hi + 1) // 2
            equal = self.same(a[left], b[left], middle)
            lo, hi = np.where(equal, middle, lo), np.where(equal, hi, middle - 1)
        out[left] = lo
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 by the order of the suffixes."""
        n = self.common(a, b)
        out = np.zeros(len(a), np.int64)
        differ = np.flatnonzero(n < LENGTH)
        out[differ] = np.sign(self.data[a[differ] + n[differ]].astype(np.int64) - self.data[b[differ] + n[differ]])
        return out

    def merge_sort(self, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Order of the suffixes at the given places within groups start..end, given for each: bottom up, all groups at
        once; the place of a suffix in a merged run is its rank in the other run, by binary search."""
        order = np.arange(len(at))
        width = 1
        while len(slot := np.flatnonzero(end - start > width)):
            run = start[slot] + (slot - start[slot]) // (2 * width) * (2 * width)
            middle, stop = np.minimum(run + width, end[slot]), np.minimum(run + 2 * width, end[slot])
            left = slot < middle
            lo, hi = np.where(left, middle, run), np.where(left, stop, middle)
            base = lo.copy()
            while len(open_ := np.flatnonzero(lo < hi)):
                probe = (lo[open_] + hi[open_]) // 2
                sign = self.compare(at[order[probe]], at[order[slot[open_]]])
                before = (sign < 0) | ((sign == 0) & ~left[open_])
                lo[open_], hi[open_] = np.where(before, probe + 1, lo[open_]), np.where(before, hi[open_], probe)
            new = order.copy()
            new[run + (slot - np.where(left, run, middle)) + (lo - base)] = order[slot]
            order = new
            width *= 2
        return order


def sort_suffixes(table: pa.Table) -> pa.Table:
    """Step 4: spans of passages that a smaller document has, for each document."""
    types = (np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8)
    parts = [unpack(b, *types) for b in table.column("data").to_pylist()]
    anchor, doc, text_hash, first, lead, windows = (np.concatenate(x) for x in zip(*(c for c, _ in parts), strict=True))
    data = np.frombuffer(b"".join(rest for _, rest in parts), np.uint8)
    lead, windows = lead.astype(np.int64), windows.astype(np.int64)
    start = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
    order = np.argsort(anchor, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(anchor[order]) != 0)))
    total = np.concatenate(([0], np.cumsum(windows[order])))
    cuts, lo = [], 0
    for e in np.append(edge[1:], len(order)):
        if total[e] - total[lo] >= SORTED or e == len(order):
            cuts.append((lo, int(e)))
            lo = int(e)
    spans = []
    for lo, hi in cuts:
        item = np.repeat(order[lo:hi], windows[order[lo:hi]])
        nth = np.arange(len(item)) - np.repeat(total[lo:hi] - total[lo], windows[order[lo:hi]])
        group = K.mix(anchor[item]) + (lead[item] - nth).astype(np.uint64)
        by_group = np.argsort(group, kind="stable")
        item, nth, group = item[by_group], nth[by_group], group[by_group]
        heads = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
        size = np.diff(np.concatenate((heads, [len(group)])))
        keep = np.repeat(size > 1, size)  # a passage alone at its anchor has no equal
        item, nth = item[keep], nth[keep]
        size = size[size > 1]
        if not len(item):
            continue
        used, item_of = np.unique(item, return_inverse=True)
        length = windows[used] + LENGTH - 1
        own_start = np.cumsum(length) - length
        suffixes = Suffixes(data[np.repeat(start[used] - own_start, length) + np.arange(length.sum())])
        at = own_start[item_of] + nth
        twice = suffixes.met_twice(at, np.repeat(np.arange(len(size)), size))
        if not twice.any():
            continue
        at, item, nth, size = at[twice], item[twice], nth[twice], np.add.reduceat(twice.astype(np.int64), np.cumsum(size) - size)
        size = size[size > 0]
        begin = np.repeat(np.cumsum(size) - size, size)
        sorted_ = suffixes.merge_sort(at, begin, begin + np.repeat(size, size))
        at, item, nth = at[sorted_], item[sorted_], nth[sorted_]
        equal = np.flatnonzero((begin[1:] == begin[:-1]) & (suffixes.common(at[1:], at[:-1]) == LENGTH))
        bytes_ = np.arange(LENGTH)
        sure = np.concatenate([(suffixes.data[at[x + 1][:, None] + bytes_] == suffixes.data[at[x][:, None] + bytes_]).all(1) for x in np.array_split(equal, len(equal) // 50_000 + 1)])
        fresh = np.ones(len(at), bool)
        fresh[equal[sure] + 1] = False
        heads = np.flatnonzero(fresh)
        least = np.repeat(np.minimum.reduceat(doc[item], heads), np.diff(np.concatenate((heads, [len(at)]))))
        hit = doc[item] > least
        spans.append(np.stack((doc[item[hit]], text_hash[item[hit]], first[item[hit]] + nth[hit])))
    doc, text_hash, place = np.concatenate(spans, 1) if spans else np.zeros((3, 0), np.int64)
    by_doc = np.lexsort((place, text_hash, doc))
    doc, text_hash, place = doc[by_doc], text_hash[by_doc], place[by_doc]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(text_hash) != 0)))) if len(doc) else np.zeros(0, np.int64)
    rows = [(int(doc[own[0]]), int(text_hash[own[0]]), b"", pack(place[own], place[own] + LENGTH)) for own in (np.split(np.arange(len(doc)), cut[1:]) if len(doc) else [])]
    return work(3, rows)


RESULT = "doc_id long, text_hash long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5, from (doc_id, text_hash, text, data, more)."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for raw, data, more in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            text = np.frombuffer(raw, np.uint8)
            lo, hi = gathered([data, *(more or [])], np.int64, np.int64)
            depth = np.bincount(lo, minlength=len(text) + 1) - np.bincount(hi, minlength=len(text) + 1)
            gone = np.concatenate(([False], np.cumsum(depth)[:-1] > 0, [False]))
            edges = np.flatnonzero(gone[1:] != gone[:-1])
            for column, value in zip(out, (int(gone.sum()), len(edges) // 2, hashlib.sha256(text[~gone[1:-1]].tobytes()).hexdigest(), edges.tobytes()), strict=True):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", "text_hash", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """RESULT for the documents that may hold a repeated passage, each (doc_id, text) once; spans: 64-bit starts and ends
    of the maximal removed runs, in bytes, alternating."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(f"doc_id is not null and octet_length(text) >= {LENGTH}")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART)
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(total // BATCH + 1)).alias("batch"))

    def contexts(table: pa.Table) -> pa.Table:
        b = Batch(table)
        where = b.order[b.heads]
        batch = table.column("batch")[0].as_py()
        rows = [(p, batch, pack(*own)) for p, own in split(parts, b.anchor[where], b.context[where], b.least)] if len(where) else []
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})

    sent = texts.groupBy("batch").applyInArrow(contexts, "part long, batch long, data binary")
    answers = saved(sent.groupBy("part").applyInArrow(answer, WORK), "answers")
    release(spark)
    marked = texts.groupBy("batch").cogroup(answers.withColumnRenamed("key", "batch").groupBy("batch")).applyInArrow(lambda docs, answers: mark(docs, answers, parts), WORK)
    marked = saved(marked, "marked")
    drop(answers)
    release(spark)
    more = marked.where("kind = 1").groupBy("key").applyInArrow(sort_suffixes, WORK).groupBy("key", "text_hash").agg(F.collect_list("data").alias("more"))
    # A document that repeats has its spans once.
    rows = marked.where("kind = 0").dropDuplicates(["key", "text_hash"]).join(more, ["key", "text_hash"], "left")
    return rows.select(F.col("key").alias("doc_id"), "text_hash", "text", "data", "more").mapInArrow(remove, RESULT)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256"))
    cut = repeated_spans(docs).where("n_removed > 0").select("doc_id", "text_hash", "n_removed", "n_spans", "kept_sha256")
    out = whole.join(cut, ["doc_id", "text_hash"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
