"""Ordinal cumulative-link regression on graded ratings.

P(grade > j) = logistic(score - threshold[j]): one weight for each hashed feature is shared by all grades, thresholds are
ordered. The expected grade is the sum of the tails; the tail of the top grade selects documents.

Features of a text, all in one hashed table: which words and word starts it holds (A-Z lower-cased), and the level, on a logarithmic
scale, of the shares of its bytes or words that are capitals, digits, marks of several kinds, or a repeat of
the word before. Whole texts count, long ones too.

The model is fitted on at most FIT_ROWS labelled documents, in the order of a hash. A feature has a weight if MIN_ROWS of
them hold it and its share in the grades below a threshold is larger than in those above by SURE standard errors, so that a
text is marked down for what it holds, never for what it lacks. Near copies, told by bands of minima of their rare features, count once in the fit, or else a group of copies would teach its words. Grades of the given labels: 0 for low quality, 1 for toxic, 2 for the rest.

Defined results: a null or empty text has the features of an empty text, so its grade follows from its levels alone; a
document of a null or unknown id is graded as any other; repeated labels of a document count each; without labels, or
with labels of one grade only, every tail is 1 and nothing is rejected; further columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import kernels as K

FIT_ROWS, MIN_ROWS, SURE, BITS, ROUNDS, RIDGE, KEEP_TAIL = 12_000, 5, 5.0, 20, 400, 1e-7, 0.5
#: Bytes of a word's start that are a feature too, as insults are inflected.
STEM = 4
#: Hashed words and word starts, and then the levels, which share no place with words.
TABLE = (1 << BITS) + 256
TOP = 2
RESULT = "doc_id long, expected_grade double, tail double, keep boolean"


@dataclass
class Model:
    weights: np.ndarray  # float32, by feature
    thresholds: np.ndarray  # ordered; none where nothing could be learned

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j), a row for each j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[:, None] - scores, -50, 50)))


def levels(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each kind of share, its level 0..9 in each text."""
    size = np.maximum(1, np.diff(offsets))
    out = []

    def add(count: np.ndarray, of: np.ndarray) -> None:
        share = count / of
        out.append(np.where(share > 0, np.clip(np.floor(np.log2(np.maximum(share, 1e-9)) + 9), 1, 9), 0).astype(np.uint64))

    for marks in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "|", "#$%&*", "<>{}[]=;\\"):
        member = np.zeros(256, bool)
        member[list(marks.encode())] = True
        total = np.concatenate(([0], np.cumsum(member[data])))
        add(total[offsets[1:]] - total[offsets[:-1]], size)
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    inner = first[:-1][np.diff(first) > 0]
    same[inner] = 0
    total = np.concatenate(([0], np.cumsum(same)))
    n = np.maximum(1, np.diff(first))
    add(total[first[1:]] - total[first[:-1]], n)
    return out


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from and to, their features one after another (each once a row), and where each row begins."""
    pw, values = K.Powers(), K.byte_values(True)
    data, offsets = K.utf8(column)
    shift = np.uint64(64 - BITS)
    for lo, hi in K.slices(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = K.word_bounds(part, own, K.ALNUM)
        prefix = K.prefix_hashes(part, values, pw)
        words = K.mix(K.span_hashes(prefix, starts, ends, pw))
        stems = K.mix(K.span_hashes(prefix, starts, np.minimum(ends, starts + STEM), pw) ^ K.BASE)
        level = np.stack(levels(part, own, words, first), 1)
        shown = level > 0  # what a text lacks is no feature
        shown[:, -1] |= ~shown.any(1)  # but none is without features
        marks = ((1 << BITS) + level + np.uint64(16) * np.arange(level.shape[1], dtype=np.uint64)).astype(np.uint32)
        ids, stems = ((x >> shift).astype(np.uint32) for x in (words, stems))
        parts, at = [], np.zeros(hi - lo + 1, np.int64)
        for row in range(hi - lo):
            one = np.sort(np.concatenate((ids[first[row] : first[row + 1]], stems[first[row] : first[row + 1]], marks[row][shown[row]])))
            parts.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
            at[row + 1] = at[row] + len(parts[-1])
        yield lo, hi, np.concatenate(parts), at


def fit_rows(docs: DataFrame, grades: DataFrame, fit_rows_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, row starts and grades of the documents to fit; grades: (doc_id, grade). At most fit_rows_ grades are
    chosen, so they are broadcast; of rows that repeat a doc_id one is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, at in features(batch.column(0)):
                packed = [ids[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["h", "grade", "ids"])

    chosen = grades.where("grade is not null and doc_id is not null").withColumn("h", F.xxhash64("doc_id", F.lit("quality"))).orderBy("h", "doc_id", "grade").limit(fit_rows_)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "h", F.col("grade").cast("int").alias("grade"), F.xxhash64("text").alias("text_hash"))
    rows = rows.groupBy("h", "grade").agg(F.min(F.struct("text_hash", "text")).alias("own")).select("own.text", "h", "grade")
    found = sorted((r.h, r.grade, bytes(r.ids)) for r in rows.mapInArrow(run, "h long, grade int, ids binary").toLocalIterator())
    return single([np.frombuffer(ids, np.uint32) for _, _, ids in found], np.array([grade for _, grade, _ in found], np.int64))


def single(ids: list[np.ndarray], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that are no near copy of one before: none of ten bands of four minima of their rare features is met."""
    held = np.bincount(np.concatenate(ids), minlength=TABLE) if ids else np.zeros(TABLE)
    salts = np.arange(1, 41, dtype=np.uint64)[:, None] * K.BASE
    met: set[tuple[int, ...]] = set()
    chosen = []
    for i, own in enumerate(ids):
        rare = own[held[own] <= max(2, len(ids) // 100)].astype(np.uint64)
        least = K.mix(rare + salts).min(1).tolist() if len(rare) else own.tolist()
        bands = {(n, *least[n : n + 4]) for n in range(0, len(least), 4)}
        if not bands & met:
            chosen.append(i)
        met |= bands
    ids, grades = [ids[i] for i in chosen], grades[chosen]
    at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), at, grades


def telling(ids: np.ndarray, row: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Which features tell of a lower grade; a text without any has the score 0."""
    seen = np.bincount(ids, minlength=TABLE)
    sure = np.zeros(TABLE)
    for j in range(int(grades.max())):
        above = grades > j
        high, low = max(1, int(above.sum())), max(1, int((~above).sum()))
        held = np.bincount(ids, above[row], minlength=TABLE)
        share = seen / len(grades)
        error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / high + 1 / low))
        sure = np.maximum(sure, ((seen - held) / low - held / high) / error)
    return (seen >= MIN_ROWS) & (sure >= SURE)


def fit(ids: np.ndarray, at: np.ndarray, grades: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Adam on the likelihood of the grades, all rows at once; the classes weigh alike."""
    weights = np.zeros(TABLE, np.float32)
    if len(np.unique(grades)) < 2:
        return Model(weights, np.zeros(0))
    n, top = len(grades), int(grades.max())
    row = np.repeat(np.arange(n), np.diff(at))
    use = telling(ids, row, grades)[ids]
    ids, row = ids[use].astype(np.int64), row[use]
    balance = np.bincount(grades, minlength=top + 1)
    share = (n / np.maximum(1, balance) / (balance > 0).sum())[grades] / n
    free = np.linspace(-3, -1, top) if top > 1 else np.full(1, -1.0)
    gaps = np.log(np.diff(free)) if top > 1 else np.zeros(0)
    theta = np.concatenate(([free[0]], gaps))
    w = np.zeros(TABLE)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)]
    for turn in range(1, rounds + 1):
        cuts = np.concatenate(([theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))))
        scores = np.bincount(row, w[ids], minlength=n)
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        upper, lower = (1 / (1 + np.exp(np.clip(scores - edges[grades + i], -50, 50))) for i in (1, 0))
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper), lower * (1 - lower)
        slope = share * (up - low) / p  # of the loss by the score
        g_cut = np.zeros(top)
        for j in range(top):
            g_cut[j] = (share * np.where(grades == j, -up, np.where(grades == j + 1, low, 0.0)) / p).sum()
        g_theta = np.concatenate(([g_cut.sum()], [np.exp(theta[i + 1]) * g_cut[i + 1 :].sum() for i in range(top - 1)]))
        g_w = np.bincount(ids, slope[row], minlength=TABLE) + RIDGE * w
        for value, gradient, m in ((w, g_w, moments[:2]), (theta, g_theta, moments[2:])):
            m[0] += 0.1 * (gradient - m[0])
            m[1] += 0.01 * (gradient**2 - m[1])
            value -= 0.5 * (1 - turn / (rounds + 1)) * (m[0] / (1 - 0.9**turn)) / (np.sqrt(m[1] / (1 - 0.99**turn)) + 1e-7)
        np.minimum(w, 0, out=w)
    cuts = np.concatenate(([theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))))
    return Model(w.astype(np.float32), cuts)


def grade(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """RESULT, a row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lo, hi, ids, at in features(batch.column(1)):
                scores = np.add.reduceat(model.weights[ids].astype(np.float64), at[:-1])
                tails = model.tails(scores)
                top = tails[-1] if len(tails) else np.ones(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(tails.sum(0)), pa.array(top), pa.array(top >= keep_tail)], names=["doc_id", "expected_grade", "tail", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def select(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows of docs, with all their columns, that the model keeps."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lo, hi, ids, at in features(batch.column(place)):
                tails = model.tails(np.add.reduceat(model.weights[ids].astype(np.float64), at[:-1]))
                yield batch.slice(lo, hi - lo).filter(pa.array(tails[-1] >= keep_tail)) if len(tails) else batch.slice(lo, hi - lo)

    return docs.mapInArrow(run, docs.schema)


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic)."""
    value = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), TOP)
    return labels.select("doc_id", value.alias("grade"))


def learn(docs: DataFrame, labels: DataFrame, fit_rows_: int = FIT_ROWS) -> Model:
    return fit(*fit_rows(docs, rated(labels), fit_rows_))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return grade(docs, learn(docs, labels))
