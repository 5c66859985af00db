import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from lexforge.llm import kernels as K
from lexforge.llm import quality as Q


def test_keeps_clean_and_drops_toxic(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.learn(docs.where("doc_id % 4 <> 0"), labels)
    out = {r.doc_id: r for r in Q.grade(docs.where("doc_id % 4 = 0"), model).collect()}
    want = pd.read_parquet(f"{path}/labels.parquet")
    want = want[want.doc_id % 4 == 0]
    kept = lambda rows: np.mean([out[d].keep for d in rows.doc_id])
    good, toxic, low = want[(want.quality == 1) & (want.toxic == 0)], want[(want.quality == 1) & (want.toxic == 1)], want[want.quality == 0]
    print(kept(good), kept(toxic), kept(low))
    assert kept(good) > 0.98 and kept(toxic) < 0.15 and kept(low) < 0.02


def test_ordered_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 3000)
    rows = [np.unique(np.concatenate(([50 + i], rng.integers(0, 40, 3), [100 + g for g in range(grades[i], 3)]))) for i in range(3000)]
    rows = [r.astype(np.uint32) for r in rows]
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    model = Q.fit(np.concatenate(rows), at, grades)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.add.reduceat(model.weights[np.concatenate(rows)].astype(float), at[:-1]))
    assert (np.diff(tails, axis=0) <= 1e-12).all()
    assert (np.abs(tails.sum(0) - grades) < 0.5).mean() > 0.95


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "plain words"), (2, "plain words"), (3, "moron " * 40_000), (4, "\x00 \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS keep", "2 AS tail")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep and r.tail == 1 for r in Q.grade(df, Q.learn(df, none)).collect())
    labels = spark.createDataFrame([(3, 1, 1), (2, 1, 0), (None, 0, 0), (9, None, None), (1, 0, None)], none.schema)
    assert Q.grade(df, Q.learn(df, labels)).count() == len(rows) and Q.grade(df.limit(0), Q.learn(df, labels)).count() == 0


def test_features_do_not_cross_rows():
    texts = ["a b", "c", None, "", "a b"]
    rows = [set(ids[at[i] : at[i + 1]].tolist()) for _, _, ids, at in Q.features(pa.array(texts)) for i in range(5)]
    assert rows[0] == rows[4] and rows[0] != rows[1] and rows[2] == rows[3]


def plain_features(text):
    """The features of a text, told again byte by byte."""
    mask, base = (1 << 64) - 1, int(K.BASE)
    values = [int(x) for x in K.byte_values(True)]

    def mix(h):
        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, 1)):
            h = (h ^ h >> shift) * factor & mask
        return h

    def value(raw):
        return sum(values[b] * pow(base, i, 1 << 64) for i, b in enumerate(raw)) & mask

    raw = (text or "").encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw)
    out = {mix(value(w)) >> 64 - Q.BITS for w in words} | {mix(value(w[: Q.STEM]) ^ base) >> 64 - Q.BITS for w in words}
    low = [w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for w in words]
    shares = [sum(raw.count(m) for m in marks.encode()) / max(1, len(raw)) for marks in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "|", "#$%&*", "<>{}[]=;\\")]
    shares.append(sum(a == b for a, b in zip(low, low[1:], strict=False)) / max(1, len(low)))
    level = [min(9, max(1, math.floor(math.log2(s) + 9))) if s else 0 for s in shares]
    marks = {(1 << Q.BITS) + v + 16 * i for i, v in enumerate(level) if v}
    return out | (marks or {(1 << Q.BITS) + 16 * 6})


def test_like_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.learn(docs, labels)
    rng = np.random.default_rng(3)
    if not len(model.thresholds):
        model = Q.Model(np.zeros(Q.TABLE, np.float32), np.array([-2.0, -1.0]))
    model.weights[:] = rng.normal(size=Q.TABLE) / 9
    texts = pd.read_parquet(f"{path}/documents.parquet").set_index("doc_id").text
    rows = Q.grade(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        score = sum(float(model.weights[f]) for f in plain_features(texts[r.doc_id]))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(r.expected_grade - sum(tails)) < 1e-6 and abs(r.tail - tails[-1]) < 1e-6 and r.keep == (r.tail >= Q.KEEP_TAIL)


def test_fit_is_at_the_likelihoods_top():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 2000)
    rows = [np.unique(np.concatenate(([50], rng.integers(0, 30, 2), [100 + g for g in range(grades[i], 2) if rng.random() < 0.8]))).astype(np.uint32) for i in range(2000)]
    ids, at = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    model = Q.fit(ids, at, grades)
    weight = 2000 / np.bincount(grades) / 3

    def loss(weights, cuts):
        scores = np.array([weights[r].sum() for r in rows])
        tails = np.vstack((np.ones(2000), 1 / (1 + np.exp(cuts[:, None] - scores)), np.zeros(2000)))
        return -(weight[grades] * np.log(tails[grades, np.arange(2000)] - tails[grades + 1, np.arange(2000)])).mean()

    best = loss(model.weights.astype(float), model.thresholds)
    for j in range(2):
        for by in (-0.2, 0.2):
            assert loss(model.weights.astype(float), model.thresholds + by * (np.arange(2) == j)) > best - 1e-4
    for f in (100, 101):
        for by in (-0.2, 0.2):
            moved = model.weights.astype(float)
            moved[f] += by
            assert model.weights[f] < 0 and loss(moved, model.thresholds) > best - 1e-4


def test_repeated_rows_are_read_once(spark):
    docs = spark.createDataFrame([(n, "ab cd") for n in range(4)] + [(7, f"t {n % 3}") for n in range(500)], "doc_id long, text string")
    grades = spark.createDataFrame([(n, n % 2) for n in range(4)] + [(7, 1)], "doc_id long, grade int")
    ids, at, grade = Q.fit_rows(docs, grades, 100)
    assert len(grade) <= 5
