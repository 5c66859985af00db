import re
from collections import defaultdict

import pytest

from lexforge.llm import mixture as M

SCHEMA = "doc_id long, text string, source string"


def shares(sizes, cap=3.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        out = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        above = {s for s in open_ if out[s] > cap * sizes[s] + 1e-9}
        if not above:
            return out | {s: cap * sizes[s] for s in full}
        full |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return [r.asDict() | r.row.asDict() for r in M.allocate(df).collect()]


ROWS = [(i, "w " * (1 + i * 7 % 40), ("big", "big", "b", "é", None, "z", "a")[i % 7]) for i in range(700)] + [(700, None, "b"), (701, "", "only"), (702, "x y z\t\n", "tiny"), (None, "k l", "a"), (5, "same", "a"), (5, "same", "a")]


def test_targets_and_takes(spark):
    out = run(spark, ROWS)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r["size"] == words(r["text"]) and r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["taken"] for c in r["copies"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = shares(sizes)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and all(r["source_size"] == sizes[r["source"]] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, run(spark, ROWS[::-1])))


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w w", ("a", "b", "c")[i % 3]) for i in range(3000)]
    out = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.position for r in out] == sorted(r.position for r in out) and 0 <= out[0].position and out[-1].position <= 1
    for source, (first, last) in zip("abc", M.SCHEDULE, strict=True):
        own = [r for r in out if r.source == source]
        early = sum(r.taken for r in own if r.position < 0.5) / sum(r.taken for r in own)
        assert early == pytest.approx((3 * first + last) / 4 / (first + last), abs=0.01)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mix(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "s")], SCHEMA).selectExpr("*", "9 AS size", "8 AS key", "7 AS position", "6 AS row")
    assert [(r.doc_id, r.size, r.key, r.row, r.taken) for r in M.mix(df).collect()] == [(1, 9, 8, 6, 2)]
