import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from lexforge.llm import suffix_dedup as S


def brute(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49) if d is not None else ():
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49) if d is not None else ():
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((d, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def run(spark, tmp_path):
    def go(rows):
        spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS batch", "3 AS kind", "'x' AS data").write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        return sorted((tuple(r) for r in S.op6_suffix_dedup(spark, str(tmp_path)).collect()), key=str)

    return go


def case(seed):
    rng = random.Random(seed)
    alphabet = "ab é" if seed % 2 else "abcdefgh ijklmnop\nß"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (30, 48, 49, 50, 51, 60, 90, 200, 700)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 90)) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) // 3 + 1)
            parts.insert(rng.randrange(len(parts) + 1), p[a : len(p) - rng.randrange(0, len(p) // 4 + 1)] if rng.random() < 0.6 else p)
        rows.append((i * 3 % 61, "".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, rows[7][1][:1000] + "x" + rows[7][1]), (300, "a" * 5000), (301, "a" * 49), (302, "a" * 50), (303, None), (304, ""), (None, rows[3][1]), (305, "b" * 120), (305, "c" + "b" * 120), (306, "b" * 70), (306, "b" * 70)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(run, seed, monkeypatch):
    monkeypatch.setattr(S, "BATCH", 3000)
    monkeypatch.setattr(S, "PART", 2000)
    monkeypatch.setattr(S, "SORTED", 500)
    rows = case(seed)
    assert run(rows) == brute(rows)


def test_given_table(spark):
    path = "/root/testdata/sf0.001"
    pdf = pd.read_parquet(f"{path}/documents.parquet")
    got = sorted((tuple(r) for r in S.op6_suffix_dedup(spark, path).collect()), key=str)
    assert got == brute(list(zip(pdf.doc_id.tolist(), pdf.text, strict=True)))


def test_empty(run):
    assert run([]) == []
    assert run([(1, None)]) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_merge_sort_sorts_suffixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1500] = data[:500]
    at = rng.permutation(2900)[:800]
    edges = np.array([0, 1, 3, 10, 200, 201, 800])
    start, end = (np.repeat(x, np.diff(edges)) for x in (edges[:-1], edges[1:]))
    order = S.Suffixes(data).merge_sort(at, start, end)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        got = [data[p : p + 50].tobytes() for p in at[order[lo:hi]]]
        assert got == sorted(got) and sorted(order[lo:hi]) == list(range(lo, hi))


def test_contexts_of_a_frequent_anchor_have_different_hashes():
    rng, values, pw, n = np.random.default_rng(5), S.K.byte_values(False), S.K.Powers(), 300_000
    lines = rng.integers(97, 123, (20_000, 24), np.uint8)
    grams = np.concatenate([S.K.mix(S.K.span_hashes(S.K.prefix_hashes(x, values, pw), np.array([0]), np.array([24]), pw)) for x in lines])
    docs = rng.integers(97, 123, (n, 76), np.uint8)
    docs[:, 26:50] = lines[grams.argmin()]
    found = [S.anchors(x.reshape(-1), np.arange(len(x) + 1) * 76, values, pw) for x in np.split(docs, 20)]
    anchor, context = (np.concatenate([f[i] for f in found]) for i in (4, 5))
    assert (anchor == grams.min()).sum() > 0.9 * n
    assert len(np.unique(np.stack((anchor, context.astype(np.uint64))), axis=1).T) == len(anchor)
