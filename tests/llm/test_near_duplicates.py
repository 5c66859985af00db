import random
import re

import pandas as pd
import pytest

from lexforge.llm import near_duplicates as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, threshold=0.85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 1000 >= round(threshold * 1000) * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["the", "on", "er", "ß", "ti"]) for _ in range(3))
    rows, n = [], 0
    for length in (1, 2, 4, 5, 7, 30, 80, 200, 700):
        base = [word() for _ in range(length)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(length)] = word()
            rows.append((n, " ".join(text).upper() if edits == 1 else "  ".join(text)))
            n += 1
    return rows + [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "a b c d e " * 20_000)]


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    return N.near_duplicates(df, **more).collect()


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_like_brute_force(spark, threshold):
    rows = sample()
    out = {r.doc_id: r for r in result(spark, rows, threshold=threshold)}
    want = brute(rows, threshold)
    assert {d: (r.n_shingles, r.component_id) for d, r in out.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in out.items())


def test_given_table(spark):
    path = "/root/testdata/sf0.001"
    pdf = pd.read_parquet(f"{path}/documents.parquet")
    want = brute(list(zip(pdf.doc_id, pdf.text, strict=True)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.op4_near_duplicates(spark, path).collect()} == want


def test_chain_of_edits_is_one_component(spark):
    rng = random.Random(1)
    text = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = list(text)
        text[rng.randrange(300)] = f"x{i}"
        rows.append((i + 10, " ".join(text)))
    assert {r.component_id for r in result(spark, rows)} == {10}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, None)], "doc_id long, text string").selectExpr("*", "1 AS component", "2 AS key", "3 AS rep")
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in N.near_duplicates(df).collect())
    assert out == [(0, 1, 0, True), (1, 0, 1, True), (3, 1, 3, True), (3, 1, 3, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_many_blocks(spark, monkeypatch):
    """Buckets of several components, cut into blocks of four rows."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "SMALL", 2)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for n in range(90):
        text = list(base)
        for _ in range(n % 9):  # near the base, or near but not linked, or linked by steps
            text[rng.randrange(0, 120, 7)] = f"v{rng.randrange(10**6)}"
        rows.append((n, " ".join(text)))
    for threshold in (0.85, 0.8):
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, rows, threshold=threshold)}
        assert out == brute(rows, threshold)
        assert len({c for _, c in out.values()}) > 1


def test_rows_of_one_id_are_one_node(spark):
    words = [f"w{i}" for i in range(60)]
    other = [f"z{i}" for i in range(40)]
    rows = [(3, " ".join(words)), (7, " ".join(words[:-1] + ["x"])), (7, " ".join(other)), (9, " ".join(other + ["y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.near_duplicates(df).collect()) == [(3, 3), (7, 3), (7, 3), (9, 3)]
