import hashlib
import random
import re

import numpy as np
import pandas as pd

from lexforge.llm import decontamination as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        if w and name is not None:
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(name))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items):
    found = D.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contaminated(found).collect()), key=str)
    assert got == brute(docs, items)
    text = {}
    for d, t in docs:
        text.setdefault(d, t)
    for r in found.collect():
        for s in r.spans if r.doc_id != 7 else ():
            assert words(text[r.doc_id].encode()[s.start : s.end].decode()) == words(text[r.doc_id])[s.first : s.last]


def case():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha Beta ga-mma d3lta été the The on".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 12, 13, 14, 30, 40, 55])] + [(90, ""), (91, None), (None, "gold"), (2, "second text of two")]
    docs = [(i, "\n".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    for i in range(40, 80):
        item = rng.choice(items[4:9])[1].split()
        a = rng.randrange(len(item))
        docs.append((i, "x, ".join([word()] * 5) + " " + " ".join(item[a:]).upper() + "; " + " ".join(item[:a]) + "." + "y " * rng.randrange(300)))
    return docs + [(100, None), (101, ""), (102, "!?"), (7, docs[7][1]), (7, "the"), (None, "alpha beta"), (103, "the " * 50_000)], items


def test_like_brute_force(spark):
    docs, items = case()
    check(spark, docs, items)
    check(spark, docs, [x for x in items if len(words(x[1])) > 11])
    check(spark, docs[:3], [])
    check(spark, [], items)


def test_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 120)
    check(spark, *case())


def test_given_table(spark):
    path = "/root/testdata/sf0.001"
    docs, items = (pd.read_parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in D.op2_decontaminate(spark, path).collect()), key=str)
    assert got == brute(list(zip(docs.doc_id, docs.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 6, 500)
    index = D.FMIndex(text)
    for n in (1, 2, 3, 5):
        phrases = rng.integers(1, 7, (40, n))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(501 - n) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want
