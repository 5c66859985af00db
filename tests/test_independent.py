"""Plans against small programs that work differently: counters and loops over the words of sf0.001."""

import math
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

from lexforge import catalogue
from lexforge.operators import packing as P
from lexforge.operators.roots import VOWELS
from lexforge.operators.restoring import ENDINGS
from lexforge.operators.segment import path_score, splits_of

WHERE = "/root/testdata/sf0.001"
Q = catalogue.queries()
LETTERS = re.compile(r"[^\W\d_]+")


@pytest.fixture(scope="module")
def words():
    docs = pd.read_parquet(f"{WHERE}/documents.parquet")
    out = defaultdict(set)
    for lang, text in zip(docs.lang, docs.text, strict=True):
        out[lang] |= set(LETTERS.findall(text.lower()))
    return out


def affix_counts(words, suffix):
    c = Counter()
    for w in words:
        for n in range(1, min(len(w), 10) + 1):
            c[w[-n:] if suffix else w[:n]] += 1
    return c


def test_language_bias(spark, words):
    for r in Q["language_bias"](spark, WHERE).collect():
        own, sides = words[r.lang], {}
        for suffix in (True, False):
            types, derived = Counter(), set()
            for w in own:
                for n in range(2, min(len(w) - 2, 8) + 1):
                    if (w[:-n] if suffix else w[n:]) in own:
                        types[w[-n:] if suffix else w[:n]] += 1
                        derived.add(w)
            kept = {a: f for a, f in types.items() if f >= 5}
            sides[suffix] = (sum(f * len(a) for a, f in kept.items()), len(kept), len(derived))
        assert (r.suffix_productivity, r.suffix_candidates, r.suffix_words) == sides[True]
        assert (r.prefix_productivity, r.prefix_candidates, r.prefix_words) == sides[False]
        assert r.ratio == pytest.approx(math.sqrt(sides[True][0] / sides[False][0] * sides[True][2] / sides[False][2]), abs=1e-5)


def filtered(words, suffix):
    """The affix filter as rules on counters, one affix after another."""
    count = affix_counts(words, suffix)
    parent = (lambda a: a[1:]) if suffix else (lambda a: a[:-1])
    children = defaultdict(list)
    for a, f in count.items():
        if len(a) > 1 and f >= max(3, 0.01 * count[parent(a)]):
            children[parent(a)].append(a)
    vowel = set("aeiouy")
    top = sorted((a for a in count if len(a) >= 3), key=lambda a: (-count[a], a))[:50]
    v = sum(ch in vowel for a in top for ch in a[:3])
    heavy = v > 0 and 3 * len(top) - v <= 3 * v
    candidates = {a for a, f in count.items() if f >= math.floor(len(words) ** 0.3)}
    out = set()
    for a in candidates:
        n, kids = len(a), sorted((count[k] / count[a] for k in children[a]), reverse=True)
        share = 1.0 if n == 1 else count[a] / count[parent(a)]
        if n > 1 and heavy and not set(a) & vowel:
            continue
        if n >= 3 and not suffix and share <= 0.5 and not {a[-1], a[-2]} & vowel:
            continue
        limit = 0.10 if n == 2 else 0.035
        mixed = n == 2 and ((a[0] in vowel, a[1] in vowel) == ((False, True) if suffix else (True, False)))
        if mixed and share <= min(limit, 0.12):
            limit = 0.015
        if share <= limit:
            continue
        if n == 1:
            if not (suffix and a in "aeiou"):
                out.add(a)
            continue
        above = sum(k > {2: 0.035, 3: 0.08, 4: 0.315}.get(n, 0.55) for k in kids)
        first, second = (kids + [0.0])[0], kids[1] / kids[0] if len(kids) > 1 else 0.0
        often, settled = share > 0.7, (n >= 5 and share > 0.55) or (n >= 6 and share > 0.25 and bool(kids))
        if not often and not settled and above < 2 and first > 0.55:
            continue
        if not often and not settled and above == 1 and not (first < 0.55 and share > 0.035):
            continue
        deep = sum(bool(children[k]) for k in children[a]) >= 3 and share > 0.10
        if not (0.35 <= second < 0.5 or often or deep):
            family = children[parent(a)]
            if not settled and n >= 4 and parent(a) in candidates and len(family) >= 3 and count[a] / sum(count[x] for x in family) < (0.33 if kids else 0.5):
                continue
            if second >= 0.85 and first > 0.2 and above < 2:
                continue
        out.add(a)
    return out


def test_filtered_affixes(spark, words):
    got = defaultdict(set)
    for r in Q["filtered_affixes"](spark, WHERE).collect():
        got[r.lang, r.side].add(r.affix)
    for lang, own in words.items():
        for side in ("prefix", "suffix"):
            assert got[lang, side] == filtered(own, side == "suffix")


def test_neoclassical_forms(spark, words):
    got = {(r.lang, r.part): (r.freq, r.f_entropy, r.b_entropy) for r in Q["neoclassical_forms"](spark, WHERE).collect()}
    want = {}
    for lang, own in words.items():
        left, right, total, beside = defaultdict(Counter), defaultdict(Counter), Counter(), Counter()
        for w in own:
            for n in range(3, min(10, len(w)) + 1):
                for i in range(len(w) - n + 1):
                    p, a, b = w[i : i + n], w[i - 1] if i else "^", w[i + n] if i + n < len(w) else "$"
                    total[p] += 1
                    left[p][a] += 1
                    right[p][b] += 1
                    beside[p] += a in VOWELS or b in VOWELS
        h = lambda c: -sum(x / c.total() * math.log2(x / c.total()) for x in c.values())
        for p, f in total.items():
            if f >= 12 and (beside[p] >= 0.7 * f or f >= 50):
                e = h(left[p]) + h(right[p])
                if e > 3.5 or (beside[p] >= 0.8 * f and e > 0.1):
                    want[lang, p] = (f, pytest.approx(h(right[p]), abs=0.0051), pytest.approx(h(left[p]), abs=0.0051))
    assert got == want


def test_packed_marks(spark):
    rows = defaultdict(list)
    for r in Q["sequence_marks"](spark, WHERE).sort("stream", "step", "place").collect():
        rows[r.stream, r.step].append(r)
    assert all(len(x) == P.MAX_LEN for x in rows.values()) and {s for s, _ in rows} == set(range(P.STREAMS))
    for (stream, _), row in rows.items():
        ids, resets, position = [r.id for r in row], 0, -1
        going_on = ids[0] not in (P.BOS, P.PAD)
        for i, r in enumerate(row):
            resets += r.id == P.BOS
            position = 0 if r.id == P.BOS or i == 0 else position + (r.id != P.PAD)
            pad = r.id == P.PAD
            assert r.sub_sequence == (0 if pad else resets + stream * (P.MAX_LEN + 1))
            assert r.position == (0 if pad else position)
            assert r.label == (-100 if pad or i == P.MAX_LEN - 1 else ids[i + 1])
            assert r.is_continuation == (going_on and resets == 0)
    flat = [r.id for key in sorted(rows) for r in rows[key]]
    turns = {(r.conv_id, r.turn): [int(x) for x in r.ids.split()] for r in Q["encoded_turns"](spark, WHERE).collect()}
    whole = [x for key in sorted(turns) for x in turns[key]]
    assert flat[: len(whole)] == whole and set(flat[len(whole) :]) <= {P.PAD}


def test_most_similar_recall(spark):
    import numpy as np

    v = pd.read_parquet(f"{WHERE}/embeddings.parquet")
    x = np.stack(v.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in Q["most_similar"](spark, WHERE).collect():
        got[r.query_id].add(r.vec_id)
    for i, q in enumerate(v.vec_id):
        if q % 20 == 0:
            c = x @ x[i]
            c[i] = -2
            assert len(got[q] & set(v.vec_id[np.argsort(-c)[:10]])) == 10


def test_splits_are_the_best_of_all():
    freq = {"un": 9, "do": 7, "undo": 6, "ing": 8, "doing": 2, "u": 3, "n": 2, "d": 2, "o": 2, "i": 2, "g": 2, "in": 5}

    def every(word):
        return [[]] if not word else [[word[:j], *rest] for j in range(1, len(word) + 1) if word[:j] in freq for rest in every(word[j:])]

    for word in ("undoing", "undo", "doing", "ungo"):
        paths = [p for p in every(word) if len(p) <= math.ceil(len(word) / 4) + 1]
        if not paths:
            assert splits_of(word, freq) == []
            continue
        best = max(path_score([(x, freq[x]) for x in p]) for p in paths)
        assert splits_of(word, freq)[0][1] == pytest.approx(best) and "".join(splits_of(word, freq)[0][0]) == word
    assert splits_of("xyz", freq) == [] and splits_of("", freq) == []


def test_split_scores_and_known_substrings_of_all_words(spark, words):
    rows = defaultdict(dict)
    for r in Q["split_scores"](spark, WHERE).collect():
        rows[r.lang][r.a, r.b] = r.score
    parts = defaultdict(set)
    for r in Q["known_substrings"](spark, WHERE).collect():
        parts[r.lang].add(r.part)
    assert max(map(len, words.values())) > 2000
    for lang, own in words.items():
        f = affix_counts(own, False)
        for w in own:
            f.update(w[-n:] for n in range(1, min(10, len(w) - 1) + 1))
        valid = lambda n: 2.0 if n >= 5 else 1.0 if n >= 2 else 0.15
        value = lambda p, f=f: math.log(max(f[p], 2)) * len(p) ** 3 * valid(f[p])
        want = {(w[:n], w[n:]): (value(w[:n]) + value(w[n:])) / 2**0.3 * (1.5 if min(f[w[:n]], f[w[n:]]) >= 5 else 1) for w in own for n in range(1, len(w))}
        assert rows[lang] == pytest.approx(want, abs=2e-3)
        assert parts[lang] == {w[i : i + n] for w in own for n in range(2, 6) for i in range(len(w) - n + 1)} & own


def test_short_and_long_words_are_split(spark, tmp_path):
    left, right = "abcdefghijklm", "nopqrstuvwxyz"
    text = " ".join(["cat" * n for n in range(1, 21)] + ["ca", left, right, right * 2, left + right, left + right * 2, left + "cat"])
    pd.DataFrame({"doc_id": [1], "text": [text], "lang": ["eng"], "source": ["s"], "n_chars": [len(text)]}).to_parquet(tmp_path / "documents.parquet")
    (tmp_path / "part.parquet").symlink_to(f"{WHERE}/part.parquet")
    got = {r.word: r.split for r in Q["word_splits"](spark, str(tmp_path)).collect()}
    assert "cat" in got and "ca" in got and got["cat" * 20].replace("-", "") == "cat" * 20
    assert {r.left_part: (r.n_right, r.n_words) for r in Q["compound_parts"](spark, str(tmp_path)).collect()}[left] == (3, 3)


def test_replaced_endings(spark, words):
    def put(word, rules):
        fits = [(c, p) for c, p in rules if word.endswith(c) and len(c) < len(word)]
        cut, new = max(fits, key=lambda x: len(x[0]), default=("", ""))
        return word[: len(word) - len(cut)] + new

    got = {(r.lang, r.word): (r.replaced, r.replaced_unless_empty) for r in Q["replaced_endings"](spark, WHERE).collect()}
    some = [x for x in ENDINGS if x[1]]
    want = {(lang, w): (put(w, ENDINGS), put(w, some)) for lang, own in words.items() for w in own if any(w.endswith(c) and len(c) < len(w) for c, _ in ENDINGS)}
    assert got == want and len(got) > 50


def test_pair_means(spark):
    turns = pd.read_parquet(f"{WHERE}/conversations.parquet").sort_values(["conv_id", "turn"])
    encoded = {(r.conv_id, r.turn): [int(x) for x in r.ids.split()] for r in Q["encoded_turns"](spark, WHERE).collect()}
    mean, updates = defaultdict(float), defaultdict(int)
    for key in zip(turns.conv_id, turns.turn, strict=True):
        row = encoded[key]
        for pair in zip(row, row[1:], strict=False):
            mean[pair] = 0.9 * mean[pair] + 0.1 / math.log(max(2, len(row) + 1))
            updates[pair] += 1
    got = {(r.a, r.b): (r.updates, r.affinity) for r in Q["pair_means"](spark, WHERE).collect()}
    assert got.keys() == mean.keys() and all(n == updates[p] and abs(a - mean[p]) < 2e-6 for p, (n, a) in got.items())
