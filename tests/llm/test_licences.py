import re

import duckdb
import pandas as pd
import pytest

from lexforge.llm import licences as L


def dice(line, template):
    a, b = set(L.bigrams_of(line)), set(L.bigrams_of(template))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def brute(text):
    def hits(unit, cuts):
        best = min(((-dice(unit, t), name) for name, texts in L.TEMPLATES.items() for t in texts), default=(0, ""))
        if -best[0] >= L.THRESHOLD:
            return [best]
        return [h for part in re.split(cuts[0], unit) for h in hits(part, cuts[1:])] if cuts else []

    found = hits(text or "", L.CUTS) if not text or not re.search(L.CUTS[0], text) else [h for p in re.split(L.CUTS[0], text) for h in hits(p, L.CUTS[1:])]
    best = min(found, default=None)
    return len(found), sorted({n for _, n in found}), best and best[1], best and pytest.approx(-best[0])


MIT = """MIT License

Copyright (c) 2020 A B

""" + "\n\n".join(re.sub(r"((?:\S+ ){9})", r"\1\n", t) for t in L.TEMPLATES["MIT"][2:5])
GPL = " * " + re.sub(r"((?:\S+ ){12})", r"\1\n * ", L.TEMPLATES["GPL-3.0"][2])
CASES = [t for texts in L.TEMPLATES.values() for t in texts] + [
    None, "", "\n\n", "licensed under", "LICENSED  under the apache-license, version 2.0!", "Licensed under the Apache License, Version 2.0 today and tomorrow and then",
    "x\nReleased under the MIT License.\nReleased under the MIT License\nLicensed under CC BY-NC 4.0.", "Released under the GNU License.", "word " * 100_000 + "\nReleased under the MIT License.",
    MIT, "x y z\n \n/*\n" + GPL + "\n */\n\ncode", "Some text before it. Released under the MIT License. And a good deal of text after it.", "# SPDX-License-Identifier: GPL-3.0-only\ncode",
    "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "Released under the MIT License.\nReleased under the MIT License.",
]


def test_wrapped_notices_and_bodies_are_found():
    found = lambda text: brute(text)[:2]
    assert found(MIT) == (3, ["MIT"]) and found(CASES[-5]) == (1, ["GPL-3.0"]) and found(CASES[-4]) == (1, ["MIT"]) and found(CASES[-3]) == (1, ["GPL-3.0"]) and found(CASES[-2]) == (1, ["BSD-3-Clause"]) and found(CASES[-1]) == (1, ["MIT"])


def test_like_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CASES)) + [(None, CASES[0]), (0, CASES[0])], "doc_id long, text string").selectExpr("*", "1 AS licence", "2 AS score")
    rows = L.scan(df).collect()
    assert len(rows) == len(CASES) + 2
    for r in rows:
        assert (r.n_notices, r.licences, r.licence, r.score) == brute(CASES[r.doc_id or 0])
    assert L.scan(df.limit(0)).count() == 0


def test_given_table_in_sql(spark):
    path = "/root/testdata/sf0.001"
    got = L.op8_licences(spark, path).toPandas().sort_values("doc_id", ignore_index=True)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = duckdb.sql(L.oracle()).df().sort_values("doc_id", ignore_index=True)[list(got.columns)]
    assert got.n_notices.sum() > 0
    pd.testing.assert_frame_equal(got.astype({"licence": object, "licences": object}), want.astype({"licence": object, "licences": object}), check_dtype=False)
