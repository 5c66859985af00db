import bz2

import pytest

from lexforge.sources import files as S
from lexforge.sources import tables as T


def rows(df, *order):
    return [tuple(r) for r in df.sort(*order).collect()]


def test_parquet_parts(spark, tmp_path):
    assert S.parquet_parts(spark, f"{tmp_path}/x") is None
    spark.range(3).write.parquet(f"{tmp_path}/x_part0.parquet")
    spark.range(3, 5).write.parquet(f"{tmp_path}/x_part1.parquet")
    assert rows(S.parquet_parts(spark, f"{tmp_path}/x"), "id") == [(i,) for i in range(5)]
    S.save_parts(spark.sql("SELECT id, array(array(id), array(1)) AS a FROM range(10)"), f"{tmp_path}/y", megabytes=1, row_bytes=2**18)
    assert spark.read.parquet(f"{tmp_path}/y").count() == 10 and spark.read.parquet(f"{tmp_path}/y").dtypes[1] == ("a", "array<bigint>")
    assert S.build_if_missing(spark, f"{tmp_path}/z", lambda: spark.range(2)).count() == 2
    assert S.build_if_missing(spark, f"{tmp_path}/z", lambda: 1 / 0).count() == 2


def test_tab_separated(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('code\tname\na\t"x y"\n\nb\ttoo\tmany\nc\tz\n')
    assert rows(S.tab_separated(spark, str(tmp_path / "t.tsv"), ["code", "name"], {"name": "title"}), "code") == [("a", '"x y"'), ("c", "z")]


def test_json(spark, tmp_path):
    assert S.json_document(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "f.json").write_text('{"the": 5, "of": 3}')
    words = S.frequencies(spark, str(tmp_path / "f.json"))
    assert rows(words, "word") == [("of", 3), ("the", 5)]
    S.save_frequencies(words, f"{tmp_path}/g")
    assert rows(S.frequencies(spark, f"{tmp_path}/g"), "word") == rows(words, "word")
    (tmp_path / "m.json").write_text('{"prefixes": ["re", "un"], "suffixes": ["ed"]}')
    m = S.morphemes(spark, str(tmp_path / "m.json"))
    S.save_morphemes(m, f"{tmp_path}/n")
    assert rows(S.morphemes(spark, f"{tmp_path}/n"), "kind", "morpheme") == rows(m, "kind", "morpheme") == [("prefixes", "re"), ("prefixes", "un"), ("suffixes", "ed")]


def test_xml_dump(spark, tmp_path):
    page = "<page><title>T{0}</title><revision><comment>c</comment><text>==English==\n===Noun===\n* one {0}\n# two\n==French==\n* trois</text></revision></page>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(("<w>" + "\n".join(page.format(i) for i in range(3)) + "</w>").encode()))
    pages = S.xml_pages(spark, str(tmp_path / "d.xml.bz2"))
    assert sorted(pages.first().languages) == ["English", "French"] and pages.count() == 3
    items = rows(S.sections(pages).where("title = 'T1'").select("title", "language", "section", "item"), "language", "item")
    assert items == [("T1", "English", "noun", "one 1"), ("T1", "English", "noun", "two"), ("T1", "French", "", "trois")]


def test_lexical_sections(spark):
    lines = ["{{also|x}}", "==English==", "===Etymology 1===", "* {{l|en|old}}", "====Noun====", "# {{lb|en|a}} a thing", "====Pronunciation====", "* /x/", "====Translations====", "{{trans-top|thing}}", "* French: {{t+|fr|chose|f}}", "*: Old French: {{t|fro|cose}}", "* none", "===Etymology 2===", "====Verb====", "# to do", "==German==", "===Nomen===", "* Ding"]
    df = spark.createDataFrame([("T", lines), ("U", ["==X==", "* y"] + ["z"] * 120)], "title string, lines array<string>")
    found = [tuple(r)[1:] for r in S.sections(df).collect()]
    assert sorted(found) == sorted([
        ("English", "en", "Etymology 1", "", "", "{{l|en|old}}"), ("English", "en", "Etymology 1", "noun", "", "{{lb|en|a}} a thing"), ("English", "en", "Etymology 1", "translations", "thing", "French (fr): chose"),
        ("English", "en", "Etymology 1", "translations", "thing", "Old French (fro): cose"), ("English", "en", "Etymology 2", "verb", "", "to do"), ("German", "", "Etymology", "nomen", "", "Ding"),
    ])


def test_csv_export(spark, tmp_path):
    S.export_csv(spark.createDataFrame([("a", 5, 0.5), ("b", 9, 0.125), ("c", 1, 0.9)], "root string, freq long, share double"), f"{tmp_path}/c", "share", 0.2)
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()] == [("a", "5", "50.0%"), ("c", "1", "90.0%")]


def test_upserts(spark, tmp_path):
    table = T.VersionedTable(spark, f"{tmp_path}/t", "k long, v string, w long")
    assert table.first("k = 1") is None
    table.upsert(spark.createDataFrame([(1, "a", 1), (None, "n", 0)], "k long, v string, w long"), ["k"])
    table.upsert(spark.createDataFrame([(1, "b"), (2, "c"), (None, None)], "k long, v string"), ["k"])
    assert rows(table.read(), "k") == [(None, None, 0), (1, "b", 1), (2, "c", None)]
    table.delete("k = 1")
    assert table.first("k = 1") is None and table.read().count() == 2
    both = T.merged_arrays(spark.sql("SELECT 1 AS k, array('a', 'b') AS v"), spark.sql("SELECT 1 AS k, array('b', 'c') AS v"), "k", "v")
    assert both.first().v == ["a", "b", "c"]


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 4)
    table = T.segment_rows(spark, "0", [float(i) for i in range(10)], [2, 5]).unionByName(T.segment_rows(spark, "1", [1.0], [1]))
    assert T.segment(table, "0") == ([float(i) for i in range(10)], [2, 5]) and T.segment(table, "1") == ([1.0], [1])
    with pytest.raises(ValueError, match="no segment"):
        T.segment(table, "9")
