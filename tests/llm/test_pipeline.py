import pandas as pd

import corpus_pipeline as C
from lexforge.llm import decontamination, near_duplicates, pseudonyms, quality


def test_stages_take_effect(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    given = docs.toPandas().set_index("doc_id")
    model = quality.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    good = {r.doc_id for r in quality.grade(docs, model).collect() if r.keep}
    kept = docs.where(docs.doc_id.isin([int(x) for x in good]))
    single = {r.doc_id for r in near_duplicates.near_duplicates(kept, C.SIMILARITY).collect() if r.kept}
    rest = kept.where(kept.doc_id.isin([int(x) for x in single]))
    bad = {r.doc_id for r in decontamination.contaminated(decontamination.find_passages(rest, spark.read.parquet(f"{path}/benchmark.parquet"))).collect() if r.contaminated}
    assert bad and len(single) < len(good) < len(given)
    left = single - bad
    hidden = {r.doc_id: r.text for r in pseudonyms.pseudonymise(rest).collect()}
    out = C.run(spark, path).toPandas()
    words = hidden.keys() - {d for d, t in hidden.items() if not t.split()}
    assert set(out.doc_id) <= left and (out.taken > 0).all() and out.taken.sum() > 0.9 * sum(len(hidden[d].split()) for d in left & words)
    assert all(hidden[d] == t for d, t in zip(out.doc_id, out.text, strict=True))
    assert list(out.position) == sorted(out.position)


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a b c d e f", "en", "a", 11), (2, "a b c d e f", "en", "a", 11), (3, "word " * 50_000, "en", None, 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, shape)
        for name, stage in C.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "mixture":
                assert docs.columns == C.COLUMNS
        assert (docs.count() > 0) == bool(given)
    pd.testing.assert_index_equal(pd.Index([n for n, _ in C.STAGES]), pd.Index(["quality", "near_duplicates", "decontamination", "pseudonyms", "mixture"]))


def test_texts_of_one_id_are_different_documents(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1] + ["x"])
    other = " ".join(f"z{i}" for i in range(40))
    rows = [(1, " ".join(words), "en", "a", 1), (7, near, "en", "a", 1), (7, other, "en", "a", 1), (7, other, "en", "b", 1), (8, other + " end", "en", "a", 1), (9, "alone", "en", "a", 1), (None, "alone", "en", "a", 1), (10, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS id", "2 AS first", "3 AS kept")
    out = [(r.doc_id, r.text) for r in C.keep_one_copy(spark, docs, "").collect()]
    # Of (7, other) and (8, other + " end") one stays, whichever text of 7 is its first.
    assert len(out) == 5 and {(1, rows[0][1]), (9, "alone"), (None, "alone"), (10, None)} < set(out)
    assert len({(7, other), (8, other + " end")} & set(out)) == 1
    single = docs.where("doc_id <> 8")
    out = {(r.doc_id, r.text) for r in C.keep_one_copy(spark, single, "").collect()}
    assert (7, other) in out and (7, near) not in out and len(out) == 4  # the null id is left out above
