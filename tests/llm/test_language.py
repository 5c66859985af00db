import zlib

import pandas as pd
import zstandard

from lexforge.llm import language as L


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    want = pd.read_parquet(f"{path}/documents.parquet").set_index("doc_id").lang
    out = L.op7_language(spark, path).collect()
    assert len(out) == len(want) and {r.lang_pred for r in out} <= set(want) | {"und"} and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    print("accuracy", sum(r.lang_pred == want[r.doc_id] for r in held) / len(held), sum(r.rejected for r in held))
    assert sum(r.lang_pred == want[r.doc_id] for r in held) > 0.97 * len(held)


def test_prediction_sees_only_text(spark):
    learned = {"a": b"the thing of the other thing " * 50, "b": b"der die das und nicht ein eine " * 50}
    rows = [(1, "the thing", "b", 1), (None, "DER, DIE; DAS UND nicht ein eine der die", "a", 2), (3, None, "a", 3), (4, " 12 !", "b", 4), (5, "", None, 5), (6, "die " * 100_000, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    assert [r.lang_pred for r in L.identify(df, learned).collect()] == ["a", "b", "und", "und", "und", "b"]
    assert {(r.lang_pred, r.score) for r in L.identify(df, {}).collect()} == {("und", 0.0)}
    assert L.identify(df.limit(0), learned).count() == 0 and L.learn(df.limit(0)) == {}


def test_like_brute_force(spark):
    """Sizes told again: a new encoder for every piece, and the language of the smallest sum."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    learned = L.learn(docs.where(~L.held_out()).select("doc_id", "text", "lang"))
    assert sorted(learned) == list(learned) and all(0 < len(x) <= L.SAMPLE_DOCS * (4 * L.SNIPPET + 1) for x in learned.values())
    texts = pd.read_parquet(f"{path}/documents.parquet").set_index("doc_id").text

    def size(raw, content):
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=L.LEVEL)
        return sum(len(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[i : i + L.PIECE])) for i in range(0, len(raw), L.PIECE))

    rows = L.identify(docs.where("doc_id % 5 = 0"), learned).collect()
    for r in rows:
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        raw = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower()).encode()
        ranked = sorted((size(raw, content), lang) for lang, content in learned.items())
        assert r.lang_pred == ranked[0][1] and r.score == 1 - ranked[0][0] / ranked[1][0] and r.rejected == (r.score < L.MARGIN)
    assert len(rows) > 30


def test_ties_go_to_the_first_language(spark):
    same = b"the thing of the other thing " * 50
    df = spark.createDataFrame([(1, "the thing")], "doc_id long, text string")
    assert [(r.lang_pred, r.score, r.rejected) for r in L.identify(df, {"a": same, "b": same, "c": b"der die das " * 90}).collect()] == [("a", 0.0, True)]
