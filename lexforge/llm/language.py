"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

Each language's raw-content zstandard dictionary is a sample of its labelled texts: SAMPLE_DOCS documents at most, in the
order of a hash, SNIPPET characters at most of each, from a place that the hash sets; this bounds what is gathered
and sent to executors. A text is lower-cased, its characters other than letters become spaces, and all of it is encoded
in pieces of PIECE bytes, so that a long text doesn't become its own dictionary; sizes are added up.

Score: 1 minus the smallest size over the second smallest. Where it is under the margin, the decision is marked rejected.

Defined results: und, score 0 and rejected for a null text, one without letters, or where nothing could be learned;
a null doc_id is neither learned from nor held out; with one learned language, its score is 1; ties go to the language
that sorts first; further columns are ignored.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS, SNIPPET, PIECE, LEVEL, MARGIN = 80, 500, 4096, 5, 0.01
UNDETERMINED = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters(text: str) -> bytes:
    """Lower case, with a space for every other ASCII character than a letter."""
    keep = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
    return text.lower().encode(errors="replace").translate(keep)


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, snippet: int = SNIPPET) -> dict[str, bytes]:
    """Dictionary text of each language from (doc_id, text, lang)."""
    h = F.xxhash64("doc_id", F.lit("language"))
    rows = labelled.where("doc_id is not null and lang is not null and text is not null").select("lang", "text", h.alias("h"), "doc_id")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))).where(F.col("n") <= sample_docs)
    at = 1 + F.pmod("h", F.greatest(F.lit(1), F.length("text") - snippet))
    found: dict[str, list[str]] = {}
    for lang, text in best.select("lang", F.substring("text", at.cast("int"), F.lit(snippet)), "n").sort("lang", "n").drop("n").collect():
        found.setdefault(lang, []).append(text)
    return {lang: b" ".join(map(letters, texts)) for lang, texts in sorted(found.items())}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, piece: int = PIECE) -> DataFrame:
    """RESULT, a row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(sent.value)
        coders = []
        for content in sent.value.values():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False))
        letter = re.compile(r"[^\W\d_]")
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                if not names or text is None or not letter.search(text):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                raw = letters(text)
                pieces = [raw[i : i + piece] for i in range(0, len(raw), piece)]
                sizes = [sum(len(c.compress(x)) for x in pieces) for c in coders]
                least = min(sizes)
                best = sizes.index(least)
                others = sizes[:best] + sizes[best + 1 :]
                langs.append(names[best])
                scores.append(1 - least / min(others) if others else 1.0)
            rejected = pa.array([s < margin for s in scores])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), rejected], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out")).mapInArrow(run, RESULT)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs.where(~held_out()).select("doc_id", "text", "lang")))
