"""Further selections over affixes, roots, titles and events."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.affixes import VOWELS, affixes, edges, kept
from lexforge.operators.roots import v
from lexforge.plans.dialect import SPARK, Dialect, built, plan


@plan("F09")
def chameleon_affixes(d: Dialect) -> str:
    """Vowel and consonant (prefix) or consonant and vowel (suffix) whose consonant is often doubled: over 30 %, or over 10 % with
    an entropy of continuations under 2 bits."""
    like = d.of("regexp_like", "regexp_matches")
    return f"""WITH {d.words}, {affixes(d)}, {edges(d)}, two AS (SELECT *, CASE WHEN side = 'prefix' THEN affix || right(affix, 1) ELSE left(affix, 1) || affix END AS doubled FROM affixes
  WHERE length(affix) = 2 AND {like}(affix, CASE WHEN side = 'prefix' THEN '^[{VOWELS}][^{VOWELS}]$' ELSE '^[^{VOWELS}][{VOWELS}]$' END)),
shares AS (SELECT lang, side, parent, CAST(freq AS DOUBLE) / sum(freq) OVER (PARTITION BY lang, side, parent) AS p FROM edges),
entropies AS (SELECT lang, side, parent, -sum(p * log2(p)) AS h FROM shares GROUP BY lang, side, parent)
SELECT t.lang, t.side, t.affix, round(coalesce(x.freq, 0) / CAST(t.freq AS DOUBLE), 6) AS doubled_share FROM two t LEFT JOIN affixes x ON t.lang = x.lang AND t.side = x.side AND t.doubled = x.affix
LEFT JOIN entropies e ON t.lang = e.lang AND t.side = e.side AND t.affix = e.parent WHERE coalesce(x.freq, 0) > 0.30 * t.freq OR (coalesce(e.h, 0) < 2.0 AND coalesce(x.freq, 0) > 0.10 * t.freq)"""


@plan("F16")
def duplicate_affixes(d: Dialect) -> str:
    """Kept affixes with under half the frequency of the kept affix that they extend by one letter."""
    return f"""WITH {d.words}, {kept(d)} SELECT a.lang, a.side, a.affix, a.freq, b.freq AS shorter_freq FROM kept a JOIN kept b ON a.lang = b.lang AND a.side = b.side AND b.affix = CASE WHEN a.side = 'prefix' THEN left(a.affix, length(a.affix) - 1) ELSE right(a.affix, length(a.affix) - 1) END WHERE a.freq < 0.5 * b.freq"""


@plan("F01")
def page_titles(d: Dialect) -> str:
    """Titles, without those that start with a given name."""
    title = f"regexp_extract(html, {d.re('<title>([^<]*)</title>')}, 1)"
    return f"SELECT page_id, {title} AS title FROM pages WHERE {title} NOT LIKE 'The %' AND {title} <> ''"


@plan("A19k")
def merged_roots(d: Dialect) -> str:
    """Roots found before a linking vowel and roots found as words: of both the first kind counts, with the larger frequency."""
    return f"""WITH {d.words}, cuts AS (SELECT lang, left(word, n) AS root, substr(word, n + 1, 1) AS link, right(word, length(word) - n - 1) AS rest FROM words {d.count('3', 'length(word) - 4', 'n')}),
linked AS (SELECT c.lang, c.root, count(*) AS freq FROM cuts c {d.of('LEFT SEMI JOIN', 'SEMI JOIN')} words w ON c.lang = w.lang AND c.rest = w.word WHERE {v('c.link')} GROUP BY c.lang, c.root HAVING count(*) >= 3),
free AS (SELECT c.lang, c.root, count(*) AS freq FROM cuts c {d.of('LEFT SEMI JOIN', 'SEMI JOIN')} words w ON c.lang = w.lang AND c.root = w.word GROUP BY c.lang, c.root HAVING count(*) >= 3)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.root, b.root) AS root, greatest(coalesce(a.freq, 0), coalesce(b.freq, 0)) AS freq, CASE WHEN a.root IS NOT NULL THEN 'linked' ELSE 'free' END AS kind FROM linked a FULL OUTER JOIN free b ON a.lang = b.lang AND a.root = b.root"""


@plan("")
def routed_events(d: Dialect) -> str:
    """Events by the first route whose condition they meet."""
    return "SELECT CASE WHEN value > 100 THEN 'large' WHEN event_type LIKE 'p%' THEN 'p' WHEN user_id % 2 = 0 THEN 'even' ELSE 'rest' END AS route, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"


@plan("K16")
def frequent_pairs(d: Dialect) -> str:
    """Words that are a word and a kept suffix, or a kept prefix and a word, both in at least four words."""
    return f"""WITH {d.words}, {kept(d)}, cuts AS (SELECT lang, word, left(word, n) AS a, right(word, length(word) - n) AS b FROM words {d.count('2', 'length(word) - 2', 'n')}),
pairs AS (SELECT c.lang, c.word FROM cuts c JOIN words w ON c.lang = w.lang AND c.a = w.word JOIN kept k ON k.side = 'suffix' AND c.lang = k.lang AND c.b = k.affix WHERE k.freq >= 4
  UNION ALL SELECT c.lang, c.word FROM cuts c JOIN words w ON c.lang = w.lang AND c.b = w.word JOIN kept k ON k.side = 'prefix' AND c.lang = k.lang AND c.a = k.affix WHERE k.freq >= 4)
SELECT lang, word, count(*) AS n_cuts FROM pairs GROUP BY lang, word"""


def cover(word: str, forms: set[str]) -> list[str]:
    """From the left, the longest known form at each place; letters that start none are passed over."""
    out, i = [], 0
    while i < len(word):
        found = next((word[i:j] for j in range(len(word), i + 2, -1) if word[i:j] in forms), None)
        if found:
            out.append(found)
        i += len(found) if found else 1
    return out


@built("A19j")
def covering_forms(spark, sf_dir: str) -> DataFrame:
    """How many words each kept affix of three letters or more covers, in words that two forms or more cover."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    d = SPARK
    forms = spark.sql(f"WITH {d.words}, {kept(d)} SELECT DISTINCT lang, affix AS form FROM kept WHERE length(affix) >= 3")
    words = spark.sql(f"WITH {d.words} SELECT lang, word FROM words")
    cuts = words.select("lang", "word", F.explode(F.when(F.length("word") >= 3, F.sequence(F.lit(1), F.length("word") - 2))).alias("i")).select("lang", "word", "i", F.explode(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.lit(10), F.length("word") - F.col("i") + 1)))).alias("n"))
    own = cuts.select("lang", "word", F.substr("word", F.col("i"), F.col("n")).alias("form")).distinct().join(forms, ["lang", "form"]).groupBy("lang", "word").agg(F.collect_set("form").alias("forms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(lang, f) for lang, word, known in zip(pdf.lang, pdf.word, pdf.forms, strict=True) if len(c := cover(word, set(known))) >= 2 for f in set(c)]
            yield pd.DataFrame(found, columns=["lang", "form"])

    return own.mapInPandas(run, "lang string, form string").groupBy("lang", "form").agg(F.count("*").alias("n"))
