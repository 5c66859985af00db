"""Scalar functions over texts, markup and addresses."""

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexforge.plans.dialect import Dialect, built, plan

#: Characters that carry no text.
INVISIBLE = "​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿︎️"
PIECES = r"\s{2,}|\p{L}+|\s|[^\p{L}\s]"


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC; null becomes ''."""
    import unicodedata

    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else "")


def normalised(text: Column) -> Column:
    """Compatibility form, control characters but TAB as spaces, invisible ones gone, TAB as four spaces."""
    spaced = F.regexp_replace(compatible(text), r"[\x00-\x08\x0A-\x1F\x7F-\x9F  ]", " ")
    return F.replace(F.translate(spaced, INVISIBLE, ""), F.lit("\t"), F.lit("    "))


@built("N01")
def normalised_texts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", normalised("text").alias("text")).select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha256"))


@plan("N02 K01")
def pretokenised(d: Dialect) -> str:
    return f"SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN length(piece) > 1 AND trim(replace(replace(replace(piece, chr(10), ' '), chr(9), ' '), chr(13), ' ')) = '' THEN 'spaces' WHEN {d.of('regexp_like', 'regexp_matches')}(piece, {d.re('^\\p{L}')}) THEN 'word' WHEN trim(replace(piece, chr(10), ' ')) = '' THEN 'space' ELSE 'mark' END AS kind FROM documents {d.each(d.found('text', PIECES), 'piece')}) x GROUP BY doc_id, kind"


@plan("N03")
def camel_case_parts(d: Dialect) -> str:
    """Names written together, with capitals at their starts or a run of capitals first, in their parts: capitals before small letters
    belong to the part that is a known word with them or without."""
    made = f"""said AS (SELECT lang, word, place, doc_id FROM (SELECT doc_id, lang, place, word FROM documents {d.each_at(d.found("lower(text)", r"\p{L}+"), "place", "word")}) x WHERE length(word) > 1 AND instr(word, 'ß') = 0),
joined AS (SELECT DISTINCT a.lang, upper(left(a.word, 1)) || substr(a.word, 2) || upper(left(b.word, 2)) || substr(b.word, 3) AS name FROM said a JOIN said b ON a.doc_id = b.doc_id AND a.place + 1 = b.place WHERE a.place % 7 = 0)"""
    shape = r"'^(\p{Lu}+)(\p{Ll}+)$'"
    part = lambda p, g: f"regexp_extract({p}, {d.re(shape[1:-1])}, {g})"
    return f"""WITH {d.words}, {made}, parts AS (SELECT lang, name, part, place FROM joined {d.each_at(d.found('name', r'\p{Lu}+\p{Ll}*|\p{Ll}+'), 'place', 'part')}),
shaped AS (SELECT *, {part('part', 1)} AS caps, {part('part', 2)} AS tail FROM parts),
settled AS (SELECT s.lang, s.name, s.place, CASE WHEN length(s.caps) < 2 THEN s.part WHEN t.word IS NOT NULL THEN s.caps || ' ' || s.tail WHEN u.word IS NOT NULL THEN left(s.caps, length(s.caps) - 1) || ' ' || right(s.caps, 1) || s.tail ELSE s.part END AS told
  FROM shaped s LEFT JOIN words t ON s.lang = t.lang AND s.tail = t.word LEFT JOIN words u ON s.lang = u.lang AND lower(right(s.caps, 1)) || s.tail = u.word)
SELECT lang, name, {d.of("array_join(transform(array_sort(collect_list(struct(place, told))), x -> x.told), ' ')", "string_agg(told, ' ' ORDER BY place)")} AS parts FROM settled GROUP BY lang, name"""


@plan("N06 N07")
def address_parts(d: Dialect) -> str:
    """Scheme and host, and the last path part's name and extension."""
    f = lambda p, g: f"regexp_extract(url, {d.re(p)}, {g})"
    return f"SELECT page_id, {f('^[a-z]+://[^/?#]+', 0)} AS root, {f(r'^[a-z]+://[^/?#]+/(?:[^?#]*/)?([^/?#.]*)', 1)} AS name, {f(r'^[a-z]+://[^/?#]+/[^?#]*[.]([A-Za-z0-9]+)(?:[?#]|$)', 1)} AS extension FROM pages"


@plan("N08 N10")
def page_links(d: Dialect) -> str:
    """Links with a text, in page order, by their start of address."""
    return f"SELECT page_id, place, href FROM (SELECT page_id, place, href FROM pages {d.each_at(d.found('html', '<a href=\"([^\"]*)\"[^>]*>[^<]*[^<\\s][^<]*</a>', 1), 'place', 'href')}) x WHERE href LIKE '/%'".replace("place, href FROM (", "CAST(place AS BIGINT) AS place, href FROM (", 1)


@plan("N11")
def page_tags(d: Dialect) -> str:
    return f"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, lower(tag) AS tag FROM pages {d.each(d.found('html', '<([A-Za-z][A-Za-z0-9]*)', 1), 'tag')}) x GROUP BY tag"


class Links(HTMLParser):
    """Texts and the address of the nearest link around each."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str | None]] = []
        self.open: list[str | None] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.open.append(dict(attrs).get("href"))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.found.append((" ".join(data.split()), self.open[-1] if self.open else None))


@built("N08 N09 X7")
def page_texts_and_links(spark, sf_dir: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf.page_id, pdf.html, strict=True):
                parser = Links()
                parser.feed(html or "")
                rows += [(page, i, text, href) for i, (text, href) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "text", "href"])

    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").mapInPandas(parse, "page_id long, place long, text string, href string")


@plan("N12")
def page_comments(d: Dialect) -> str:
    return f"SELECT page_id, comment FROM pages {d.each(d.found('html', '<!--[^>]*-->'), 'comment')}"


@plan("N15 N16")
def text_hashes(d: Dialect) -> str:
    sha = lambda x: d.of(f"sha2({x}, 256)", f"sha256({x})")
    return f"SELECT doc_id, {sha('text')} AS sha256, {sha('concat(text, lang)')} AS keyed FROM documents"


@plan("N35 N36")
def megabytes(d: Dialect) -> str:
    return f"SELECT lang, CAST(floor(sum({d.of('octet_length(text)', 'strlen(text)')}) / 1048576.0) AS BIGINT) AS megabytes FROM documents GROUP BY lang"


@plan("N37")
def few_shot_prompts(d: Dialect) -> str:
    """A user's turn after the turn and answer before it."""
    return "SELECT c.conv_id, c.turn, 'Q: ' || a.text || chr(10) || 'A: ' || b.text || chr(10) || 'Q: ' || c.text || chr(10) || 'A:' AS prompt FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 2 JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 WHERE c.role = 'user'"


@plan("N18")
def split_scores(d: Dialect) -> str:
    """Two-part splits of every word: sum of ln(max(f, 2)) * length ** 3 * validity over parts ** 0.3, raised where both
    are valid; f: how many words begin or end with the part, which counts as an affix up to ten letters."""
    return f"""WITH {d.words}, ends AS (SELECT lang, part, count(*) AS f FROM (SELECT lang, left(word, n) AS part FROM words {d.count('1', 'least(length(word), 10)', 'n')} UNION ALL SELECT lang, right(word, n) FROM words {d.count('1', 'least(length(word) - 1, 10)', 'n')}) x GROUP BY lang, part),
cuts AS (SELECT lang, word, left(word, n) AS a, right(word, length(word) - n) AS b FROM words {d.count('1', 'length(word) - 1', 'n')}),
scores AS (SELECT c.lang, c.word, c.a, c.b, coalesce(x.f, 0) AS fa, coalesce(y.f, 0) AS fb FROM cuts c LEFT JOIN ends x ON c.lang = x.lang AND c.a = x.part LEFT JOIN ends y ON c.lang = y.lang AND c.b = y.part)
SELECT lang, word, a, b, round((ln(greatest(fa, 2)) * power(length(a), 3) * CASE WHEN fa >= 5 THEN 2.0 WHEN fa >= 2 THEN 1.0 ELSE 0.15 END + ln(greatest(fb, 2)) * power(length(b), 3) * CASE WHEN fb >= 5 THEN 2.0 WHEN fb >= 2 THEN 1.0 ELSE 0.15 END) / power(2, 0.3) * CASE WHEN fa >= 5 AND fb >= 5 THEN 1.5 ELSE 1.0 END, 3) AS score FROM scores"""


@plan("F05 F03 F18 F19")
def text_predicates(d: Dialect) -> str:
    like = d.of("regexp_like", "regexp_matches")
    return f"SELECT doc_id, {like}(text, {d.re('[\\p{L}\\p{M}\\p{N}\\s\\p{P}]')}) AS has_text, {like}(text, {d.re('^\\p{Ll}')}) AS lower_first, {like}(lang, '^[a-z]{{3}}$') AS is_639_3, {like}(source, '^[a-z]+[0-9]+$') AS plain_source FROM documents"


@plan("J17 A37 A38")
def tags_of_texts(d: Dialect) -> str:
    """A tag for a text that holds one of its keywords as a word: an equi-join on words instead of a test of every pair."""
    tags = d.rows("tag, keyword", ("article", "the"), ("article", "der"), ("article", "la"), ("insult", "idiot"), ("insult", "moron"), ("licence", "license"), ("licence", "licensed"), ("media", "mail"))
    return f"WITH {d.words} SELECT DISTINCT t.doc_id, g.tag FROM tokens t JOIN {tags} g ON t.word = g.keyword"


@plan("J22 J23 J24")
def known_substrings(d: Dialect) -> str:
    """Substrings of 2 to 5 letters of all words that are themselves words."""
    return f"""WITH {d.words}
SELECT DISTINCT c.lang, c.part FROM (SELECT lang, substr(word, i, n) AS part FROM words {d.count('2', 'least(5, length(word))', 'n')} {d.count('1', 'length(word) - n + 1', 'i')}) c JOIN words w ON c.lang = w.lang AND c.part = w.word"""
