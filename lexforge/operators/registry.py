"""Lookups, upserts and reports over small dimensions: languages, families, scripts, skills."""

from pyspark.sql import DataFrame

from lexforge.plans.dialect import Dialect, plan

#: The languages of the documents by ISO 639-1, -2B, -2T and -3 code, name, family and speakers in millions.
LANGUAGES = (
    ("en", "eng", "eng", "eng", "English", "Germanic", 1500),
    ("de", "ger", "deu", "deu", "German", "Germanic", 130),
    ("nl", "dut", "nld", "nld", "Dutch", "Germanic", 25),
    ("fr", "fre", "fra", "fra", "French", "Romance", 310),
    ("es", "spa", "spa", "spa", "Spanish", "Romance", 600),
    ("it", "ita", "ita", "ita", "Italian", "Romance", 68),
)
#: Skills: id, name, class, languages (null: all), confidence.
SKILLS = (
    ("s1", "summarise", "generative", None, 0.9),
    ("s2", "classify", "discriminative", "en,de", 0.7),
    ("s3", "translate", "seq2seq", "en,fr,es", 0.8),
    ("s4", "tag", "token_level", "de", 0.6),
    ("s5", "complete", "generative", "fr", 0.5),
)
CLASSES = ("generative", "reverse_generative", "discriminative", "token_level", "seq2seq")
#: Scripts: name, first and last code point, linking and all vowels.
SCRIPTS = (("Latin", 65, 591, "aeiou", "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿ"), ("Greek", 880, 1023, "ιο", "αεηιουω"), ("Cyrillic", 1024, 1279, "ео", "аеиоуыэюя"))


#: Views that take the place of the constants in Spark's plans.
GIVEN: dict[str, str] = {}


def use_dimensions(**frames: DataFrame) -> None:
    """Dimensions to be read by the queries from now on: languages, skills or scripts, with the columns of the constants;
    without any, the constants count again."""
    GIVEN.clear()
    for name, df in frames.items():
        df.createOrReplaceTempView(f"given_{name}")
        GIVEN[name] = f"given_{name}"


def languages(d: Dialect) -> str:
    if d.spark and "languages" in GIVEN:
        return GIVEN["languages"]
    return d.rows("part1, part2b, part2t, part3, name, family, population", *LANGUAGES)


def skills(d: Dialect) -> str:
    if d.spark and "skills" in GIVEN:
        return GIVEN["skills"]
    return d.rows("skill_id, name, task_class, languages, confidence", *SKILLS)


def scripts(d: Dialect) -> str:
    if d.spark and "scripts" in GIVEN:
        return GIVEN["scripts"]
    return d.rows("script, first, last, linkers, vowels", *SCRIPTS)


@plan("F26 F27 F28 F29 F30 F31 F33 F35 A31")
def document_languages(d: Dialect) -> str:
    """Names, codes and family of the documents' languages; unknown codes have the name '' and the default family."""
    return f"SELECT d.lang, count(*) AS n, coalesce(l.name, '') AS name, coalesce(l.part3, '') AS part3, coalesce(l.family, 'Germanic') AS family FROM documents d LEFT JOIN {languages(d)} l ON lower(d.lang) = l.part1 GROUP BY d.lang, l.name, l.part3, l.family"


@plan("F32 F34 F36 F37 F38 A32 O02")
def family_languages(d: Dialect) -> str:
    """The languages of a family, the most spoken first."""
    return f"SELECT family, part3, name, population, row_number() OVER (PARTITION BY family ORDER BY population DESC, part3) AS place FROM {languages(d)} l"


@plan("J18 J19 F02")
def language_ancestors(d: Dialect) -> str:
    """Several matches of a code's first letter: the most spoken of the family that most of them have."""
    return f"""WITH m AS (SELECT substr(d.lang, 1, 1) AS key, l.part3, l.family, l.population, count(*) OVER (PARTITION BY substr(d.lang, 1, 1), l.family) AS n FROM (SELECT DISTINCT lang FROM documents) d JOIN {languages(d)} l ON substr(d.lang, 1, 1) = substr(l.part1, 1, 1))
SELECT key, part3, family FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, population DESC, part3) AS place FROM m) x WHERE place = 1"""


@plan("F20 F21 F22 F23 J20 C09 C10 C11")
def skills_for_documents(d: Dialect) -> str:
    """Skills that serve each language, by the language itself, all languages, or its family."""
    has = d.of("array_contains(split(s.languages, ','), l.part1)", "list_contains(string_split(s.languages, ','), l.part1)")
    return f"""WITH direct AS (SELECT l.part1, l.family, s.skill_id, s.task_class FROM {languages(d)} l JOIN {skills(d)} s ON s.languages IS NULL OR {has})
SELECT x.lang, x.n, count(DISTINCT a.skill_id) AS n_skills, count(DISTINCT CASE WHEN a.task_class = 'generative' THEN a.skill_id END) AS n_generative, count(DISTINCT f.skill_id) AS n_family_skills
FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) x JOIN {languages(d)} l ON x.lang = l.part1 LEFT JOIN direct a ON a.part1 = l.part1 LEFT JOIN direct f ON f.family = l.family GROUP BY x.lang, x.n"""


@plan("A26 A28")
def skill_report(d: Dialect) -> str:
    """Skills of every class, also of those that have none."""
    return f"SELECT c.task_class, count(s.skill_id) AS n, round(coalesce(avg(CAST(s.confidence AS DOUBLE)), 0), 6) AS mean_confidence FROM {d.rows('task_class', *((c,) for c in CLASSES))} c LEFT JOIN {skills(d)} s ON s.task_class = c.task_class GROUP BY c.task_class"


@plan("F24 F25 N34 A18")
def script_letters(d: Dialect) -> str:
    """Letters of the corpus by the script of their code points, with the script's linking vowels; Latin where none fits."""
    point = d.of("ascii(letter)", "unicode(letter)")
    return f"""WITH {d.words}, letters AS (SELECT letter, {d.total('freq')} AS freq FROM (SELECT freq, letter FROM corpus {d.each(d.chars('word'), 'letter')}) x GROUP BY letter)
SELECT coalesce(s.script, 'Latin') AS script, coalesce(s.linkers, 'aeiou') AS linkers, count(*) AS n_letters, {d.total('freq')} AS freq, count(CASE WHEN {d.of('instr(coalesce(s.vowels, ' + repr('aeiou') + '), letter)', 'instr(coalesce(s.vowels, ' + repr('aeiou') + '), letter)')} > 0 THEN 1 END) AS n_vowels
FROM letters l LEFT JOIN {scripts(d)} s ON {point} BETWEEN s.first AND s.last GROUP BY 1, 2"""


@plan("S10 U06")
def upserted_customers(d: Dialect) -> str:
    """A keyed upsert: balances of customers are raised by their orders' total, customers that only the orders have are new."""
    return """WITH new AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey)
SELECT coalesce(c.c_custkey, n.k) AS custkey, coalesce(n.n, 0) AS n_orders, round(coalesce(c.c_acctbal, 0) + coalesce(n.total, 0), 2) AS balance FROM customer c FULL OUTER JOIN new n ON c.c_custkey = n.k"""


@plan("U01 U03")
def morpheme_classes(d: Dialect) -> str:
    """Distinct union of beginnings and endings of three letters, less those that are words."""
    return f"""WITH {d.words}, x AS (SELECT lang, left(word, 3) AS part FROM words WHERE length(word) > 3 UNION SELECT lang, right(word, 3) FROM words WHERE length(word) > 3) SELECT lang, part FROM x EXCEPT SELECT lang, word FROM words"""
