"""The few places where the SQL of the two engines differs: Spark runs a plan, DuckDB checks it."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexforge.sources.workspace import place

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Dialect:
    """With stored, parts of a plan that stand in it more than once are tables of their own: their SQL by name, in order."""

    spark: bool
    stored: dict[str, str] | None = None

    def table(self, name: str, cte: str, sql: str, before: str = "") -> str:
        """The CTE of that SQL, or of the table that it is stored in; before: the CTEs that it needs."""
        if self.stored is None:
            return f"{cte} AS ({sql})"
        self.stored.setdefault(name, f"WITH {before} {sql}" if before else sql)
        return f"{cte} AS (SELECT * FROM {name})"

    def of(self, spark: str, duckdb: str) -> str:
        return spark if self.spark else duckdb

    def re(self, pattern: str) -> str:
        return f"r'{pattern}'" if self.spark else f"'{pattern}'"

    def found(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.re(pattern)}, {group})"

    def each(self, array: str, name: str) -> str:
        """Joins a row with the elements of its array."""
        return f"LATERAL VIEW explode({array}) AS {name}" if self.spark else f"CROSS JOIN LATERAL (SELECT unnest({array}) AS {name})"

    def each_at(self, array: str, place: str, name: str) -> str:
        """As each(), with places from 0."""
        if self.spark:
            return f"LATERAL VIEW posexplode({array}) AS {place}, {name}"
        return f"CROSS JOIN LATERAL (SELECT unnest({array}) AS {name}, unnest(range(len({array}))) AS {place})"

    def count(self, lo: str, hi: str, name: str) -> str:
        """Joins a row with the numbers from lo to hi; with none if hi is smaller."""
        numbers = f"IF({hi} >= {lo}, sequence({lo}, {hi}), array())" if self.spark else f"generate_series({lo}, {hi})"
        return self.each(numbers, name)

    def names(self, value: str) -> str:
        """The distinct values of a group, sorted, joined by commas."""
        return f"array_join(array_sort(collect_set({value})), ',')" if self.spark else f"string_agg(DISTINCT {value}, ',' ORDER BY {value})"

    def total(self, value: str) -> str:
        return f"CAST(sum({value}) AS BIGINT)"

    def rows(self, names: str, *values: tuple) -> str:
        """A table of constants."""
        quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
        return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, v)) + ')' for v in values)}) AS t({names}))"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def item(self, array: str, place: str) -> str:
        """From 1; null beyond the end."""
        return f"try_element_at({array}, {place})" if self.spark else f"list_extract({array}, {place})"

    def chars(self, text: str) -> str:
        return f"filter(split({text}, ''), c -> c <> '')" if self.spark else f"string_split({text}, '')"

    @property
    def words(self) -> str:
        """CTEs: tokens(doc_id, lang, word), corpus(lang, word, freq), words(lang, word)."""
        tokens = f"""tokens AS (SELECT doc_id, lang, word FROM documents {self.each(self.found("lower(text)", r"\p{L}+"), "word")})"""
        corpus = self.table("stored_corpus", "corpus", "SELECT lang, word, count(*) AS freq FROM tokens GROUP BY lang, word", tokens)
        return f"{tokens}, {corpus}, words AS (SELECT lang, word FROM corpus)"


SPARK, DUCKDB = Dialect(True), Dialect(False)


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    plan: Callable[[Dialect], str] | None
    build: Callable[[SparkSession, str], DataFrame] | None
    check: str | None
    stored: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.build:
            return self.build(spark, sf_dir)
        d = Dialect(True, {}) if self.stored else SPARK
        text = self.plan(d)
        for table in TABLES:
            if table in text or table in str(d.stored):
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        for name, sql in (d.stored or {}).items():
            path, part = f"{place(spark, name)}/t", spark.sql(sql)
            part.write.parquet(path)
            spark.read.schema(part.schema).parquet(path).createOrReplaceTempView(name)
        return spark.sql(text)

    @property
    def oracle(self) -> str | None:
        return self.check or (self.plan(DUCKDB) if self.plan else None)


CATALOGUE: dict[str, Query] = {}


def plan(covers: str, stored: bool = False) -> Callable:
    """Registers a plan under its function's name; covers: the operators of the survey; stored: whether Spark works out the
    parts that it needs more than once only once, in tables of the shared folder."""

    def register(f: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        CATALOGUE[f.__name__] = Query(f.__name__, covers, f, None, None, stored)
        return f

    return register


def built(covers: str, check: str | None = None) -> Callable:
    """Registers a DataFrame function (spark, sf_dir), with the SQL that checks it, if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CATALOGUE[f.__name__] = Query(f.__name__, covers, None, f, check)
        return f

    return register
