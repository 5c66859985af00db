"""Holds queries against their SQL: columns by name, rows as multisets, floats to six digits."""

import datetime
import math
import sys

import duckdb

from lexforge.plans.dialect import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    want = rows([c[0] for c in out.description], out.fetchall())
    if got != want:
        extra, missing = sorted(set(got[1]) - set(want[1]))[:2], sorted(set(want[1]) - set(got[1]))[:2]
        return f"columns {got[0]} {want[0]}; rows {len(got[1])} {len(want[1])}; only Spark {extra}; only SQL {missing}"
    return ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    sqls, names = entry.oracle_sql(), sys.argv[2:]
    for name, q in entry.queries().items():
        if (names and name not in names) or (not names and (name.startswith("op") or name == "pipeline")):
            continue
        began = time.time()
        try:
            said = compare(session, sys.argv[1], q, sqls[name]) if name in sqls else f"rows only: {q(session, sys.argv[1]).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name} {time.time() - began:.1f}s {'OK' if not said else said}", flush=True)
