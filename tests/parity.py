"""Run registered queries beside their SQL: python tests/parity.py [sf_dir] [name...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (bool, str, type(None))):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return rows_of([c[0] for c in found.description], found.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, else what differs first."""
    names, got = spark_rows(df)
    wanted_names, wanted = oracle(sql, sf_dir)
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows and {len(wanted)}; e.g. {next((x for x in zip(got, wanted) if x[0] != x[1]), None)}"
    return next((f"{a} and {b}" for a, b in zip(got, wanted) if a != b), "")


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        began = time.time()
        try:
            if name in sqls:
                said = difference(query(spark, sf_dir), sqls[name], sf_dir) or "same"
            else:
                df = query(spark, sf_dir)
                said = f"no SQL, {df.count()} rows {df.columns}"
                df.show(3, truncate=60)
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
