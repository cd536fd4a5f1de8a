"""Run registered queries next to their DuckDB SQL and compare all rows: python tests/compare.py SF_DIR [NAME...]"""

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    return names, got.fetchall()


def differences(df, sf_dir: str, sql: str) -> str:
    names, want = oracle(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, want)
    if got == want:
        return ""
    odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"{len(got)} and {len(want)} rows; {odd}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            if name in sql:
                what = differences(queries[name](spark, sys.argv[1]), sys.argv[1], sql[name]) or "same"
            else:
                what = f"{len(queries[name](spark, sys.argv[1]).collect())} rows, no SQL"
        except Exception as x:
            what = f"FAILED {str(x)[:1500]}"
        print(f"{name}: {what} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
