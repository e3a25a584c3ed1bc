"""Run registered queries beside their check SQL and report differences.

usage: python tests/check_queries.py [scale folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "is_integer"):
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def checking_engine(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, queries, oracles) -> str:
    df = queries[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return f"rows {len(got)}"
    cur = con.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} / {sorted(columns)}"
    if got == want:
        return f"ok {len(got)}"
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"DIFFERS {len(got)} / {len(want)}\n   only spark {sorted(a - b)[:3]}\n   only check {sorted(b - a)[:3]}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = checking_engine(sf_dir)
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name, queries, oracles)
        except Exception as error:  # report and go on with the rest
            verdict = f"FAILED {str(error)[:600]}"
        print(f"CHECK {name} {time.time() - start:.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
