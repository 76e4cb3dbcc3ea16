"""Run registered queries against their SQL: ``python -m tests.check_oracle [sf] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from netloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return "∅" if v != v else repr(v + 0.0)
        if isinstance(v, int):
            return repr(float(v))
        if type(v).__name__ == "Decimal":
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    spent = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = _normal(got), _normal(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return False, f"rows {len(a)} vs {len(b)}, differing {len(set(a) ^ set(b))}\n   spark {only_a}\n   sql   {only_b}"
    return True, f"{len(a)} rows, {spent:.1f}s"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
