"""Runs a query in Spark and its SQL in DuckDB and compares names, types and values."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

SPARK_KIND = {
    "bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool",
}
DUCK_KIND = {
    "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool",
}
WIDTH = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _value(v):
    return v + 0.0 if isinstance(v, float) else v  # -0.0 prints as 0.0


def compare(df, con, sql: str) -> list[str]:
    """Empty list when both agree; otherwise what differs."""
    res = con.sql(sql)
    duck = dict(zip(res.columns, map(str, res.types)))
    spark_types = dict(df.dtypes)
    names = sorted(spark_types)
    if names != sorted(duck):
        return [f"columns {names} vs {sorted(duck)}"]
    issues = [
        f"type of {n}: {spark_types[n]} vs {duck[n]}" for n in names if WIDTH.get(spark_types[n]) != duck[n]
    ]
    order = [res.columns.index(n) for n in names]
    b = sorted((tuple(_value(r[i]) for i in order) for r in res.fetchall()), key=_key)
    a = sorted((tuple(_value(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    if len(a) != len(b):
        issues.append(f"rows {len(a)} vs {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        issues.append(f"{len(wrong)} rows differ, first {names}: {wrong[0]}")
    return issues


def main(sf: str, wanted: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from flowlens.plans.catalog import ORACLES, QUERIES
    from flowlens.session import local_session

    spark, con, bad = local_session(8), connect(sf), 0
    for name in wanted or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLES:
                issues = compare(df, con, ORACLES[name])
            else:
                n = df.count()
                issues = [] if n else ["no rows"]
        except Exception as err:  # report and go on with the next query
            issues = [f"{type(err).__name__}: {str(err)[:600]}"]
        bad += bool(issues)
        mark = "ok " if name in ORACLES else "run"
        print(f"{mark if not issues else 'BAD'} {name} {time.time() - start:.2f}s", *issues, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
