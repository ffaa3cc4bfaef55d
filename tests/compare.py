"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Usage: python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, exact: bool = False):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (v if exact else round(v, 6))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, exact) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), exact)
    return v


# Spark simple type name -> DuckDB type name
_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
    "array<double>": "DOUBLE[]",
}


def _spark_types(sdf) -> dict[str, str]:
    return {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}


def _rows(cols: list[str], rows, exact: bool = False) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], exact) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare_one(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"name": name, "rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["match"] = None
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    res["columns_match"] = sorted(s_cols) == sorted(d_cols)
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    s_types = _spark_types(sdf)
    res["types_match"] = s_types == d_types
    if not res["types_match"]:
        res["type_diff"] = {c: (s_types.get(c), d_types.get(c)) for c in d_types if s_types.get(c) != d_types.get(c)}
    res["match"] = res["columns_match"] and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
    res["exact"] = res["columns_match"] and _rows(s_cols, s_rows, exact=True) == _rows(
        d_cols, d_rows, exact=True
    )
    if not res["match"]:
        res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
        res["spark_sample"] = _rows(s_cols, s_rows)[:3]
        res["oracle_sample"] = _rows(d_cols, d_rows)[:3]
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from sessionflow.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        r = compare_one(spark, con, name, fn, oracles.get(name), sf_dir)
        bad += r["match"] is False
        print(r, flush=True)
    print("MISMATCHES", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
