"""Run registered queries on Spark and their oracle SQL on DuckDB; compare row count,
column names and an order-insensitive hash of the values (as the driver does)."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            # pandas turns whole numbers with nulls into floats, DuckDB does not
            whole = {f.name: "Int64" for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint")}
            sdf = df.toPandas().astype(whole)
        except Exception as e:  # noqa: BLE001
            out[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, out[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sql:
            out[name] = f"rows-only ({len(sdf)} rows)"
            if verbose:
                print(f"{name}: {out[name]} {ts:.1f}s", flush=True)
            continue
        try:
            ddf = con.execute(sql[name]).df()
            ddf = ddf.astype({c: "Int64" for c in whole if c in ddf.columns})
        except Exception as e:  # noqa: BLE001
            out[name] = f"SQL ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, out[name], flush=True)
            continue
        ok_cols = sorted(sdf.columns) == sorted(ddf.columns)
        ok_rows = len(sdf) == len(ddf)
        ok_hash = ok_cols and ok_rows and digest(sdf) == digest(ddf)
        out[name] = "OK" if ok_hash else f"MISMATCH cols={ok_cols} rows={len(sdf)}/{len(ddf)}"
        if verbose:
            print(f"{name}: {out[name]} {ts:.1f}s", flush=True)
            if not ok_cols:
                print("   spark:", list(sdf.columns), "\n   duck: ", list(ddf.columns))
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pairmine.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    print("SUMMARY", len(res) - len(bad), "ok of", len(res), "bad:", sorted(bad))
