"""Differential check: Spark query vs DuckDB oracle on the same parquet tables.

Usable from pytest and as a script:
    python -m tests.oracle_compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(dtype) -> str:
    k = getattr(dtype, "kind", "O")
    if k in "iu":
        return "int"
    if k == "f":
        return "float"
    if k == "b":
        return "bool"
    return "other"


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v == 0:
            v = 0.0
        return repr(float(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    out.sort()
    return out


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries
    q = queries()[name]
    sql = oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return True, f"{name}: spark only, {len(sdf)} rows ({t1 - t0:.1f}s)"
    ddf = con.execute(sql).df()
    msgs = []
    if sorted(sdf.columns) != sorted(ddf.columns):
        return False, (f"{name}: columns differ spark-only={sorted(set(sdf.columns) - set(ddf.columns))} "
                       f"duck-only={sorted(set(ddf.columns) - set(sdf.columns))}")
    for c in sdf.columns:
        ks, kd = _kind(sdf[c].dtype), _kind(ddf[c].dtype)
        if ks != kd and not (len(sdf) == 0 or sdf[c].isna().all() or ddf[c].isna().all()):
            msgs.append(f"type {c}: spark {sdf[c].dtype} duck {ddf[c].dtype}")
    for c in sdf.columns:                # pandas holds whole numbers with nulls as floats on one side only
        if {_kind(sdf[c].dtype), _kind(ddf[c].dtype)} == {"int", "float"} and (sdf[c].isna().any() or ddf[c].isna().any()):
            sdf[c], ddf[c] = sdf[c].astype("Float64").astype("Int64"), ddf[c].astype("Float64").astype("Int64")
            msgs = [m for m in msgs if not m.startswith(f"type {c}:")]
    if len(sdf) != len(ddf):
        return False, f"{name}: rows spark={len(sdf)} duck={len(ddf)} " + "; ".join(msgs)
    rs, rd = frame_rows(sdf), frame_rows(ddf)
    if rs != rd:
        cols = sorted(sdf.columns)
        diffs = [(a, b) for a, b in zip(rs, rd) if a != b][:3]
        detail = []
        for a, b in diffs:
            detail.append({cols[i]: (a[i], b[i]) for i in range(len(cols)) if a[i] != b[i]})
        return False, f"{name}: values differ ({sum(1 for a, b in zip(rs, rd) if a != b)} rows) {detail} " + "; ".join(msgs)
    if msgs:
        return False, f"{name}: " + "; ".join(msgs)
    return True, f"{name}: ok {len(sdf)} rows ({t1 - t0:.1f}s)"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from arrears.session import get_session
    from __spark_entry__ import queries
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    names = names or list(queries())
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            text = str(e)
            cause = text[text.find("Caused by"):][:600] if "Caused by" in text else ""
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {text[:300]} {cause}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
