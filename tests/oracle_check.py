"""Local stand-in for the driver's correctness gate.

Runs ``queries()[name]`` on Spark and ``oracle_sql()[name]`` on DuckDB over the
same parquet tables and compares row count, column names and an
order-insensitive hash of the values (doubles rounded to 6 places).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, places=6):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, places) if places is not None else v
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x, places) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, places)) for k, x in v.items()))
    return str(v)


def table_hash(cols: list[str], rows: list[tuple], places=6) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i], places) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            out[name] = {"ok": False, "error": f"spark: {type(e).__name__}: {str(e)[:300]}"}
            if verbose:
                print(name, out[name], flush=True)
            continue
        ts = time.time() - t0
        res = {"rows": len(srows), "spark_sec": round(ts, 2)}
        if name in sqls:
            try:
                cur = con.execute(sqls[name])
                dcols = [d[0] for d in cur.description]
                drows = cur.fetchall()
            except Exception as e:  # noqa: BLE001
                res.update(ok=False, error=f"duckdb: {str(e)[:300]}")
                out[name] = res
                if verbose:
                    print(name, res, flush=True)
                continue
            res["oracle_rows"] = len(drows)
            res["cols_match"] = sorted(scols) == sorted(dcols)
            res["hash_match"] = table_hash(scols, srows) == table_hash(dcols, drows)
            res["strict_match"] = table_hash(scols, srows, None) == table_hash(dcols, drows, None)
            res["ok"] = res["cols_match"] and res["hash_match"] and len(srows) == len(drows)
            if not res["cols_match"]:
                res["spark_cols"], res["oracle_cols"] = scols, dcols
        else:
            res["ok"] = None
        out[name] = res
        if verbose:
            print(name, res, flush=True)
    return out


if __name__ == "__main__":
    from marketflow.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    r = compare(spark, sf, names)
    bad = [k for k, v in r.items() if v.get("ok") is False]
    print("FAILED:", bad)
    print(f"{sum(1 for v in r.values() if v.get('ok'))} ok / {len(r)}")
