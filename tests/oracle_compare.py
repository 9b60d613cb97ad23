"""Run registered Spark queries and their DuckDB oracle SQL side by side.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return ("f", repr(round(v, 9)))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        seq = v.tolist() if hasattr(v, "tolist") else v
        return ("l", tuple(_norm(x) for x in seq))
    return ("s", str(v))


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK-ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        dt = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only ({len(sp)} rows)"
            if verbose:
                print(f"{name:28s} {results[name]} {dt:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
            dk = rel.df()
        except Exception as e:  # noqa: BLE001
            results[name] = f"SQL-ERROR {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        sc, sr = rows_of(sp)
        dc, dr = rows_of(dk)
        type_bad = {c: (t, dtypes.get(c)) for c, t in stypes.items() if SPARK_TO_DUCK.get(t, t) != dtypes.get(c)}
        if sc != dc:
            res = f"COLS spark={sc} sql={dc}"
        elif type_bad:
            res = f"TYPES {type_bad}"
        elif len(sp) != len(dk):
            res = f"ROWS spark={len(sp)} sql={len(dk)}"
        elif sr != dr:
            diff = list((sr - dr).items())[:2], list((dr - sr).items())[:2]
            res = f"VALUES differ ({sum((sr - dr).values())} rows) e.g. {str(diff)[:600]}"
        else:
            res = "OK"
        results[name] = res
        if verbose:
            print(f"{name:28s} {res} rows={len(sp)} {dt:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from murmur.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", 8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v != "OK" and not v.startswith("rows-only")}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok; failing: {sorted(bad)}")
