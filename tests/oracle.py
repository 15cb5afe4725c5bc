"""Compare registered queries with their SQL on DuckDB. Usage: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "~"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal":
            return f"{float(v):.9g}"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10] if len(v.isoformat()) <= 10 or v.isoformat().endswith("T00:00:00") else v.isoformat()
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def difference(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None when both engines agree, else a short description."""
    ours = fn(spark, sf_dir).toPandas()
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if a == b:
        return None if a else "no rows"
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} != {len(b)}; ours {str(only_a)[:700]} theirs {str(only_b)[:700]}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from feedloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session("8"), connect(sf_dir)
    fns, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in fns.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = difference(spark, con, name, fn, sqls[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
