"""Run each named analysis on Spark and its SQL oracle on DuckDB; compare results.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Reports per query: row counts, column names, exact multiset equality of rows,
and the largest absolute numeric difference when rows differ.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from scenaria.plans.catalog import QUERIES  # noqa: E402
from scenaria.plans.sql import ORACLE  # noqa: E402
from scenaria.session import local_session  # noqa: E402
from scenaria.sources.tables import TABLES, table_path  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(df, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.to_dict("records")), key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(cores=int(os.environ.get("CORES","8")))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    ok = 0
    for n in names:
        t0 = time.time()
        sdf = QUERIES[n](spark, sf_dir)
        sp = sdf.toPandas()
        t1 = time.time()
        if n not in ORACLE:
            print(f"{n:28s} spark rows={len(sp)} (no oracle) {t1-t0:.1f}s")
            continue
        dd = con.execute(ORACLE[n]).df()
        scols, dcols = sorted(sp.columns), sorted(dd.columns)
        if scols != dcols:
            print(f"{n:28s} COLUMNS DIFFER spark={scols} duck={dcols}")
            continue
        a, b = rows_of(sp, scols), rows_of(dd, scols)
        same = a == b
        maxdiff = 0.0
        ndiff = 0
        if not same and len(a) == len(b):
            for ra, rb in zip(a, b):
                if ra != rb:
                    ndiff += 1
                for x, y in zip(ra, rb):
                    if isinstance(x, float) and isinstance(y, float):
                        maxdiff = max(maxdiff, abs(x - y))
        status = "OK" if same else "DIFF"
        ok += same
        print(f"{n:28s} {status} spark={len(a)} duck={len(b)} diffrows={ndiff} maxdiff={maxdiff:.3g} {t1-t0:.1f}s")
        if not same and os.environ.get("SHOW"):
            shown = 0
            for ra, rb in zip(a, b):
                if ra != rb and shown < 4:
                    shown += 1
                    print("  S", ra)
                    print("  D", rb)
            print("  dtypes spark:", dict(sp.dtypes), "\n  duck:", dict(dd.dtypes))
    print(f"{ok}/{len([n for n in names if n in ORACLE])} match")


if __name__ == "__main__":
    main()
