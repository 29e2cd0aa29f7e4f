"""Run bound queries beside their SQL and compare the rows.

    python -m tests.compare [name-part ...]   (SF_DIR picks the data folder)
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return None if math.isnan(f) else round(f, 6) + 0.0
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """Text of the first difference, or None when both agree."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        return (f"{sum(got.values())} rows against {sum(want.values())}; "
                f"only ours {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}")
    if not got:
        return "no rows on either side"
    return None


def main():
    from tallywise.plans import load
    from tallywise.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = load()
    bad = 0
    for name, fn in queries.items():
        if sys.argv[1:] and not any(a in name for a in sys.argv[1:]):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                diff = None if n else "no rows"
        except Exception as e:
            diff = "".join(traceback.format_exception_only(e))[:1500]
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s "
              f"{'' if name in oracles else '(rows only) '}{diff or ''}", flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
