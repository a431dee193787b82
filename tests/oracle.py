"""Run registered queries beside their SQL and report differences.

    python tests/oracle.py [prefix ...]      (SF_DIR selects the tables)

WIDE=1 pretends that no cross-section fits one task, so that the split plans
of every cross-sectional operator are compared too.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    try:
        return int(v) if not isinstance(v, str) and float(v) == int(v) and not isinstance(v, float) else v
    except (TypeError, ValueError):
        return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in rows], [cols[i] for i in order]


def key(t):
    return tuple((x is not None, str(type(x)), x if x is not None else 0) for x in t)


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t = f" spark={time.time() - t:.2f}s"
    cur = con.execute(sql)
    want, wc = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gc != wc:
        return f"columns {gc} vs {wc}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    try:
        got.sort(key=key), want.sort(key=key)
    except TypeError as e:
        return f"unsortable {e}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)}/{len(got)} differ, first {gc}: {bad[0][0]} vs {bad[0][1]}"
    types = [(c, type(a), type(b)) for a, b in zip(got[:1], want[:1]) for c, a, b in zip(gc, a, b) if type(a) is not type(b)]
    empty = "" if got else " EMPTY"
    allnull = [c for i, c in enumerate(gc) if got and all(r[i] is None for r in got)]
    return ("OK" + empty + (f" types {types}" if types else "") + (f" all-null {allnull}" if allnull else "")
            + f" rows={len(got)}" + t)


def main(prefixes):
    from __spark_entry__ import oracle_sql, queries
    from panelwright.scale import session

    if os.environ.get("WIDE"):
        from dataclasses import replace

        from panelwright.scale import Scale

        measure = Scale.measure
        Scale.measure = classmethod(lambda cls, df, *a, **k: replace(measure(df, *a, **k), rows_per_task=1))
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(8), connect(folder)
    spark.sparkContext.setLogLevel("OFF")
    sqls, fails = oracle_sql(), []
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            if name in sqls:
                res = compare(spark, con, name, fn, sqls[name], folder)
            else:
                res = f"OK rows-only {len(fn(spark, folder).collect())}"
        except Exception as e:  # noqa: BLE001 - report and continue
            res = f"ERROR {type(e).__name__} {str(e).splitlines()[0][:300]}"
        if not res.startswith("OK") or "EMPTY" in res or "all-null" in res or "types" in res:
            fails.append(name)
        print(f"{name:45s} {time.time() - t:6.2f}s {res}", flush=True)
    print("ATTENTION:", fails)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
