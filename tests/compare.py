"""Side-by-side check of ``queries()`` against ``oracle_sql()`` (the same
comparison the build driver makes): row count, column names and an
order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return repr(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def compare(spark, name, fn, sql, sf_dir, con):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    s_hash, s_lines = digest(s_cols, s_rows)
    d_hash, d_lines = digest(d_cols, d_rows)
    ok = (len(s_rows) == len(d_rows)) and sorted(s_cols) == sorted(d_cols) and s_hash == d_hash
    detail = ""
    if not ok:
        if sorted(s_cols) != sorted(d_cols):
            detail = f"cols spark={s_cols} duck={d_cols}"
        else:
            a, b = set(s_lines), set(d_lines)
            detail = f"spark-only={sorted(a - b)[:3]} duck-only={sorted(b - a)[:3]}"
    return ok, len(s_rows), len(d_rows), detail


def main(argv):
    import __spark_entry__ as E
    from stakeperf.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    names = argv or list(qs)
    bad = 0
    for n in names:
        if n not in sqls:
            print(f"{n:26s} (no oracle)")
            continue
        try:
            ok, ns, nd, detail = compare(spark, n, qs[n], sqls[n], sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            ok, ns, nd, detail = False, -1, -1, f"{type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(f"{n:26s} {'OK ' if ok else 'BAD'} spark={ns} duck={nd} {detail}")
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
