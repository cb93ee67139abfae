"""Runs registered queries beside their SQL twins and reports differences."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    f = float(v)
    return "nan" if math.isnan(f) else (float(f"{f:.12g}") if f else 0.0)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    return compare_frame(fn(spark, sf_dir), con, sql)


def compare_frame(df, con, sql: str) -> str | None:
    got = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = normal_rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only spark {list(set(got) - set(want))[:2]}; only sql {list(set(want) - set(got))[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, columns {sorted(names)}: {bad[:2]}" if bad else None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from driftline.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if len(argv) > 1 and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = difference(spark, con, fn, sqls[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001 - the report names every failing query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
