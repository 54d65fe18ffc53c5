"""Compare registered queries with their SQL on DuckDB.

``python tests/oracle.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    cols = sorted(names)
    take = [names.index(c) for c in cols]
    want = sorted([tuple(r[i] for i in take) for r in want], key=repr)
    got = sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ, first\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return f"" if want else "both empty"


def main() -> None:
    from logtables.session import local_session

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8, 8, "10g")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if names and not any(name.startswith(n) for n in names):
            continue
        begun = time.time()
        try:
            if name in oracles:
                why = compare(queries[name](spark, sf_dir), con, oracles[name])
            else:
                n = queries[name](spark, sf_dir).count()
                why = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(why)
        print(f"{'BAD ' if why else 'ok  '} {name:28s} {time.time() - begun:6.2f}s {why}", flush=True)
    print("failed", failed)
    spark.stop()


if __name__ == "__main__":
    main()
