"""Run registered queries against their SQL twins: ``python tests/compare.py [sf] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


TIMES = {}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return ("", "null")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, float):
        return ("f", f"{value:.9g}")
    return (type(value).__name__, str(value))


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows])


def compare(spark, con, name, query, sql, sf_dir):
    """Empty text when both sides agree, else what differs."""
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    TIMES[name] = time.time() - start
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = rows_of(got, df.columns), rows_of(want, names)
    if a == b:
        return "" if a else "no rows on either side"
    left, right = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} rows against {len(b)}\n   spark {left}\n   sql   {right}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from reviewmill.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    session = local_session(8)
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    wanted = sys.argv[2:]
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(session, con, name, query, sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        mark = "ok " if not problem else "BAD"
        print(f"{mark} {name} {TIMES.get(name, 0):.1f}s of {time.time() - start:.1f}s {'' if name in sqls else '(no sql)'} {problem}", flush=True)
