"""Run registered queries next to their SQL and compare the rows.

``python -m barloom.suite.compare <folder> [name prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(x)) for k, x in value.items()))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str):
    """``(status, detail)``; status is match, rows-only or differ."""
    from barloom.suite import all_queries

    queries, sql = all_queries()
    df = queries[name](spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    got_cols, got = _rows(df.columns, got_rows)
    if name not in sql:
        return "rows-only", f"{len(got_rows)} rows"
    cur = con.execute(sql[name])
    want_names = [d[0] for d in cur.description]
    want_cols, want = _rows(want_names, cur.fetchall())
    if got_cols != want_cols:
        return "differ", f"columns {got_cols} against {want_cols}"
    if got == want:
        return "match", f"{sum(got.values())} rows"
    only_got, only_want = got - want, want - got
    return "differ", (
        f"{sum(got.values())} against {sum(want.values())} rows, {sum(only_got.values())} unmatched, "
        f"e.g. {sorted(map(str, only_got))[:2]} / {sorted(map(str, only_want))[:2]}"
    )


def main(argv):
    from barloom.session import local_session
    from barloom.suite import all_queries

    folder, prefixes = argv[0], argv[1:]
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in all_queries()[0]:
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.time()
        try:
            status, detail = compare(spark, con, folder, name)
        except Exception as e:  # report and go on with the next query
            status, detail = "error", str(e)[:600]
        bad += status in ("differ", "error")
        print(f"{status:9} {name:34} {time.time() - start:6.2f}s {detail}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
