"""Runs registered queries next to their SQL in DuckDB and reports differences.

usage: python check.py <table folder> [name ...]
"""

import sys
import time

import duckdb

from fleetgauge.catalog import all_queries
from fleetgauge.session import local_session


def normal(value):
    if isinstance(value, float) and value == 0.0:
        return "0.0"
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


FAMILIES = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def types_differ(df, cur):
    duck = {d[0]: str(d[1]) for d in cur.description}
    return [
        f"{name} {kind}/{duck[name]}"
        for name, kind in df.dtypes
        if duck[name] not in FAMILIES.get(kind, {kind})
    ]


def compare(spark, con, query, folder):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return len(got), None
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(names)}"
    odd = types_differ(df, cur)
    if odd:
        return len(got), "types " + ", ".join(odd)
    want = rows_of(names, cur.fetchall())
    if got == want:
        return len(got), None
    if len(got) != len(want):
        return len(got), f"{len(got)} rows against {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return len(got), f"{len(bad)} of {len(got)} rows differ\n   spark {bad[0][0]}\n    duck {bad[0][1]}"


def connect(folder):
    con = duckdb.connect()
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings"
        " pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def main(folder, names):
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            count, problem = compare(spark, con, query, folder)
        except Exception as e:
            count, problem = 0, f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        mark = "rows only" if query.sql is None else "ok"
        print(f"{name:32} {count:8} {time.time() - start:6.2f}s {problem or mark}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
