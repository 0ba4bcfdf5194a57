"""Compares a registered query with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql):
    """None, or what differs."""
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_names, want = rows([c[0] for c in res.description], res.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}: {[x for x in got if x not in set(want)][:2]} / {[x for x in want if x not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    return f"{len(bad)} of {len(got)} rows, first {bad[0]}" if bad else None
