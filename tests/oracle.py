"""Run one registered query and its SQL side by side."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def connect(directory: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(df, con, sql: str) -> tuple[int, str]:
    """Row count and an empty text, or what differs."""
    names, rows = sql_rows(con, sql)
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {df.columns} and {names}"
    a, b = bag(df.columns, got), bag(names, rows)
    if a != b:
        return len(got), f"rows {len(got)} and {len(rows)}, e.g. {list((a - b))[:2]} and {list((b - a))[:2]}"
    return len(got), ""
