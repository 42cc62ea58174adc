"""Run the SQL of a query in DuckDB and compare with its Spark result."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{round(value, 5) + 0.0:.5f}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def kind(type_name):
    t = type_name.lower()
    if t in ("tinyint", "smallint", "integer", "int", "bigint", "long", "hugeint"):
        return "integer"
    if t.startswith(("double", "float", "decimal")):
        return "float"
    if t in ("varchar", "string"):
        return "text"
    return t


def compare(con, sql, frame):
    """None when equal, else what differs."""
    described = con.execute(f"describe {sql}").fetchall()
    expected_types = {d[0]: d[1] for d in described}
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    actual = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(names)} / {sorted(frame.columns)}"
    actual_types = dict(frame.dtypes)
    for n in names:
        if kind(expected_types[n]) != kind(actual_types[n]):
            return f"type of {n}: {expected_types[n]} / {actual_types[n]}"
    if len(expected) != len(actual):
        return f"rows {len(expected)} / {len(actual)}"
    for e, a in zip(expected, actual):
        if e != a:
            return f"{sorted(names)}\n expected {e}\n actual   {a}"[:1500]
    return None if expected else "both empty"
