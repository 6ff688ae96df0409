"""Compare a Spark result with a DuckDB result the way the driver does, but verbosely."""

import datetime as dt
import math
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, Decimal):
        return f"decimal:{value}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql):
    """None when equal, else a short description."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    relation = con.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    types = dict(spark_df.dtypes), dict(zip(relation.columns, map(str, relation.types)))
    named = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
    odd = {c: (t, types[1][c]) for c, t in types[0].items() if named.get(t) != types[1][c]}
    if odd:
        return f"types {odd}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}"
    return None
