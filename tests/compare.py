"""Runs queries and their SQL twins side by side; also usable from a shell:
``python -m tests.compare [name ...]``."""

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def compare(spark, con, name, make, sql, sf_dir):
    got = make(spark, sf_dir)
    mine = normal(got.columns, [tuple(r) for r in got.collect()])
    described = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    types = {c: TYPES.get(t, t) for c, t in got.dtypes}
    assert types == described, f"{name}: types {types} and {described}"
    result = con.execute(sql)
    theirs = normal([d[0] for d in result.description], result.fetchall())
    assert mine[0] == theirs[0], f"{name}: columns {mine[0]} and {theirs[0]}"
    assert len(mine[1]) == len(theirs[1]), f"{name}: {len(mine[1])} and {len(theirs[1])} rows"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    assert not wrong, f"{name}: {len(wrong)} of {len(mine[1])} rows differ, first {wrong[0]}"
    return len(mine[1])


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tests.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), duck(sf)
    chosen = sys.argv[1:] or list(queries())
    for name in chosen:
        start = time.time()
        try:
            rows = compare(spark, con, name, queries()[name], oracle_sql()[name], sf)
            print(f"ok    {name} {rows} rows {time.time() - start:.1f}s", flush=True)
        except Exception as error:
            print(f"WRONG {name} {time.time() - start:.1f}s {str(error)[:1500]}", flush=True)
