"""Runs SQL on the test tables and compares rows."""

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str = SMALL) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = c.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def rows(columns: list[str], data: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if x is None or isinstance(x, (str, bool)) or hasattr(x, "isoformat"):
            return x
        return None if math.isnan(x) else round(float(x), 5)

    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def same(df, sql: str, sf_dir: str = SMALL) -> None:
    columns, want = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want)
