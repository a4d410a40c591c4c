"""Run a registered query and its SQL twin, compare columns and rows in any order."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canon(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, run, sql):
    df = run(spark, sf)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = rows_of(names, rel.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(found) == len(expected), (len(found), len(expected), found[:3], expected[:3])
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    kinds = lambda rows: {tuple(type(v).__name__ for v in r if v is not None) for r in rows[:1]}
    assert kinds(found) == kinds(expected), (kinds(found), kinds(expected))
    return len(found)
