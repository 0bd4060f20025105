"""Compares a query with its SQL, in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr(tuple(r[i] for i in order)) for r in rows))


def duck_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return rows_of(columns, cur.fetchall())


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got, want = rows_of(df.columns, df.collect()), duck_rows(sf_dir, sql)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    return len(got[1])
