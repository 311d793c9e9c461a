"""Runs a query and its SQL over the same folder and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    names = sorted(df.columns)
    return names, sorted(map(tuple, df[names].astype(str).itertuples(index=False)))


def check(spark, sf_dir, query, sql):
    got = query(spark, sf_dir).toPandas()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.execute(sql).df()
    assert rows(got) == rows(want)
    assert len(got) > 0
