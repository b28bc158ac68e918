import duckdb

from lodforge.llm import queries


def test_sql_twins(spark):
    sf = "/root/testdata/sf0.01"
    for name, sql in queries.ORACLES.items():
        connection = duckdb.connect()
        for view in ("pages", "documents"):
            connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{sf}/{view}.parquet'")
        told = connection.execute(sql)
        names = [d[0] for d in told.description]
        found = queries.QUERIES[name](spark, sf).select(*names).collect()
        assert sorted(map(tuple, found), key=str) == sorted(told.fetchall(), key=str), name
