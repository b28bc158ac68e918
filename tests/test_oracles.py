"""Every registered query with an SQL twin must equal it on DuckDB, row for row."""

import os

import duckdb
import pytest

import __spark_entry__
from lodforge.plans import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", params=["sf0.01"])
def twin(request):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{request.param}/{name}.parquet'")
    return connection, f"{DATA}/{request.param}"


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, twin, name):
    connection, sf_dir = twin
    found = registry.QUERIES[name](spark, sf_dir)
    told = connection.execute(registry.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(found.columns) == sorted(names)
    assert plain(found.collect(), found.columns) == plain(told.fetchall(), names)


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir(DATA)
