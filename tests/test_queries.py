"""Each of the engine's queries against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from contactloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert rows(catalog.queries()[name](spark, sf_dir).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
