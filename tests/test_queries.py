"""Every registered query of the engine that has DuckDB SQL gives that SQL's rows on the smallest tables."""

import duckdb
import pytest

from textloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([round(x, 5) + 0.0 if isinstance(x, float) else x for x in map(lambda v: v.item() if hasattr(v, "item") else v, row)]) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours.astype(object).where(ours.notna(), None)) == plain(theirs.astype(object).where(theirs.notna(), None))
