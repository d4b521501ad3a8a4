"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from phenogrid import registry

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def rows(frame):
    def one(v):
        if v is None or v != v:
            return None
        return round(v, 5) + 0.0 if isinstance(v, float) else bool(v) if type(v).__name__ == "bool_" else v

    cols = sorted(frame.columns)
    return cols, sorted((tuple(one(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


# on the tables that QUERY_DATA names
NAMES = sorted(registry.SQL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    import pandas as pd

    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    mine = pd.DataFrame([[r[c] for c in cols] for r in got.collect()], columns=cols, dtype=object)
    rel = duck.execute(registry.SQL[name])
    names = [d[0] for d in rel.description]
    theirs = pd.DataFrame(rel.fetchall(), columns=names, dtype=object)
    assert rows(mine) == rows(theirs)


def test_every_twin_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
