"""Every registered query on the smoke data: its values are those of its SQL,
or, where SQL cannot express it, it has rows and the columns it promises."""
import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_oracle import TABLES, normalise

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
EMPTY = {"A18_null_report"}   # the feature matrix has no nulls


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_matrix():
    """The model queries share the feature matrix that each of them would build."""
    from kestrel.plans import catalog
    build, held = catalog._matrix, {}

    def shared(spark, sf_dir):
        if sf_dir not in held:
            held[sf_dir] = build(spark, sf_dir)
        return held[sf_dir]
    catalog._matrix = shared
    yield
    catalog._matrix = build


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "team1_won" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 80


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 or name in EMPTY
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLE:
        want = con.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
        assert normalise(got).equals(normalise(want))
    else:
        assert not got.isna().all(axis=0).all()
