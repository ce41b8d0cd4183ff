"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as E
from stakeperf.plans import queries as QP
from tests.compare import compare, duck

QUERIES = dict(QP.QUERIES)
SQL = {k: E.oracle_sql()[k] for k in QUERIES}


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_small, con, name):
    ok, ns, nd, detail = compare(spark, name, QUERIES[name], SQL[name], sf_small, con)
    assert ok, f"{name}: spark={ns} duck={nd} {detail}"


def test_entry_smoke(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    df = E.entry(spark)
    assert df.count() > 0 and "cumUSD" in df.columns
    assert E.entry(spark).schema == df.schema          # stable across calls


SPARK_TO_DUCK = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE",
                 "boolean": "BOOLEAN", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_oracle(spark, sf_small, con, name):
    df = QUERIES[name](spark, sf_small)
    mine = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}
    rel = con.sql(SQL[name])
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert mine == theirs
