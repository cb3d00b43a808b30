"""Every registered query of the library against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from pagetrail.plans import desk, oracles, queries, trials

ORACLES, QUERIES = oracles.ORACLES | desk.ORACLES | trials.ORACLES, queries.QUERIES | desk.QUERIES | trials.QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return ""
    return str(v) if isinstance(v, bool) or not isinstance(v, (int, float)) else str(round(float(v), 9))


def rows(df):
    return sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.to_dict("records"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
