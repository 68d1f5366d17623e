"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conftest import SF_SMALL  # noqa: E402
from scripts.compare import norm  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from corvid.plans.catalog import all_queries  # noqa: E402
from corvid.sources.tables import TABLES  # noqa: E402

QUERIES = queries()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["bin_start", "success_rate", "n_functions", "bin_end"]
    assert df.count() > 0


def test_every_sql_area_has_queries():
    own = all_queries()
    assert {n.split("_")[0][0] for n in own} == set("BCGLPRTXZ".lower())
    assert sum(q.oracle is not None for q in own.values()) >= 0.85 * len(own)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = ORACLES.get(name)
    if sql is None:
        assert len(got) > 0
        return
    rel = duck.execute(sql)
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    idx = sorted(range(len(ocols)), key=lambda i: ocols[i])
    want = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want
