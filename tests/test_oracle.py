"""Layer 2: every registered query against its DuckDB oracle (sf0.001).

The oracle SQL follows the original job's shape (separate filtered
aggregates + outer joins, merged-back totals, one copy per campaign), so
this checks the Spark rewrites, not the same SQL twice.  The driver runs
the same comparison at sf0.01 (``tools/compare.py`` does it locally).
"""

import pytest

import __spark_entry__ as E
from oracle import ORACLE_SQL
from sellerdesk.plans.catalog import QUERIES
from tools.compare import duck, rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [r.asDict() for r in sdf.collect()]
    cols = sorted(sdf.columns)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    assert sorted(dcols) == cols
    assert len(srows) == len(drows)
    assert rows_of(srows, cols) == rows_of(drows, cols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "shop_name" in df.columns
