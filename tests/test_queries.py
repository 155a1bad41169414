"""Every query with an oracle gives DuckDB's rows; the others give rows."""

import pytest
from compare import check

from pagelattice.plans import queries as plans
from pagelattice.plans.fixtures import SQL, with_fixtures

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        check(df, ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_fixture_text_is_added_once():
    text = with_fixtures("select * from fx_region join fx_line using (page_id)")
    assert text.count("fx_line as (") == 1 and text.index("fx_line as (") < text.index("fx_region as (")
    assert set(SQL) >= {"fx_line", "fx_region"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES)
