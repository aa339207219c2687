"""Every registered query of the lineage engine against DuckDB."""

import pytest
from compare import duck, rows

from tracewright import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11


def test_coverage_totals_take_in_every_order(spark):
    got = catalogue.queries()["coverage_totals"](spark, SF).toPandas()
    assert got[["F_total", "O_total", "P_total"]].to_numpy().sum() == catalogue.read(spark, SF, "orders").count()


def test_tree_queries(spark):
    for name in ("ast_diff", "ast_search"):
        assert catalogue.queries()[name](spark, SF).count() > 0
