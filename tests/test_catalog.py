import pytest

import __spark_entry__
from alphaline import catalog, catalog_items, catalog_rules  # noqa: F401  the last two register their queries in the first
from tests.conftest import DATA
from tests.oracle import rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    assert rows(found) == sql_rows(catalog.ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 33
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from alphaline.sources.tables import table

    plan = table(spark, DATA, "documents").where("n_chars > 100").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,100)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan
