"""Every relational query against its SQL on the driver's smallest tables."""

import compare
import pytest

from corvane import csuite, relational, storesuite

SF = "/root/testdata/sf0.001"
QUERIES = relational.QUERIES | csuite.QUERIES | storesuite.QUERIES
SQL = relational.ORACLE_SQL | csuite.ORACLE_SQL | storesuite.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert name in SQL
    assert not compare.differences(QUERIES[name](spark, SF), SQL[name], SF)


def test_a_scan_of_generated_programs_has_no_errors(spark):
    assert csuite.scan(spark, SF).errors().count() == 0
