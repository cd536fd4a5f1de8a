"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest
from compare import differences

from corvine.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, name):
    assert name in registry.ORACLE_SQL
    assert differences(registry.QUERIES[name](spark, SF), SF, registry.ORACLE_SQL[name]) == ""
