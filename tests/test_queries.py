"""Every registered query of the engine against its oracle, at the smallest scale."""

import pytest
from oracle import same

from quillstream.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLE:
        same(df, registry.ORACLE[name], FOLDER)
    else:
        assert df.count() > 0


#: Queries that SQL can't express; each has a test of its own against brute force or exact search, or only its rows are counted here.
WITHOUT_SQL = {"nl_query_semantic", "rel_approx", "zlib_sizes", "vec_kmeans", "vec_ivf_probe", "vec_lsh"}


def test_all_other_queries_have_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE) == WITHOUT_SQL


def test_filters_are_pushed_down(spark):
    plan = registry.QUERIES["where_metadata_keys"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[-1]
