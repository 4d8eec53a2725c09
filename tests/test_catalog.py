"""Every catalogued query against DuckDB on the driver's tables."""

import pytest

from plexigraph.plans import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_predicates_reach_the_scan(spark):
    plan = catalog.traverse_parts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "EqualTo(l_returnflag,R)" in plan
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "l_extendedprice" not in plan


@pytest.mark.parametrize("name", ["reach_set", "discover_dag", "enumerate_paths", "confidence_paths", "event_order", "vertex_program_least", "shortest_path_nodes", "reach_path_nodes"])
def test_larger(spark, name):
    same(catalog.QUERIES[name](spark, "/root/testdata/sf0.01"), catalog.ORACLES[name], "/root/testdata/sf0.01")
