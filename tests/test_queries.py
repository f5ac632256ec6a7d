"""Every registered geographic query against its oracle, and the shape of the spatial joins' plans."""

import pytest

from geoloom.plans import catalogue
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, ORACLES[name], SF)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["jn06_heights_by_id_or_place", "jn07_tallest_point_inside", "jn08_registry_match", "jn10_gap_fill_buildings", "jn12_road_attributes", "jn36_nearest_station"])
def test_spatial_joins_are_equi_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
