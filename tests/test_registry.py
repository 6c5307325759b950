"""Registered queries: a sample is compared with its SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["flagship_node_match", "p7_roi_filter", "j8_iou_matching", "m1_average_precision", "t2_tile_assignment", "x2_tag_parse", "q3_get_neighbors", "l8_endpoint_binding"])
def test_query_matches_sql(spark, name):
    import __spark_entry__ as e
    from checks.compare import compare, duck
    state, info = compare(spark, SF, name, e.queries()[name], e.oracle_sql()[name], duck(SF))
    assert state == "ok", info
