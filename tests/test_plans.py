"""Plan properties of the registered queries: no cross products, partial
top-k before shuffles, column pruning at the scan."""

import os

import pytest

from tessera.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="driver tables absent")


def _plans(df):
    qe = df._jdf.queryExecution()
    return qe.optimizedPlan().toString(), qe.executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product(spark, name):
    opt, phys = _plans(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Join Cross"):
        assert bad not in opt and bad not in phys, (name, bad)


def test_knn_uses_partial_top_k(spark):
    _, phys = _plans(QUERIES["knn_chebyshev"](spark, SF))
    assert "WindowGroupLimit" in phys


def test_outlier_filter_prunes_columns(spark):
    df = QUERIES["outlier_filter"](spark, SF)
    _, phys = _plans(df)
    assert "l_shipdate" not in phys and "l_comment" not in phys
