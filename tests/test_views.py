"""Views that several others name are computed once per query."""

import decimal

import pytest

from checks import all_queries, views


@pytest.fixture()
def sf(spark, tmp_path):
    rows = [(1 + i // 4, 1 + i * 37 % 200, 1 + i * 11 % 10, 1 + i % 4, decimal.Decimal(f"{900 + i * 7 % 500}.{i % 100:02d}")) for i in range(900)]
    d = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_extendedprice decimal(15,2)")
    d.repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_shared_views_are_computed_once(spark, sf, monkeypatch):
    all_queries()
    made, stage = [], views.staged
    monkeypatch.setattr(views, "staged", lambda d: made.append(d.inputFiles()) or stage(d))
    v = views.Views(spark, sf)
    got = {n: v.__getattr__(n) for n in ("edge", "vertex", "branch", "gt_edge", "gt_vertex", "ink")}
    assert len(made) == len(views.KEPT)
    # lineitem is read for the vertices alone
    assert sum(any("lineitem" in f for f in files) for files in made) == 1
    assert not any("lineitem" in f for d in got.values() for f in d.inputFiles())
    for n, d in got.items():
        plain = views.view(spark, sf, n)
        assert d.columns == plain.columns
        assert d.count() > 0 and d.exceptAll(plain).isEmpty() and plain.exceptAll(d).isEmpty(), n
