"""Boxes that are joined by cell come from a table made once, and their joins stay small enough to be compiled."""

import decimal
import re

import pytest

from checks import all_queries, views
from sheetgraph.operators import match

BOX = "x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows = [(1 + i // 4, 1 + i * 37 % 200, 1 + i * 11 % 10, 1 + i % 4, decimal.Decimal(f"{900 + i * 7 % 500}.{i % 100:02d}")) for i in range(900)]
    d = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_extendedprice decimal(15,2)")
    d.repartition(3).write.parquet(str((path := tmp_path_factory.mktemp("sf")) / "lineitem.parquet"))
    return str(path)


def once(spark, sf, name, monkeypatch):
    """The query reads lineitem for one table and never in a join."""
    made, stage = [], views.staged
    monkeypatch.setattr(views, "staged", lambda d: made.append(d.inputFiles()) or stage(d))
    out = all_queries()[name](spark, sf)
    assert sum(any("lineitem" in f for f in files) for files in made) == 1
    assert not any("lineitem" in f for f in out.inputFiles())
    return out


def test_boxes_have_the_rows_of_the_oracle(spark, sf):
    odd = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM {t} UNION ALL SELECT l_orderkey-180, l_partkey-90, l_suppkey, l_linenumber, nullif(l_extendedprice, 900) FROM {t} UNION ALL SELECT NULL, NULL, 1, 2, 3.0)"
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    spark_rows, plain = (spark.sql(views.ALL["det"][k].replace("FROM lineitem", "FROM " + odd), t=t) for k in (0, 1))
    assert spark_rows.dtypes == plain.dtypes and spark_rows.count() == 1801
    assert spark_rows.exceptAll(plain).isEmpty() and plain.exceptAll(spark_rows).isEmpty()


def test_hit_counts_read_boxes_once_and_join_once(spark, sf, monkeypatch):
    out = once(spark, sf, "j10_hit_counts", monkeypatch)
    assert len(re.findall(r"Join", out._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_hit_counts_of_repeated_and_null_ids(spark):
    at = lambda x: (x, 0.0, x + 10.0, 10.0)
    gt = spark.createDataFrame([(1, "v", "a", *at(0.0)), (1, "v", "a", *at(0.0)), (1, "v", "b", *at(50.0)), (1, "v", None, *at(0.0)), (None, "v", "c", *at(0.0)), (None, "v", "c", *at(0.0))], "sheet_id long, label string, gt_id string, " + BOX)
    d = spark.createDataFrame([(1, "v", "p", 0.5, *at(1.0)), (1, "v", "q", 0.5, *at(2.0)), (1, "w", "r", 0.5, *at(0.0)), (None, "v", "s", 0.5, *at(0.0))], "sheet_id long, label string, det_id string, conf double, " + BOX)
    got = sorted((r.sheet_id or 0, r.gt_id or "", r.hits) for r in match.hit_counts(d, gt).collect())
    assert got == [(0, "c", 0), (0, "c", 0), (1, "", 0), (1, "a", 4), (1, "a", 4), (1, "b", 0)]


def test_offset_stats_read_boxes_once(spark, sf, monkeypatch):
    once(spark, sf, "m11_offset_stats", monkeypatch)


def test_failure_buckets_join_overlaps_once_in_methods_the_jvm_compiles(spark, sf):
    v = views.Views(spark, sf)
    v._tables = ("det",)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, x in off.items():
        spark.conf.set(k, x)
    try:
        run = match.failure_buckets(v.det, v.gt, v.ignore_box)._jdf.queryExecution()
        code = run.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        assert len(re.findall(r"Join", run.optimizedPlan().toString())) == 2
    finally:
        for k in off:
            spark.conf.unset(k)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # bytes, above which a method is interpreted


def test_ignored_truth_of_repeated_ids_goes(spark):
    at = lambda x: (x, 0.0, x + 10.0, 10.0)
    gt = spark.createDataFrame([(1, "a", "valve", *at(0.0)), (1, "a", "valve", *at(100.0)), (1, "b", "valve", *at(200.0)), (1, None, "valve", *at(0.0)), (1, "c", "arrow", *at(304.0))], "sheet_id long, gt_id string, label string, " + BOX)
    d = spark.createDataFrame([(1, "p", 0, 0.5, *at(0.0)), (1, "q", 0, 0.5, *at(203.0))], "sheet_id long, det_id string, cls_id int, conf double, " + BOX)
    ignore = spark.createDataFrame([(1, *at(1.0)), (1, *at(300.0))], "sheet_id long, " + BOX)
    got = {(r.gt_id, r.bucket, r.best_det) for r in match.failure_buckets(d, gt, ignore).collect()}
    assert got == {("b", "TP", "q"), (None, "A", None), ("c", "A", None)}


@pytest.mark.parametrize("name", ["t9_eval_tier", "plan_dataset_build"])
def test_tiles_read_boxes_and_sheets_once(spark, sf, monkeypatch, name):
    out = once(spark, sf, name, monkeypatch)
    # conditions on tiles are not tested on the boxes that sheets are grouped from
    assert "Aggregate [sheet_id" not in re.sub(r"Aggregate \[sheet_id#\d+L?, tile_no#\d+\]", "", out._jdf.queryExecution().optimizedPlan().toString())
