"""Files of the exchange queries are written by many tasks, not by the driver or one task."""

import decimal
import os

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from checks import exchange
from sheetgraph.sources import labels


@pytest.fixture()
def sf(spark, tmp_path):
    rows = [(1 + i // 4, 1 + i * 37 % 200, 1 + i * 11 % 10, 1 + i % 4, decimal.Decimal(f"{900 + i * 7 % 500}.{i % 100:02d}")) for i in range(900)]
    d = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_extendedprice decimal(15,2)")
    d.repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_label_files_are_moved_by_their_tasks(spark, tmp_path, monkeypatch):
    given, option = {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, x: given.update({k: x}) or option(self, k, x))
    rows = [(f"s{i % 7}", i % 3, 0.5, 0.25, 0.1, 0.125) for i in range(40)]
    labels.write_labels(spark.createDataFrame(rows, "image string, cls_id int, xc double, yc double, bw double, bh double"), str(tmp_path / "l"))
    assert given["mapreduce.fileoutputcommitter.algorithm.version"] == "2"
    assert sorted(x for x in os.listdir(tmp_path / "l") if x.startswith("image=")) == [f"image=s{i}" for i in range(7)]
    # by more than one task, however few the lines
    assert len({f[:10] for x in os.listdir(tmp_path / "l") if x.startswith("image=") for f in os.listdir(tmp_path / "l" / x) if f.startswith("part-")}) > 1
    assert sorted(map(tuple, labels.read_labels(spark, str(tmp_path / "l")).collect())) == sorted(rows)


def test_prediction_sets_are_dealt_to_several_tasks(spark, sf, monkeypatch):
    seen, start = [], exchange.ingest.ingest
    monkeypatch.setattr(exchange.ingest, "ingest", lambda s, path, *a, **k: seen.append(path) or start(s, path, *a, **k))
    n = exchange.QUERIES["w1_stream_ingest"](spark, sf).count()
    files = {x: [f for f in os.listdir(f"{seen[0].removeprefix('file://')}/later={x}") if f.endswith(".json")] for x in ("false", "true")}
    assert len(files["false"]) == 2 and n > 0
