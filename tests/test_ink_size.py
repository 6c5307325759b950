"""Ink at size: neighbours as bits of tiles, frames without moving pixels by row or column, sheets dealt by the rows there are."""

import random

from checks import inkwork, views
from sheetgraph.operators import ink


def test_neighbours_are_counted_by_tile(spark):
    r = random.Random(3)
    px = {(k, r.randrange(-20, 25), r.randrange(-3, 40)) for k in (1, 2) for _ in range(700)}
    near = lambda k, x, y: sum((k, x + i, y + j) in px for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
    # pixels given twice are still one place
    d = spark.createDataFrame([*px, *list(px)[::3]], "sheet_id bigint, x bigint, y int")
    for least in (0, 3):
        got = ink.neighbour_counts(d, least=least)
        assert got.dtypes == [("sheet_id", "bigint"), ("x", "bigint"), ("y", "int"), ("neighbours", "bigint")]
        assert sorted(tuple(x) for x in got.collect()) == sorted((*p, near(*p)) for p in px if near(*p) >= least)


def test_unknown_coordinates_meet_each_other_only(spark):
    d = spark.createDataFrame([(1, None, 7), (1, None, 8), (1, 5, None), (1, None, None), (1, 5, 7)], "sheet_id bigint, x bigint, y bigint")
    got = {(x.x, x.y): x.neighbours for x in ink.neighbour_counts(d).collect()}
    assert got == {(None, 7): 5, (None, 8): 5, (5, None): 2, (None, None): 8, (5, 7): 0}


def test_pixels_do_not_move_by_row_or_column_for_the_frame(spark, capsys):
    rows = [(1, x, 5) for x in range(0, 90)] + [(1, 95, y) for y in range(0, 100, 1)] + [(1, 50, 50), (1, 50, 9), (2, 50, 9), (None, 1, 1)]
    d = spark.createDataFrame(rows, "sheet_id bigint, x bigint, y bigint")
    sheets = spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "sheet_id bigint, width int, height int")
    out = ink.drop_frame(d, sheets, 20)
    assert sorted(map(tuple, out.filter("sheet_id is not null").collect())) == [(1, 50, 50), (2, 50, 9)]
    assert out.filter("sheet_id is null").count() == 1
    out.explain()
    plan = capsys.readouterr().out
    assert "LeftAnti" not in plan


def test_sheets_are_dealt_by_the_rows_there_are(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).selectExpr("id AS l_orderkey", "id % 200 AS l_partkey", "id % 7 AS l_suppkey", "CAST(1 AS BIGINT) AS l_linenumber", "CAST(id % 900 AS DOUBLE) AS l_extendedprice")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    v = views.Views(spark, str(tmp_path))
    monkeypatch.setattr(views, "ROWS_A_TASK", 500)
    assert views.tasks(spark, str(tmp_path)) == 13
    for name in ("vertex", "framed"):
        assert getattr(v, name).rdd.getNumPartitions() == 13
    # drawn per sheet, the pixels with borders are those of the plain text
    plain = v.ink.unionByName(v.sheetid.filter("sheet_id % 3 = 0").selectExpr("sheet_id", "explode(sequence(0L, 1999L)) AS x", "CAST(10 AS BIGINT) AS y").filter("(x*7+sheet_id)%10<9"))
    plain = plain.unionByName(v.sheetid.filter("sheet_id % 3 = 1").selectExpr("sheet_id", "CAST(1985 AS BIGINT) AS x", "explode(sequence(0L, 1399L)) AS y").filter("(y*3+sheet_id)%10<9")).distinct()
    assert v.framed.exceptAll(plain).isEmpty() and plain.exceptAll(v.framed).isEmpty()
    assert inkwork.QUERIES["l5_junction_pixels"](spark, str(tmp_path)).rdd.getNumPartitions() == 13


def test_framed_pixels_are_drawn_by_compiled_columns(spark, tmp_path, capsys):
    rows = spark.range(600).selectExpr("id AS l_orderkey", "id % 200 AS l_partkey", "id % 7 AS l_suppkey", "CAST(1 AS BIGINT) AS l_linenumber", "CAST(id % 900 AS DOUBLE) AS l_extendedprice")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    views.Views(spark, str(tmp_path)).framed.explain()
    assert "lambda" not in capsys.readouterr().out
