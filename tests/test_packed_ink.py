"""Ink moves packed by cell: two bytes a pixel, not a row, with the same pixels and runs."""

import random

from pyspark.sql import functions as F

from sheetgraph.operators import ink, junctions
from sheetgraph.operators.cells import GX, GY, PLACES, packed, pixels_in_reach


def dots(r, n=3000):
    return [(k, r.randrange(-5, 300), r.randrange(-5, 260)) for k in (1, 2) for _ in range(n)]


def test_pixels_of_a_cell_are_one_row(spark):
    px = [*dots(random.Random(2)), (1, None, 4), (1, 4, None)]
    d = spark.createDataFrame(px + px[:50], "sheet_id bigint, x bigint, y int")
    rows = packed(d, ["sheet_id"])
    assert dict(rows.dtypes)[PLACES] == "array<smallint>" and rows.count() == rows.select("sheet_id", GX, GY).distinct().count()
    whole = {p for p in px if None not in p}
    assert rows.agg(F.sum(F.size(PLACES))).first()[0] == len(whole)
    box = spark.createDataFrame([(1, 0, -300.0, -300.0, 900.0, 900.0), (2, 1, 100.0, 120.0, 140.0, 131.0), (3, 2, 0.0, 0.0, 9.0, 9.0)], "sheet_id bigint, id int, x1 double, y1 double, x2 double, y2 double")
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    got = pixels_in_reach(box, [F.col(c) for c in ("x1", "y1", "x2", "y2")], d, ["sheet_id"], inside)
    assert [dict(got.dtypes)[c] for c in "xy"] == ["bigint", "int"]
    want = [(k, x, y) for k, x, y in whole if k == 1 or (100 <= x < 140 and 120 <= y < 131)]
    assert sorted((r.sheet_id, r.x, r.y) for r in got.collect()) == sorted(want)


def test_pixels_move_by_cell_only(spark, capsys):
    d = spark.createDataFrame(dots(random.Random(5)), "sheet_id bigint, x bigint, y bigint")
    seg = spark.createDataFrame([(1, 1, 3, 4, 100, 50)], "sheet_id bigint, pair_id bigint, ax bigint, ay bigint, bx bigint, by bigint")
    junctions.gap_runs(seg, d.repartition(3, "sheet_id"), 300, 260).explain()
    plan = capsys.readouterr().out
    # no shuffle by pixel; before, points and pixels met by their coordinates
    assert "hashpartitioning(sheet_id" in plan and all(", x#" not in p.split(")")[0] for p in plan.split("hashpartitioning(")[1:])


def test_gap_runs_follow_plain_walks(spark):
    r = random.Random(7)
    px = set(dots(r, 7000))
    w, h, seg = 290, 250, []
    for i in range(150):
        inside = i % 2 == 0
        end = lambda m: r.randrange(0, m) if inside else r.randrange(-30, m + 30)
        seg.append((1 + i % 3, i, end(w), end(h), end(w), end(h)))
    seg += [(1, 900, 5, 5, 5, 5), (1, 901, 10, 20, 10, 200), (1, 902, 200, 20, 10, 20), (None, 903, 1, 1, 50, 50), (1, 904, 1, None, 50, 1), seg[0], seg[2]]

    def points(ax, ay, bx, by):
        n = max(abs(bx - ax), abs(by - ay)) + 1
        step = lambda a, b: (b - a) / (n - 1) if n > 1 else 0.0
        return [(min(max(round(i * step(ax, bx) + ax), 0), w - 1), min(max(round(i * step(ay, by) + ay), 0), h - 1)) for i in range(n)]

    def run(k, i, *ends):
        times = sum(s == (k, i, *ends) for s in seg)
        best = now = 0
        for x, y in points(*ends):
            now = 0 if (k, x, y) in px else now + times
            best = max(best, now)
        return best
    want = [(s[0], s[1], 0 if s[0] is None else run(*s)) for s in seg if s[3] is not None]
    d = spark.createDataFrame(seg, "sheet_id bigint, pair_id bigint, ax bigint, ay bigint, bx bigint, by bigint")
    got = junctions.gap_runs(d, spark.createDataFrame(list(px), "sheet_id bigint, x bigint, y bigint"), w, h).collect()
    key = lambda t: (t[0] or 0, *t[1:])
    assert sorted((tuple(x) for x in got if x.pair_id != 904), key=key) == sorted(want, key=key)


def test_arrow_tips_count_repeated_pixels(spark):
    a = spark.createDataFrame([(1, "a", 0.0, 0.0, 40.0, 10.0)], "sheet_id bigint, arrow_id string, x1 double, y1 double, x2 double, y2 double")
    d = spark.createDataFrame([(1, 5, 5)] * 3 + [(1, 30, 5), (1, 31, 5)], "sheet_id bigint, x bigint, y bigint")
    assert ink.arrow_tips(a, d, 300, 260).first().tip_x == 0.0
    assert ink.arrow_tips(a, d.distinct(), 300, 260).first().tip_x == 40.0
