"""Spatial joins as equi-joins on (keys, grid cell).

Joining on the sheet alone would put a whole sheet into one task and test every pair on it. Here each row is keyed by the
square cell it lies in (points) or the cells it covers (boxes), so work is split below the sheet, only near neighbours
meet, and the exact predicate is a cheap residual. Sides keep their columns; only key columns may share names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

CELL = 128
GX, GY = "__gx", "__gy"


def _cell(v: Column, cell: float) -> Column:
    return F.floor(v / F.lit(float(cell)))


def at_cell(df: DataFrame, x: Column, y: Column, cell: float = CELL) -> DataFrame:
    return df.withColumns({GX: _cell(x, cell), GY: _cell(y, cell)})


def over_cells(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, cell: float = CELL) -> DataFrame:
    """One row per cell a box covers; inverted boxes cover nothing."""
    span = lambda lo, hi: F.when(hi >= lo, F.sequence(_cell(lo, cell), _cell(hi, cell)))
    return df.withColumn(GX, F.explode(span(x1, x2))).withColumn(GY, F.explode(span(y1, y2)))


def _on(left: DataFrame, right: DataFrame, keys, residual: Column | None) -> tuple[DataFrame, Column]:
    """Right side with renamed keys, and the join condition."""
    names = [*keys, GX, GY]
    right = right.withColumnsRenamed({k: "__r_" + k for k in names})
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col("__r_" + k) for k in names])
    return right, cond if residual is None else cond & residual


def _drop(df: DataFrame, keys) -> DataFrame:
    return df.drop(GX, GY, *["__r_" + k for k in [*keys, GX, GY]])


def points_in_reach(boxes: DataFrame, box: list[Column], points: DataFrame, x: Column, y: Column, keys,
                    residual: Column | None = None, cell: float = CELL) -> DataFrame:
    """Inner join of every point with every box whose covered cells hold it; the caller gives the exact predicate."""
    left = over_cells(boxes, *box, cell)
    right, cond = _on(left, at_cell(points, x, y, cell), keys, residual)
    return _drop(left.join(right, cond), keys)


def cells_in_reach(boxes: DataFrame, box: list[Column], points: DataFrame, keys, residual: Column | None = None, cell: float = CELL) -> DataFrame:
    """`points_in_reach` for points that carry their cell already, so that rows placed by cell once are not moved again."""
    left = over_cells(boxes, *box, cell)
    right, cond = _on(left, points, keys, residual)
    return _drop(left.join(right, cond), keys)


PLACES = "__places"


def place(x: Column, y: Column) -> Column:
    """Number of a pixel within the cell it carries."""
    return ((y - F.col(GY) * CELL) * CELL + (x - F.col(GX) * CELL)).cast("smallint")


def packed(pixels: DataFrame, keys, once: bool = True) -> DataFrame:
    """Pixels (x, y) as one row per cell with the numbers of the places in it, so that two bytes a pixel move and not a row. Pixels that
    lie together by key are packed where they are. With `once` a pixel given several times is one."""
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    d = at_cell(pixels.filter("x IS NOT NULL AND y IS NOT NULL"), x, y).select(*keys, GX, GY, place(x, y).alias("p"))
    return d.groupBy(*keys, GX, GY).agg((F.array_distinct(F.collect_list("p")) if once else F.collect_list("p")).alias(PLACES))


def pixels_in_reach(boxes: DataFrame, box: list[Column], pixels: DataFrame, keys, residual: Column, keep_cell: bool = False, once: bool = True) -> DataFrame:
    """`points_in_reach` for pixels (x, y), which move packed and are spelled out where they meet the boxes."""
    kind = dict(pixels.dtypes)
    left = over_cells(boxes, *box)
    right, cond = _on(left, packed(pixels, keys, once), keys, None)
    d = left.join(right, cond).withColumn("__p", F.explode(PLACES))
    d = d.withColumns({"x": (F.col(GX) * CELL + F.col("__p").bitwiseAND(F.lit(CELL - 1))).cast(kind["x"]), "y": (F.col(GY) * CELL + F.shiftright("__p", 7)).cast(kind["y"])})
    d = d.filter(residual).drop("__p", PLACES, *["__r_" + k for k in [*keys, GX, GY]])
    return d if keep_cell else d.drop(GX, GY)


def with_boxes(points: DataFrame, boxes: DataFrame, box: list[Column], keys, residual: Column, cell: float = CELL) -> DataFrame:
    """Points that carry their cell, once per box satisfying the predicate and once without box columns where there is none."""
    right, cond = _on(points, over_cells(boxes, *box, cell), keys, residual)
    return points.join(right, cond, "left").drop(*["__r_" + k for k in [*keys, GX, GY]])


def filter_points(points: DataFrame, x: Column, y: Column, boxes: DataFrame, box: list[Column], keys,
                  residual: Column, keep: str = "left_anti", cell: float = CELL, keep_cell: bool = False) -> DataFrame:
    """Points with (`left_semi`) or without (`left_anti`) a box satisfying the predicate; with keep_cell they carry their cell from then on."""
    left = at_cell(points, x, y, cell)
    right, cond = _on(left, over_cells(boxes, *box, cell), keys, residual)
    out = left.join(right, cond, keep)
    return out if keep_cell else out.drop(GX, GY)


def boxes_meeting(a: DataFrame, abox: list[Column], b: DataFrame, bbox: list[Column], keys,
                  residual: Column | None = None, cell: float = CELL) -> DataFrame:
    """Inner join of boxes that touch or overlap, each pair once.

    Two boxes may share several cells; the pair is kept only in the cell that holds the low corner of what they share.
    """
    left, right = over_cells(a, *abox, cell), over_cells(b, *bbox, cell)
    own = (F.col(GX) == _cell(F.greatest(abox[0], bbox[0]), cell)) & (F.col(GY) == _cell(F.greatest(abox[1], bbox[1]), cell))
    meet = (abox[0] <= bbox[2]) & (bbox[0] <= abox[2]) & (abox[1] <= bbox[3]) & (bbox[1] <= abox[3])
    residual = own & meet if residual is None else own & meet & residual
    right, cond = _on(left, right, keys, residual)
    return _drop(left.join(right, cond), keys)


def prefixed(df: DataFrame, p: str, keys=()) -> DataFrame:
    return df.withColumnsRenamed({n: p + n for n in df.columns if n not in keys})
