"""Evidence from ink pixels and traced branches: clean-up, endpoint binding and short-gap connections.

Ink is a sparse table (sheet_id, x, y); branches carry `coords`, an array of (r, c). Nodes carry their dilated integer box
dx1..dy2 next to the original one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheetgraph.functions.geometry import n_rows
from sheetgraph import params as P
from sheetgraph.functions import geometry as g, polyline
from sheetgraph.operators.cells import GX, GY, boxes_meeting, cells_in_reach, filter_points, pixels_in_reach, points_in_reach, prefixed, with_boxes
from sheetgraph.operators.components import components
from sheetgraph.operators.stage import staged
from sheetgraph.operators.suppress import SHEET

DIL = ["dx1", "dy1", "dx2", "dy2"]


def cols(names, p="") -> list[Column]:
    return [F.col(p + n) for n in names]


# --- pixel clean-up ---------------------------------------------------------------------------------------------

def otsu(hist: DataFrame, keys=SHEET) -> DataFrame:
    """Grey threshold per sheet that best separates dark from light; `hist` has grey (0-255) and n."""
    w = Window.partitionBy(*keys).orderBy("grey").rowsBetween(Window.unboundedPreceding, 0)  # at most 256 rows
    all_ = Window.partitionBy(*keys)
    d = hist.select(*keys, "grey", F.sum("n").over(w).cast("double").alias("n0"), F.sum(F.col("n") * F.col("grey")).over(w).cast("double").alias("s0"),
                    F.sum("n").over(all_).cast("double").alias("nt"), F.sum(F.col("n") * F.col("grey")).over(all_).cast("double").alias("st"))
    n1 = F.col("nt") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1
    spread = F.when(n1 > 0, F.round(F.col("n0") * n1 * gap * gap / F.col("nt"), 3)).otherwise(F.lit(-1.0))
    return d.groupBy(*keys).agg(F.max_by("grey", F.struct(spread, -F.col("grey"))).alias("threshold"))


def drop_frame(ink: DataFrame, sheets: DataFrame, search_px: int = 80, share: float = 0.75, margin: int = 6, keys=SHEET) -> DataFrame:
    """Ink without the printed border: rows and columns of the outer band that are mostly ink, with a margin around them."""
    keys = list(keys)
    band = F.greatest(F.lit(1), F.least(F.lit(search_px), F.floor(F.col("height") / 3), F.floor(F.col("width") / 3)))
    s = sheets.select(*keys, "width", "height", band.cast("bigint").alias("band"))
    # as the other reading of the ink, so that it moves once; sheets are looked up, so that no pixels are sorted
    d = ink.join(s.hint("shuffle_hash"), keys, "left")
    near = lambda at, size: (at < F.col("band")) | (at >= size - F.col("band"))
    # both axes at once: a pixel counts for its row and its column
    strip = lambda axis, length, across: F.when(near(F.col(axis), F.col(length)), F.struct(F.lit(axis).alias("axis"), F.col(axis).cast("bigint").alias("at"), F.col(length).alias("size"), F.col(across).alias("across")))
    edge = d.select(*keys, "band", F.explode(F.array_compact(F.array(strip("y", "height", "width"), strip("x", "width", "height")))).alias("s")).select(*keys, "band", "s.*")
    lines = edge.groupBy(*keys, "axis", "at", "band", "size", "across").agg(n_rows().alias("n")).filter(F.col("n") >= share * F.col("across"))
    at, size = F.col("at"), F.col("size")
    low = at < F.col("band")
    lo = F.when(low, F.greatest(F.lit(0), at - margin)).otherwise(F.greatest(size - F.col("band"), at - margin))
    hi = F.when(low, F.least(F.col("band"), at + margin + 1)).otherwise(F.least(size, at + margin + 1))
    hit = lines.select(*keys, "axis", F.explode(F.sequence(lo, hi - 1)).alias("at"))
    # no more places per sheet than the strips are wide
    on = lambda axis: F.array_sort(F.collect_set(F.when(F.col("axis") == axis, F.col("at")))).alias("__" + axis)
    hit = hit.groupBy(*keys).agg(on("x"), on("y"))
    out = ink.join(hit.hint("shuffle_hash"), keys, "left")
    clear = [F.coalesce(F.array_contains("__" + c, F.col(c).cast("bigint")), F.lit(False)) for c in "xy"]
    return out.filter(~(clear[0] | clear[1])).select(*ink.columns)


def modal_border(px: DataFrame, width: int, height: int, margin: int = 30, keys=SHEET) -> DataFrame:
    """Most frequent grey in the border strip, the darkest on ties; corner pixels count for both of their strips."""
    hits = sum(((c).cast("int") for c in (F.col("y") < margin, F.col("y") >= height - margin, F.col("x") < margin)), (F.col("x") >= width - margin).cast("int"))
    d = px.withColumn("k", hits).filter("k > 0").groupBy(*keys, "grey").agg(F.sum("k").alias("k"))
    return d.groupBy(*keys).agg(F.max_by("grey", F.struct("k", -F.col("grey"))).alias("background"))


def erase(ink: DataFrame, nodes: DataFrame, keys=SHEET) -> DataFrame:
    """Ink outside every dilated box (low side in, high side out)."""
    b = nodes.select(*keys, *DIL)
    hit = (F.col("x") >= F.col("dx1")) & (F.col("x") < F.col("dx2")) & (F.col("y") >= F.col("dy1")) & (F.col("y") < F.col("dy2"))
    return filter_points(ink, F.col("x"), F.col("y"), b, cols(DIL), list(keys), hit, "left_anti")


# --- junction pixels --------------------------------------------------------------------------------------------

TILE = 8  # pixels; one tile is the bits of a long


def _rim_bit(dx: int, dy: int, x, y):
    """Number of a place (x, y) on side (dx, dy) of a tile: the row above, the row below, then the column on the left and the one on the right."""
    wide = TILE + 2
    return x + 1 + (0 if dy < 0 else wide) if dy else y + 2 * wide + (0 if dx < 0 else TILE)


def _around(x: int, y: int) -> tuple[int, int]:
    """The neighbours of a tile's place as bits inside the tile and as bits of its rim."""
    near = [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    inside = [0 <= p < TILE and 0 <= q < TILE for p, q in near]
    own = sum(1 << (q * TILE + p) for (p, q), i in zip(near, inside) if i)
    return own, sum(1 << _rim_bit(p // TILE, q // TILE, p, q) for (p, q), i in zip(near, inside) if not i)


def neighbour_counts(ink: DataFrame, keys=SHEET, least: int = 0) -> DataFrame:
    """Ink pixels with the number of ink pixels among their eight neighbours, where that is `least` or more.

    Pixels are bits of tiles of 8 by 8. A pixel goes to its own tile and, at a tile's edge, to the rim of the up to three tiles beside
    it, 1.6 rows a pixel where ink is spread evenly; tiles with too few bits for any pixel to reach `least` go before pixels are spelled out.
    """
    keys = list(keys)
    kind = dict(ink.dtypes)
    long = lambda v: F.lit(v - (1 << 64) if v >> 63 else v).cast("bigint")
    bit = lambda n: F.call_function("shiftleft", long(1), n.cast("int"))
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    d = ink.select(*keys, F.shiftright(x, 3).alias("tx"), F.shiftright(y, 3).alias("ty"), x.bitwiseAND(long(TILE - 1)).alias("lx"), y.bitwiseAND(long(TILE - 1)).alias("ly"))
    lx, ly = F.col("lx"), F.col("ly")
    at_x, at_y = F.coalesce(lx, long(0)), F.coalesce(ly, long(0))  # pixels of an unknown coordinate are a tile of one line
    dx, dy = [F.when(c == 0, -1).when(c == TILE - 1, 1).otherwise(0) for c in (lx, ly)]  # the tile beside, if any
    d = d.withColumns({"dx": dx, "dy": dy})
    dx, dy = F.col("dx"), F.col("dy")
    mark = lambda tx, ty, own, rim: F.struct(tx.alias("tx"), ty.alias("ty"), own.alias("own"), rim.alias("rim"))
    # that tile sees the pixel at (lx - 8 dx, ly - 8 dy), on its side towards this one
    sees = lambda mx, my, n: mark(F.col("tx") + mx, F.col("ty") + my, long(0), bit(n))
    row = lambda x: F.when(dy > 0, _rim_bit(0, -1, x, 0)).otherwise(_rim_bit(0, 1, x, 0))
    own = mark(F.col("tx"), F.col("ty"), bit(at_y * TILE + at_x), long(0))
    across = sees(dx, F.lit(0), F.when(dx > 0, _rim_bit(-1, 0, 0, at_y)).otherwise(_rim_bit(1, 0, 0, at_y)))
    along, corner = sees(F.lit(0), dy, row(at_x)), sees(dx, dy, row(at_x - dx * TILE))
    marks = F.when((dx == 0) & (dy == 0), F.array(own)).when(dy == 0, F.array(own, across)).when(dx == 0, F.array(own, along)).otherwise(F.array(own, across, along, corner))
    tiles = d.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.*").groupBy(*keys, "tx", "ty").agg(F.bit_or("own").alias("own"), F.bit_or("rim").alias("rim"))
    open_ = F.col("tx").isNull() | F.col("ty").isNull()
    tiles = tiles.filter((F.col("own") != 0) & (open_ | (F.bit_count("own") + F.bit_count("rim") > least)))
    place = F.array(*[F.struct(*[long(v).alias(n) for n, v in (("bit", 1 << (q * TILE + p)), ("lx", p), ("ly", q), *zip(("own", "rim"), _around(p, q)))]) for q in range(TILE) for p in range(TILE)])
    near = lambda p: (F.bit_count(F.col("own").bitwiseAND(p["own"])) + F.bit_count(F.col("rim").bitwiseAND(p["rim"]))).cast("bigint")
    # what lies beside an unknown coordinate is unknown as well and counts as the same place
    count = lambda p: F.when(F.col("tx").isNull() & F.col("ty").isNull(), long(8)).when(open_, near(p) * 3 + 2).otherwise(near(p))
    spelled = F.transform(F.filter(place, lambda p: F.col("own").bitwiseAND(p["bit"]) != 0),
                          lambda p: F.struct((F.col("tx") * TILE + p["lx"]).cast(kind["x"]).alias("x"), (F.col("ty") * TILE + p["ly"]).cast(kind["y"]).alias("y"), count(p).alias("neighbours")))
    return tiles.select(*keys, F.explode(spelled).alias("p")).select(*keys, "p.*").filter(F.col("neighbours") >= least)


def junction_pixels(ink: DataFrame, keys=SHEET, least: int = 3) -> DataFrame:
    return neighbour_counts(ink, keys, least)


def touching_offsets(r: int) -> dict[int, int]:
    """For each row distance, the largest column distance at which two radius-r discs share or adjoin a pixel."""
    half = {dy: round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0 for dy in range(-r, r + 1)}
    reach: dict[int, int] = {}
    for a, wa in half.items():
        for b, wb in half.items():
            for near in (-1, 0, 1):
                d = abs(a - b + near)
                reach[d] = max(reach.get(d, 0), wa + wb + 1)
    return reach


def cluster(px: DataFrame, r: int = 3, keys=SHEET) -> DataFrame:
    """Junction pixels with `cluster`, the id of the group whose discs touch.

    Pixels side by side in a row always touch, so whole runs of them are joined: two runs touch where the gap between them is within
    the reach of their row distance.
    """
    keys = list(keys)
    reach = touching_offsets(r)
    far = max(reach[0], max(reach))
    row = Window.partitionBy(*keys, "y").orderBy("x")
    start = F.when(F.coalesce(F.col("x") - F.lag("x").over(row) > 1, F.lit(True)), F.col("x"))
    d = px.select(*keys, "x", "y", start.alias("start"))
    d = staged(d.select(*keys, "x", "y", F.last("start", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)).alias("x0")))
    rid = (F.col("y").cast("bigint") * (1 << 32) + F.col("x0")).alias("rid")
    runs = staged(d.groupBy(*keys, "y", "x0").agg(F.max("x").alias("x1")).select(*keys, "y", "x0", "x1", rid))
    a, b = prefixed(runs, "a_", keys), prefixed(runs, "b_", keys)
    gap = F.greatest(F.col("b_x0") - F.col("a_x1"), F.col("a_x0") - F.col("b_x1"), F.lit(0))
    close = gap <= P.lookup(reach, F.abs(F.col("a_y") - F.col("b_y")), F.lit(-1))
    around = [F.col("a_x0") - far, F.col("a_y") - far, F.col("a_x1") + far, F.col("a_y") + far]
    pairs = boxes_meeting(a, around, b, [F.col("b_x0"), F.col("b_y"), F.col("b_x1"), F.col("b_y")], keys, close & (F.col("a_rid") < F.col("b_rid")), 4 * far)
    comp = components(runs, pairs.select(*keys, F.col("a_rid").alias("u"), F.col("b_rid").alias("v")), keys, "rid")
    return d.select(*keys, "x", "y", rid).join(comp, [*keys, "rid"]).select(*keys, "x", "y", F.col("comp").alias("cluster"))


def cluster_centres(clusters: DataFrame, keys=SHEET) -> DataFrame:
    return clusters.groupBy(*keys, "cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), n_rows().alias("n_pixels"))


# --- branch ends ------------------------------------------------------------------------------------------------

def with_length(branches: DataFrame) -> DataFrame:
    """Traced length: the sum of steps along the polyline."""
    n = F.size("coords")
    step = lambda p, q: F.sqrt((g.sq(p["r"] - q["r"]) + g.sq(p["c"] - q["c"])).cast("double"))
    steps = F.zip_with(F.slice("coords", 2, F.greatest(n - 1, F.lit(0))), F.slice("coords", 1, F.greatest(n - 1, F.lit(0))), step)
    return branches.withColumn("length_px", F.aggregate(steps, F.lit(0.0), lambda s, d: s + d))


def min_length(branches: DataFrame, least: float = 15.0) -> DataFrame:
    return branches.filter(F.col("length_px") >= least)


def branch_ends(branches: DataFrame, keys=SHEET) -> DataFrame:
    """Two rows per branch: which_end, px, py and the branch type."""
    e = lambda n, i: F.struct(F.lit(n).alias("which_end"), F.element_at("coords", i)["c"].alias("px"), F.element_at("coords", i)["r"].alias("py"))
    return branches.select(*keys, "branch_id", "branch_type", F.explode(F.array(e("src", 1), e("dst", -1))).alias("e")).select(*keys, "branch_id", "branch_type", "e.*")


END = ["branch_id", "which_end"]


def bind(branches: DataFrame, nodes: DataFrame, img_w: int, img_h: int, extra: int = 5, border: int = 30, keys=SHEET) -> DataFrame:
    """Branch ends with the graph node whose dilated box holds them: nearest box edge first, then nearest centre."""
    keys = list(keys)
    ends = branch_ends(branches, keys)
    n = nodes.filter("node_type <> 'tag_rect'").select(*keys, F.col("node_id").alias("bound_node_id"), *DIL, g.cx().alias("ncx"), g.cy().alias("ncy"))
    px, py = F.col("px"), F.col("py")
    zone = [F.col("dx1") - extra, F.col("dy1") - extra, F.col("dx2") + extra, F.col("dy2") + extra]
    inside = (px >= zone[0]) & (px <= zone[2]) & (py >= zone[1]) & (py <= zone[3])
    hit = points_in_reach(n, zone, ends, px, py, keys, inside)
    ex, ey = F.greatest(F.col("dx1") - px, F.lit(0), px - F.col("dx2")), F.greatest(F.col("dy1") - py, F.lit(0), py - F.col("dy2"))
    rank = F.struct((ex * ex + ey * ey).alias("e"), g.dist2(px, py, F.col("ncx"), F.col("ncy")).alias("c"), "bound_node_id")
    best = hit.groupBy(*keys, *END).agg(F.min(rank).alias("b"), n_rows().alias("k")).select(*keys, *END, "b.bound_node_id", (F.col("k") > 1).alias("contested"))
    out = ends.join(best, [*keys, *END], "left").withColumn("contested", F.coalesce("contested", F.lit(False)))
    return out.withColumn("is_off_page", F.col("bound_node_id").isNull() & g.near_border(px, py, img_w, img_h, border))


def ports(ep: DataFrame, keys=SHEET) -> DataFrame:
    """Bound end points per node."""
    p = F.sort_array(F.collect_set(F.struct("branch_id", "which_end", "px", "py")))
    return ep.filter("bound_node_id is not null").groupBy(*keys, F.col("bound_node_id").alias("node_id")).agg(p.alias("ports"))


def off_page(ep: DataFrame, nodes: DataFrame, snap: int = 20, keys=SHEET) -> tuple[DataFrame, DataFrame]:
    """Border nodes for unbound ends at the sheet edge, one per snap cell; and the ends with those nodes bound.

    Cells lie in a narrow border strip, so their number per sheet is limited by the page size.
    """
    keys = list(keys)
    key = [F.bround(F.col(c) / snap).cast("bigint").alias("k" + c) for c in ("px", "py")]
    order = F.struct("branch_id", F.col("which_end") == "dst")
    open_ = ep.filter("is_off_page").select(*keys, *END, "px", "py", *key)
    cells = open_.groupBy(*keys, "kpx", "kpy").agg(F.min(order).alias("o"), F.min_by(F.struct("px", "py"), order).alias("p"))
    w = Window.partitionBy(*keys).orderBy("o")
    last = nodes.groupBy(*keys).agg(F.max("node_id").alias("last"))
    ids = cells.withColumn("i", F.row_number().over(w)).join(last, keys, "left")\
        .select(*keys, "kpx", "kpy", "p.px", "p.py", (F.coalesce("last", F.lit(-1)) + F.col("i")).alias("node_id"))
    made = ids.select(*keys, "node_id", F.lit("off_page").alias("node_type"), *[(F.col(c) + o).cast("double").alias(n) for n, c, o in
                      (("x1", "px", -4), ("y1", "py", -4), ("x2", "px", 4), ("y2", "py", 4))])
    own = open_.join(ids.drop("px", "py"), [*keys, "kpx", "kpy"]).select(*keys, *END, F.col("node_id").alias("op_id"))
    bound = ep.join(own, [*keys, *END], "left").withColumn("bound_node_id", F.coalesce("bound_node_id", "op_id")).drop("op_id")
    return made, bound


def audit_tips(ep: DataFrame, nodes: DataFrame, extra: int = 5, keys=SHEET) -> DataFrame:
    """Free tips that bound to nothing: a no node within twice the zone, b the nearest has no port, c it has one already."""
    keys = list(keys)
    tips = ep.filter("bound_node_id is null and not is_off_page and branch_type in (0, 1)")
    used = ep.filter("bound_node_id is not null").select(*keys, F.col("bound_node_id").alias("near_id")).distinct().withColumn("has_port", F.lit(True))
    z, px, py = 2 * extra, F.col("px"), F.col("py")
    n = nodes.filter("node_type <> 'tag_rect'").select(*keys, F.col("node_id").alias("near_id"), *DIL, g.cx().alias("ncx"), g.cy().alias("ncy"))
    zone = [F.col("dx1") - z, F.col("dy1") - z, F.col("dx2") + z, F.col("dy2") + z]
    inside = (px >= zone[0]) & (px <= zone[2]) & (py >= zone[1]) & (py <= zone[3])
    hit = points_in_reach(n, zone, tips, px, py, keys, inside)
    best = hit.groupBy(*keys, *END).agg(F.min(F.struct(g.dist2(px, py, F.col("ncx"), F.col("ncy")).alias("d2"), "near_id")).alias("b")).select(*keys, *END, "b.near_id")
    out = tips.select(*keys, *END).join(best, [*keys, *END], "left").join(used, [*keys, "near_id"], "left")
    return out.withColumn("bucket", F.when(F.col("near_id").isNull(), "a").when(F.col("has_port"), "c").otherwise("b")).drop("has_port")


def stub_dirs(ep: DataFrame, branches: DataFrame, k: int = 5, keys=SHEET) -> DataFrame:
    """Branch ends with the unit vector (sx, sy) pointing into the branch and its angle `inward` in degrees."""
    d = ep.join(branches.select(*keys, "branch_id", "coords"), [*keys, "branch_id"])
    dx, dy = polyline.inward(F.col("coords"), F.col("which_end"), k)
    sx, sy = polyline.unit(dx, dy)
    return d.withColumns({"sx": sx, "sy": sy, "inward": polyline.angle_deg(dx, dy)}).drop("coords")


# --- short gaps -------------------------------------------------------------------------------------------------

def gap_pairs(nodes: DataFrame, max_px: float = 50.0, keys=SHEET) -> DataFrame:
    """Pairs of graph nodes (a_id < b_id) whose dilated boxes are at most max_px apart, with both boxes and centres."""
    keys = list(keys)
    n = nodes.filter("node_type <> 'tag_rect'").select(*keys, F.col("node_id").alias("id"), *P.BOX, *DIL, g.cx().alias("cx"), g.cy().alias("cy"))
    a, b = prefixed(n, "a_", keys), prefixed(n, "b_", keys)
    gx, gy = g.box_gap("a_", "b_", *DIL)
    m = F.lit(float(max_px))
    abox = [F.col("a_dx1") - m, F.col("a_dy1") - m, F.col("a_dx2") + m, F.col("a_dy2") + m]
    return boxes_meeting(a, abox, b, cols(DIL, "b_"), keys, (F.col("a_id") < F.col("b_id")) & (gx * gx + gy * gy <= max_px * max_px))


PAIR = ["a_id", "b_id"]


def drop_interposed(pairs: DataFrame, nodes: DataFrame, tol: float = 20.0, keys=SHEET) -> DataFrame:
    """Pairs without a third graph node lying between them on the straight line."""
    keys = list(keys)
    n = nodes.filter("node_type <> 'tag_rect'").select(*keys, F.col("node_id").alias("c_id"), g.cx().alias("ccx"), g.cy().alias("ccy"))
    seg = pairs.select(*keys, *PAIR, "a_cx", "a_cy", "b_cx", "b_cy")
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    len2 = dx * dx + dy * dy
    ox, oy = F.col("ccx") - F.col("a_cx"), F.col("ccy") - F.col("a_cy")
    t = (ox * dx + oy * dy) / len2
    between = (len2 >= 1) & (t >= 0.15) & (t <= 0.85) & (g.sq(oy * dx - ox * dy) <= tol * tol * len2)
    between = between & (F.col("c_id") != F.col("a_id")) & (F.col("c_id") != F.col("b_id"))
    box = [F.least("a_cx", "b_cx") - tol, F.least("a_cy", "b_cy") - tol, F.greatest("a_cx", "b_cx") + tol, F.greatest("a_cy", "b_cy") + tol]
    hit = points_in_reach(seg.filter(len2 >= 1), box, n, F.col("ccx"), F.col("ccy"), keys, between)
    return pairs.join(hit.select(*keys, *PAIR).distinct(), [*keys, *PAIR], "left_anti")


def covered(px: DataFrame, nodes: DataFrame, box=DIL, keys=SHEET) -> DataFrame:
    """Pixels with how many node boxes hold each and the lowest and highest of their ids.

    That is enough to tell whether a node other than two given ones covers the pixel, without listing nodes per pair. Equal boxes
    are one row with a number.
    """
    keys, m = list(keys), ["m" + c for c in box]
    b = nodes.select(*keys, "node_id", *[F.col(c).cast("int").alias("m" + c) for c in box])
    b = b.groupBy(*keys, *m).agg(n_rows().alias("times"), F.min("node_id").alias("lo_id"), F.max("node_id").alias("hi_id"))
    x1, y1, x2, y2 = cols(m)
    inside = (F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2)
    return with_boxes(px, b, cols(m), keys, inside).groupBy(*keys, GX, GY, "x", "y").agg(
        F.sum("times").alias("n_cov"), F.min("lo_id").alias("cov_lo"), F.max("hi_id").alias("cov_hi"))


def in_third() -> Column:
    own = lambda c: F.col(c).isin(F.col("a_id"), F.col("b_id"))
    return F.coalesce((F.col("n_cov") > 2) | ~own("cov_lo") | ~own("cov_hi"), F.lit(False))


def touching() -> Column:
    gx, gy = g.box_gap("a_", "b_")
    return (gx == 0) & (gy == 0)


REGION = ["rx1", "ry1", "rx2", "ry2"]


def regions(pairs: DataFrame, img_w: int, img_h: int, margin: Column) -> DataFrame:
    """Pairs with the part of the sheet around both boxes."""
    lo = lambda c: F.greatest(F.lit(0), F.least("a_" + c, "b_" + c).cast("int") - margin)
    hi = lambda c, m: F.least(F.lit(m), F.greatest("a_" + c, "b_" + c).cast("int") + margin)
    return pairs.withColumns({"rx1": lo("x1"), "ry1": lo("y1"), "rx2": hi("x2", img_w), "ry2": hi("y2", img_h)})


def _in_region() -> Column:
    """Whether the pixel lies in the region of the pair and outside both its boxes."""
    i = lambda c: F.col(c).cast("int")
    own = lambda n: (F.col("x") >= i(n + "_x1")) & (F.col("x") < i(n + "_x2")) & (F.col("y") >= i(n + "_y1")) & (F.col("y") < i(n + "_y2"))
    inside = (F.col("x") >= F.col("rx1")) & (F.col("x") < F.col("rx2")) & (F.col("y") >= F.col("ry1")) & (F.col("y") < F.col("ry2"))
    return inside & ~own("a") & ~own("b")


def near_pixels(areas: DataFrame, ink: DataFrame, keys=SHEET) -> DataFrame:
    """Distinct pixels some pair (of `regions`) looks at, with their cells. Ink moves once, packed by cell; all the rest stays in the sheet outside."""
    keys = list(keys)
    d = pixels_in_reach(areas, cols(REGION), ink.select(*keys, "x", "y"), keys, _in_region(), keep_cell=True)
    return d.select(*keys, "x", "y", GX, GY).distinct()


def pair_ink(areas: DataFrame, px: DataFrame, keys=SHEET) -> DataFrame:
    """Each pair (of `regions`) with the pixels (of `near_pixels`) it looks at."""
    return cells_in_reach(areas, cols(REGION), px, list(keys), _in_region())


def corridor(pairs: DataFrame, ink: DataFrame, nodes: DataFrame, img_w: int, img_h: int, half: float = 10.0, mask_third: bool = True,
             touch_margin: int = 10, keys=SHEET, third: bool = True) -> DataFrame:
    """What the ink says about each pair: n_ink, n_corr, extent, bins, n_bins, n_wider and the share inside third nodes.

    Touching pairs look at a wider margin; for them only n_ink matters. With mask_third, ink under other nodes is left out; with
    neither that nor `third` the boxes of other nodes are not looked at and the share is NULL.

    Ink is cut to the regions of the pairs first. What is left meets the pairs by cell twice: for the two ends of each stripe, then for
    its bins, kept as bits of 64 bins a word. Both times rows are added up before they leave the cell, so no list or window of a
    pair's pixels exists.
    """
    keys = list(keys)
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    size = F.sqrt(dx * dx + dy * dy)
    narrow = [*keys, *PAIR, *[n + "_" + c for n in "ab" for c in [*P.BOX, "cx", "cy"]]]
    margin = F.when(touching(), touch_margin).otherwise(2)
    # pairs and their pixels are read twice below
    lines = staged(regions(pairs.select(*narrow).withColumn("seg", size), img_w, img_h, margin))
    px = near_pixels(lines, ink, keys)
    if mask_third or third:
        px = covered(px, nodes.filter("node_type <> 'flow_arrow'"), DIL if mask_third else P.BOX, keys)
    px = staged(px)
    seg, ox, oy = F.col("seg"), F.col("x") - F.col("a_cx"), F.col("y") - F.col("a_cy")
    ux, uy = F.when(seg >= 1, dx / seg).otherwise(1.0), F.when(seg >= 1, dy / seg).otherwise(0.0)

    def placed(lines):
        d = pair_ink(lines, px, keys)
        d = d.withColumn("third", in_third() if mask_third or third else F.lit(None).cast("boolean"))
        d = d.filter(~F.col("third")) if mask_third else d
        return d.withColumns({"along": ox * ux + oy * uy, "off": F.abs(oy * ux - ox * uy)})

    core = F.col("off") <= half
    ends = placed(lines).groupBy(*keys, *PAIR).agg(
        n_rows().alias("n_ink"), F.max("seg").alias("seg"), F.count_if(core).alias("n_corr"), F.min(F.when(core, F.col("along"))).alias("lo"),
        F.max(F.when(core, F.col("along"))).alias("hi"), F.avg(F.when(core, F.col("third").cast("double"))).alias("third_share"))
    ends = staged(ends)
    striped = lines.join(ends.filter("n_corr > 0").select(*keys, *PAIR, "lo", "hi"), [*keys, *PAIR])
    d = placed(striped).filter((F.col("off") <= half * 3) & F.col("along").between(F.col("lo"), F.col("hi")))
    bin_ = F.floor((F.col("along") - F.col("lo")) / 2)
    # one in two's complement, so that the last bit of a word is a bit like the others
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (bin_ % 64).cast("int"))
    words = d.groupBy(*keys, *PAIR, F.when(core, F.floor(bin_ / 64)).alias("word")).agg(F.bit_or(F.when(core, bit)).alias("word_bits"), F.count_if(~core).alias("wider"))
    bins = words.groupBy(*keys, *PAIR).agg(F.sum(F.bit_count("word_bits")).cast("int").alias("bins"), F.sum("wider").alias("n_wider"))
    extent = F.col("hi") - F.col("lo")
    out = ends.join(bins, [*keys, *PAIR], "left").withColumns({"extent": extent, "bins": F.coalesce("bins", F.lit(0)), "n_wider": F.coalesce("n_wider", F.lit(0))}).drop("lo", "hi")
    return out.withColumn("n_bins", F.greatest(F.lit(1), F.floor(F.col("extent") / 2)))


def corridor_ok(continuity: float = 0.5, perp_ratio: float = 3.0) -> Column:
    """Whether the ink of a pair with a gap forms one straight stripe between its nodes."""
    c = F.col
    return F.coalesce(
        F.when(c("n_ink") == 0, False).when(c("seg") < 1, True).when(c("n_corr") == 0, False).when(c("extent") < 2, True)
        .when(c("bins") / c("n_bins") < continuity, False).when(c("n_wider") > c("n_corr") * perp_ratio, False).otherwise(True), F.lit(False))


def with_ink(pairs: DataFrame, ink: DataFrame, nodes: DataFrame, img_w: int, img_h: int, p: P.SheetParams = P.SheetParams(), keys=SHEET) -> DataFrame:
    """Pairs joined by ink: a stripe across the gap, or any mark beside two touching boxes."""
    keys = list(keys)

    def passing(d, mask):
        e = corridor(d, ink, nodes, img_w, img_h, p.corridor_half_width_px, mask, p.touch_margin_px, keys, third=False)
        d = d.join(e, [*keys, *PAIR]).withColumn("touch", touching())
        ok = F.when(F.col("touch"), F.col("n_ink") > 0).otherwise(corridor_ok(p.corridor_continuity_frac, p.corridor_perp_reject_ratio))
        return d.filter(ok).select(*keys, *PAIR)

    good = passing(pairs, p.mask_all_nodes)
    if p.mask_all_nodes and p.mask_all_nodes_fallback:
        good = good.unionByName(passing(pairs, False)).distinct()
    return pairs.join(good, [*keys, *PAIR], "left_semi")


def any_path(pairs: DataFrame, ink: DataFrame, img_w: int, img_h: int, keys=SHEET) -> DataFrame:
    """Pairs whose boxes touch, or with any ink between them."""
    # a pair needs one pixel only, so its pixels are folded where they are found
    areas = regions(pairs.filter(~touching()), img_w, img_h, F.lit(2))
    hit = pixels_in_reach(areas, cols(REGION), ink.select(*keys, "x", "y"), keys, _in_region()).select(*keys, *PAIR).distinct()
    apart = pairs.filter(~touching()).join(hit, [*keys, *PAIR], "left_semi")
    return pairs.filter(touching()).unionByName(apart)


def stub_class(pairs: DataFrame, stubs: DataFrame, tol: float = 55.0, keys=SHEET) -> DataFrame:
    """Pairs with what the stubs of either node say about the other: toward, perpendicular, away or NULL; and `stub_ok`.

    `stubs` has bound_node_id, sx, sy. A pair fails when no stub points at the partner and one stands across.
    """
    keys = list(keys)
    toward, away = math.cos(math.radians(tol)), math.cos(math.radians(180.0 - tol))
    s = stubs.filter("bound_node_id is not null and (sx <> 0 or sy <> 0)").select(*keys, F.col("bound_node_id").alias("n"), "sx", "sy")

    def side(me, other):
        dx, dy = F.col(other + "_cx") - F.col(me + "_cx"), F.col(other + "_cy") - F.col(me + "_cy")
        size = F.sqrt(dx * dx + dy * dy)
        d = pairs.filter(size >= 1).select(*keys, *PAIR, F.col(me + "_id").alias("n"), (dx / size).alias("tx"), (dy / size).alias("ty")).join(s, [*keys, "n"])
        dot = F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty")
        cls = F.when(F.bool_or(dot >= toward), "toward").when(F.bool_or(dot > away), "perpendicular").otherwise("away")
        return d.groupBy(*keys, *PAIR).agg(cls.alias(me + "_stub"))

    out = pairs.join(side("a", "b"), [*keys, *PAIR], "left").join(side("b", "a"), [*keys, *PAIR], "left")
    is_ = lambda v: F.coalesce(F.col("a_stub") == v, F.lit(False)) | F.coalesce(F.col("b_stub") == v, F.lit(False))
    return out.withColumn("stub_ok", is_("toward") | ~is_("perpendicular"))


def short_gap_pairs(nodes: DataFrame, ink: DataFrame, img_w: int, img_h: int, stubs: DataFrame | None = None,
                    p: P.SheetParams = P.SheetParams(), keys=SHEET) -> DataFrame:
    """Node pairs whose connecting pipe fell to erasure: near, nothing between, joined by ink, not contradicted by stubs."""
    d = drop_interposed(gap_pairs(nodes, p.short_gap_max_px, keys), nodes, p.short_gap_interpose_tol_px, keys)
    d = with_ink(d, ink, nodes, img_w, img_h, p, keys)
    if stubs is not None:
        d = stub_class(d, stubs, p.stub_angle_tol_deg, keys).filter("stub_ok")
    return d.select(*keys, *PAIR)


def arrow_tips(arrows: DataFrame, dark: DataFrame, img_w: int, img_h: int, keys=SHEET) -> DataFrame:
    """Tip of each arrow (arrow_id, box): the end of its long axis with more dark pixels, low side on ties."""
    keys = list(keys)
    i = lambda c: F.col(c).cast("int")
    a = arrows.select(*keys, "arrow_id", *[i(c).alias(c) for c in P.BOX], g.cx().alias("acx"), g.cy().alias("acy"))
    a = a.withColumns({"qx1": F.greatest(F.lit(0), F.col("x1")), "qy1": F.greatest(F.lit(0), F.col("y1")), "qx2": F.least(F.lit(img_w), F.col("x2")), "qy2": F.least(F.lit(img_h), F.col("y2"))})
    rw, rh = F.col("qx2") - F.col("qx1"), F.col("qy2") - F.col("qy1")
    flat = rw >= rh
    kx, ky = F.col("x"), F.col("y")
    inside = (kx >= F.col("qx1")) & (kx < F.col("qx2")) & (ky >= F.col("qy1")) & (ky < F.col("qy2"))
    hit = pixels_in_reach(a, cols(["qx1", "qy1", "qx2", "qy2"]), dark.select(*keys, "x", "y"), keys, inside, once=False)
    far = F.when(flat, kx >= F.col("qx1") + F.floor(rw / 2)).otherwise(ky >= F.col("qy1") + F.floor(rh / 2))
    n = hit.groupBy(*keys, "arrow_id").agg((F.count_if(far) > F.count_if(~far)).alias("high"))
    d = a.join(n, [*keys, "arrow_id"], "left").withColumn("high", F.coalesce("high", F.lit(False)))
    none = (rw <= 0) | (rh <= 0)
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    tx = F.when(none, F.col("acx")).when(flat, F.when(F.col("high"), F.col("x2")).otherwise(F.col("x1"))).otherwise(mx)
    ty = F.when(none, F.col("acy")).when(flat, my).otherwise(F.when(F.col("high"), F.col("y2")).otherwise(F.col("y1")))
    return d.select(*keys, "arrow_id", tx.cast("double").alias("tip_x"), ty.cast("double").alias("tip_y"))


def short_stubs(branches: DataFrame, ep: DataFrame, nodes: DataFrame, least: float = 15.0, keys=SHEET) -> DataFrame:
    """Branches shorter than twice the minimum that are bound to a valve or instrument, per sheet."""
    keys = list(keys)
    scored = nodes.filter("node_type in ('valve', 'instrument')").select(*keys, F.col("node_id").alias("bound_node_id"))
    ids = ep.join(scored, [*keys, "bound_node_id"], "left_semi").select(*keys, "branch_id").distinct()
    return branches.filter(F.col("length_px") < 2 * least).join(ids, [*keys, "branch_id"], "left_semi").groupBy(*keys).agg(n_rows().alias("n_short_stubs"))
