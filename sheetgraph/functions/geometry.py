"""Column expressions over boxes, points and angles. All take and return Columns; nothing here runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sheetgraph import params as P

c = F.col


def as_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def n_rows() -> Column:
    """Number of rows, as an aggregate."""
    return F.count(F.lit(1))


def cx(p: str = "") -> Column:
    return (c(p + "x1") + c(p + "x2")) / 2


def cy(p: str = "") -> Column:
    return (c(p + "y1") + c(p + "y2")) / 2


def width(p: str = "") -> Column:
    return c(p + "x2") - c(p + "x1")


def height(p: str = "") -> Column:
    return c(p + "y2") - c(p + "y1")


def sq(v: Column) -> Column:
    return v * v


def dist2(ax, ay, bx, by) -> Column:
    return sq(ax - bx) + sq(ay - by)


# --- detection geometry -----------------------------------------------------------------------------------------

def with_box(df, prefix: str = ""):
    """Centre, size, area, diagonal and aspect of every box."""
    w, h = width(prefix), height(prefix)
    return df.select(
        "*", cx(prefix).alias("cx"), cy(prefix).alias("cy"), w.alias("w"), h.alias("h_px"), (w * h).alias("area"),
        F.sqrt(w * w + h * h).alias("diag"), (w / F.greatest(h, F.lit(1.0))).alias("aspect"),
    )


def to_px(df, w="width", h="height"):
    """Normalised centre boxes to pixel corners."""
    half_w, half_h = c("bw") / 2, c("bh") / 2
    return df.select(
        "*", ((c("xc") - half_w) * c(w)).alias("x1"), ((c("yc") - half_h) * c(h)).alias("y1"),
        ((c("xc") + half_w) * c(w)).alias("x2"), ((c("yc") + half_h) * c(h)).alias("y2"),
    )


def to_norm(df, w="width", h="height", digits: int = 6):
    """Pixel corners to normalised centre boxes, rounded like the label text format."""
    return df.select(
        "*", F.round(cx() / c(w), digits).alias("xc"), F.round(cy() / c(h), digits).alias("yc"),
        F.round(width() / c(w), digits).alias("bw"), F.round(height() / c(h), digits).alias("bh"),
    )


def node_type(cls: Column | str = "cls_id") -> Column:
    cls = c(cls) if isinstance(cls, str) else cls
    return (
        F.when(cls.isin(P.VALVE_CLASSES), "valve").when(cls.isin(P.INSTRUMENT_CLASSES), "instrument")
        .when(cls.isin(P.ARROW_CLASSES), "flow_arrow").when(cls.isin(P.TAG_RECT_CLASSES), "tag_rect")
        .otherwise("unknown_fitting")
    )


def family(cls: Column | str = "cls_id") -> Column:
    """Suppression group: one for all valves, one for all instruments, else the class itself."""
    cls = c(cls) if isinstance(cls, str) else cls
    t = node_type(cls)
    return F.when(t.isin("valve", "instrument"), t).otherwise(cls.cast("string"))


def supercategory(cls: Column | str = "cls_id") -> Column:
    cls = c(cls) if isinstance(cls, str) else cls
    return (
        F.when(cls.isin(P.VALVE_CLASSES), 0).when(cls.isin(P.ARROW_CLASSES), 1).when(cls.isin(P.INSTRUMENT_CLASSES), 2)
    )


def label_kind(label: Column | str = "label") -> Column:
    label = c(label) if isinstance(label, str) else label
    return (
        F.when(label.isin(list(P.SCORED_LABELS)), "scored").when(label.isin(P.IGNORED_LABELS), "ignore").otherwise("drop")
    )


def dilated(margin, img_w, img_h, prefix: str = "") -> list[Column]:
    """Integer box grown by a margin and clipped to the sheet: dx1, dy1, dx2, dy2."""
    m, w, h = as_col(margin), as_col(img_w), as_col(img_h)
    i = lambda n: c(prefix + n).cast("int")
    return [
        F.greatest(F.lit(0), i("x1") - m).cast("int").alias("dx1"), F.greatest(F.lit(0), i("y1") - m).cast("int").alias("dy1"),
        F.least(w, i("x2") + m).cast("int").alias("dx2"), F.least(h, i("y2") + m).cast("int").alias("dy2"),
    ]


def near_border(x, y, img_w, img_h, margin) -> Column:
    return (x < margin) | (x >= as_col(img_w) - margin) | (y < margin) | (y >= as_col(img_h) - margin)


def box_near_edge(img_w, img_h, px=5) -> Column:
    return (c("x1") < px) | (c("y1") < px) | (c("x2") > as_col(img_w) - px) | (c("y2") > as_col(img_h) - px)


def orientation(w: Column, h: Column) -> Column:
    ar = w / F.greatest(h, F.lit(1.0))
    return F.when(ar > 1.4, "Horizontal").when(ar < 0.71, "Vertical").otherwise("Square/diagonal")


def size_bucket(w: Column, h: Column, near_edge: Column) -> Column:
    d = F.sqrt(w * w + h * h)
    return F.when((d < 8) | ((d < 15) & near_edge), "b").when(d < 30, "c").otherwise("a")


def edge_label(branch_type: Column, via: Column) -> Column:
    """Readable edge type; contracted edges have no branch type and show what they were contracted through."""
    named = P.lookup(P.EDGE_TYPE_NAMES, branch_type, branch_type.cast("string"))
    return F.when(branch_type.isNotNull(), named).otherwise(via)


def provenance(label: Column) -> Column:
    return F.when(label.isin(P.TRACED_EDGE_TYPES), "TRACED").otherwise("INFERRED")


# --- overlaps ---------------------------------------------------------------------------------------------------

def inter_area(a: str, b: str) -> Column:
    w = F.least(c(a + "x2"), c(b + "x2")) - F.greatest(c(a + "x1"), c(b + "x1"))
    h = F.least(c(a + "y2"), c(b + "y2")) - F.greatest(c(a + "y1"), c(b + "y1"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def area(p: str, floor: float) -> Column:
    return F.greatest(width(p) * height(p), F.lit(floor))


def iou(a: str, b: str) -> Column:
    i = inter_area(a, b)
    return F.when(i > 0, i / (area(a, 1e-9) + area(b, 1e-9) - i)).otherwise(0.0)


def ios(a: str, b: str) -> Column:
    """Intersection over the smaller box."""
    return inter_area(a, b) / F.least(area(a, 1e-9), area(b, 1e-9))


def overlap_frac(a: str, b: str) -> Column:
    """Share of box a inside b."""
    return inter_area(a, b) / area(a, 1e-6)


def box_gap(a: str, b: str, x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    z = F.lit(0.0)
    gx = F.greatest(z, c(a + x1) - c(b + x2), c(b + x1) - c(a + x2))
    gy = F.greatest(z, c(a + y1) - c(b + y2), c(b + y1) - c(a + y2))
    return gx, gy


# --- angles and segments ----------------------------------------------------------------------------------------

def wrap360(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


def anti_parallel_err(a: Column, b: Column) -> Column:
    """Degrees away from pointing in opposite directions."""
    d = wrap360(a - b)
    return F.abs(F.when(d > 180, 360 - d).otherwise(d) - 180)


def opposite_err(px, py, ax, ay, bx, by) -> Column:
    """Degrees away from p lying straight between a and b."""
    return F.abs(wrap360(F.degrees(F.atan2(by - py, bx - px) - F.atan2(ay - py, ax - px))) - 180)


def segment_dist2(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))
    return F.when(n == 0, dist2(px, py, ax, ay)).otherwise(dist2(px, py, ax + t * dx, ay + t * dy))
