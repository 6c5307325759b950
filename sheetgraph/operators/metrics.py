"""Detection metrics, error statistics and table summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheetgraph.functions.geometry import n_rows
from sheetgraph import params as P
from sheetgraph.functions import geometry as g
from sheetgraph.operators.match import greedy_center, greedy_iou
from sheetgraph.operators.ranking import best_from_here, quantiles, running, sliced
from sheetgraph.operators.stage import staged
from sheetgraph.operators.suppress import SHEET


def flagged(d: DataFrame, matches: DataFrame, keys=("sheet_id", "cls")) -> DataFrame:
    """Detections with `tp` from a one-to-one matching."""
    m = matches.select(*keys, "det_id").withColumn("tp", F.lit(1))
    return d.join(m, [*keys, "det_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))


def ap(scored: DataFrame, n_gt: DataFrame, by=("cls",), tie=("det_id", *SHEET)) -> DataFrame:
    """Average precision under the falling precision envelope, per `by`.

    scored: one row per detection with conf, tp (0/1) and the `tie` columns, in whose order detections of equal confidence count;
    n_gt: ground-truth count per `by`. Without ground truth the result is NULL, without detections 0. Detections are added up per
    confidence before any ordering; only confidences shared by true and false ones are ordered row by row.
    """
    return _ap_steps(scored.select(*by, "conf", F.struct(*tie).alias("tie"), "tp", F.lit(1).alias("one")), n_gt, list(by))


def gt_counts(gt: DataFrame, by=("cls",)) -> DataFrame:
    return gt.groupBy(*by).agg(n_rows().alias("n_gt"))


def ap_at(d: DataFrame, gt: DataFrame, thresholds, keys=SHEET, cls="cls") -> DataFrame:
    """AP per class and IoU threshold; all thresholds are matched in one pass."""
    thr = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("thr")
    m = greedy_iou(d, gt, list(thresholds), keys, cls)
    tie = F.struct("det_id", *keys).alias("tie")
    # a match adds to its detection's row below, so detections and matches are not joined per threshold
    hits = m.join(d.select(*keys, cls, "det_id", "conf"), [*keys, cls, "det_id"]).select(cls, "thr", "conf", tie, F.lit(1).alias("tp"), F.lit(0).alias("one"))
    rows = d.select(cls, thr, "conf", tie, F.lit(0).alias("tp"), F.lit(1).alias("one")).unionByName(hits)
    counts = gt_counts(gt, (cls,)).select(cls, "n_gt", thr)
    return _ap_steps(rows, counts, [cls, "thr"])


def _ap_steps(rows: DataFrame, n_gt: DataFrame, by: list[str]) -> DataFrame:
    """The curve from rows that add `tp` true and `one` detections at their confidence and place in its tie.

    A confidence of only true or only false detections is one step of the curve, since within it the order says nothing. The others
    are steps of one detection each.
    """
    sums = [F.sum("tp").alias("t"), F.sum("one").alias("n")]
    per_conf = staged(rows.groupBy(*by, "conf").agg(*sums))
    mixed = (F.col("t") > 0) & (F.col("t") < F.col("n"))
    same = [F.col(c).eqNullSafe(F.col("m_" + c)) for c in [*by, "conf"]]
    apart = rows.join(per_conf.filter(mixed).select(*[F.col(c).alias("m_" + c) for c in [*by, "conf"]]), same, "left_semi")
    steps = per_conf.filter(~mixed).unionByName(apart.groupBy(*by, "conf", "tie").agg(*sums), allowMissingColumns=True)
    down = [F.desc("conf"), F.asc("tie")]
    steps = sliced(steps, by, down)
    curve = running(steps, by, F.col("slice"), down, {"tp_sum": F.col("t"), "n_sum": F.col("n")})
    # precision right after the true detections of a step, its highest point
    curve = curve.withColumn("precision", F.when(F.col("t") > 0, F.col("tp_sum") / F.col("n_sum")))
    curve = best_from_here(curve, by, F.col("slice"), down, F.col("precision"), "envelope")
    area = curve.groupBy(*by).agg(F.sum(F.col("t") * F.col("envelope")).alias("area"), F.sum("t").alias("n_tp"), F.sum("n").alias("n_pred"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = F.when(zero("n_gt") > 0, F.coalesce(F.col("area"), F.lit(0.0)) / F.col("n_gt"))
    return n_gt.join(area, by, "full").select(*by, zero("n_gt").alias("n_gt"), zero("n_pred").alias("n_pred"), zero("n_tp").alias("n_tp"), value.alias("ap"))


def ap_range(d: DataFrame, gt: DataFrame, thresholds=P.AP_THRESHOLDS, keys=SHEET, cls="cls") -> DataFrame:
    """Mean AP over the thresholds, undefined ones left out."""
    return ap_at(d, gt, thresholds, keys, cls).groupBy(cls).agg(F.avg("ap").alias("ap50_95"), F.max(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("ap50"))


def per_class(ap_table: DataFrame, baseline: DataFrame, drop: float = 0.1) -> DataFrame:
    """Classes, worst first, with the recorded baseline, the change and a flag for a large drop."""
    b = baseline.select("cls", F.col("ap50").alias("base"))
    d = ap_table.join(b, "cls", "left").withColumn("delta", F.col("ap") - F.col("base"))
    flag = F.when(F.col("base").isNull(), "not recorded").when(F.col("delta") < -drop, "DROP").otherwise("")
    return d.withColumn("flag", flag).orderBy(F.asc_nulls_first("ap"), "cls")


def group_baseline(members: DataFrame, baseline: DataFrame, by="super") -> DataFrame:
    """Mean recorded AP over the classes of each group, with how many of them are recorded."""
    return members.join(baseline.select("cls", "ap50"), "cls", "left").groupBy(by).agg(
        F.avg("ap50").alias("mean_ap50"), F.count("ap50").alias("n_recorded"), n_rows().alias("n_total"))


def extended(d: DataFrame, gt: DataFrame, keys=SHEET, cls="cls") -> DataFrame:
    """Per class: counts, precision, recall, AP at 0.5 and 0.3, centre match at a quarter and half of the symbol size."""
    aps = ap_at(d, gt, [0.5, 0.3], keys, cls).groupBy(cls).agg(
        F.max("n_gt").alias("n_gt"), F.max("n_pred").alias("n_pred"), F.max(F.when(F.col("thr") == 0.5, F.col("n_tp"))).alias("n_tp"),
        F.max(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("ap50"), F.max(F.when(F.col("thr") == 0.3, F.col("ap"))).alias("ap30"))
    center = lambda f, n: greedy_center(d, gt, f, "gt", True, "side", [*keys, cls]).groupBy(cls).agg(n_rows().alias(n))
    out = aps.join(center(0.25, "c25"), cls, "left").join(center(0.5, "c50"), cls, "left")
    share = lambda n, of: F.when(F.col(of) > 0, F.coalesce(F.col(n), F.lit(0)) / F.col(of)).otherwise(0.0)
    return out.select(cls, "n_gt", "n_tp", share("n_tp", "n_gt").alias("recall"), share("n_tp", "n_pred").alias("precision"), "ap50", "ap30",
                      share("c25", "n_gt").alias("center25"), share("c50", "n_gt").alias("center50"))


def compare_runs(a: DataFrame, b: DataFrame, cls="cls", value="ap") -> DataFrame:
    """Per-class change between two runs; NULL where either side is undefined."""
    return a.select(cls, F.col(value).alias("before")).join(b.select(cls, F.col(value).alias("after")), cls, "full")\
        .withColumn("delta", F.col("after") - F.col("before"))


def class_counts(labels: DataFrame, taxonomy: DataFrame, cls="cls_id") -> DataFrame:
    """Instances per class, classes without any included, and the largest-to-smallest ratio over present classes."""
    c = labels.groupBy(cls).agg(n_rows().alias("n"))
    full = taxonomy.select(cls).join(c, cls, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ratio = full.filter("n > 0").agg((F.max("n") / F.min("n")).alias("imbalance"))
    return full.crossJoin(F.broadcast(ratio))  # a single row


def image_stats(images: DataFrame, boxes: DataFrame, keys=SHEET) -> DataFrame:
    """Min, median and max of width, height and boxes per image; images without boxes count as zero."""
    n = boxes.groupBy(*keys).agg(n_rows().alias("n_boxes"))
    d = images.join(n, list(keys), "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))
    long = d.select(F.expr("stack(3, 'width', double(width), 'height', double(height), 'boxes', double(n_boxes)) as (metric, val)"))
    return quantiles(long, ["metric"], F.col("val"), {"min": 0.0, "median": 0.5, "max": 1.0})


def box_sizes(boxes: DataFrame) -> DataFrame:
    """p10, median, p90 and max of box sides in pixels, and the tile size they suggest (four times p90)."""
    long = boxes.select(F.explode(F.array(F.struct(F.lit("w").alias("side"), g.width().alias("val")), F.struct(F.lit("h").alias("side"), g.height().alias("val")))).alias("x")).select("x.*")
    q = quantiles(long, ["side"], F.col("val"), {"p10": 0.1, "median": 0.5, "p90": 0.9, "max": 1.0})
    return q.withColumn("tile", F.col("p90") * 4)


def class_sizes(boxes: DataFrame, cls="cls_id") -> DataFrame:
    """Instances and median sides per class."""
    w = quantiles(boxes, [cls], g.width(), {"median_w": 0.5})
    h = quantiles(boxes, [cls], g.height(), {"median_h": 0.5}).drop("n")
    return w.join(h, cls)


def offset_stats(pairs: DataFrame, by=()) -> DataFrame:
    """Localisation errors of (p_, g_) box pairs: centre offsets over the true size and area ratio, one row per metric."""
    one = F.lit(1.0)
    metrics = {
        "dx": (g.cx("p_") - g.cx("g_")) / F.greatest(g.width("g_"), one), "dy": (g.cy("p_") - g.cy("g_")) / F.greatest(g.height("g_"), one),
        "area_ratio": g.width("p_") * g.height("p_") / F.greatest(g.width("g_") * g.height("g_"), one),
    }
    rows = pairs.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("val")) for k, v in metrics.items()])).alias("x"))\
        .select(*by, "x.*")
    rows, keys = staged(rows), [*by, "metric"]
    q = quantiles(rows, keys, F.col("val"), {"p25": 0.25, "median": 0.5, "p75": 0.75, "min": 0.0, "max": 1.0})
    within = F.avg((F.abs("val") <= 0.25).cast("double")).alias("within")
    return q.join(rows.groupBy(*keys).agg(F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"), within), keys)


INSETS = ["left_inset", "right_inset", "top_inset", "bottom_inset"]


def inset_pairs(pairs: DataFrame) -> DataFrame:
    """Size ratios of matched (p_, g_) boxes and how far each predicted edge lies inside the true one."""
    c = F.col
    d = pairs.select(
        "*", (g.width("p_") / g.width("g_")).alias("width_ratio"), (g.height("p_") / g.height("g_")).alias("height_ratio"),
        (g.width("p_") * g.height("p_") / (g.width("g_") * g.height("g_"))).alias("area_ratio"),
        (c("p_x1") - c("g_x1")).alias("left_inset"), (c("g_x2") - c("p_x2")).alias("right_inset"),
        (c("p_y1") - c("g_y1")).alias("top_inset"), (c("g_y2") - c("p_y2")).alias("bottom_inset"))
    return d.withColumn("worst_inset", F.greatest(*INSETS))


def inset_stats(d: DataFrame) -> DataFrame:
    """Median and nearest-rank quartiles of every ratio and inset."""
    names = ["area_ratio", "width_ratio", "height_ratio", *INSETS, "worst_inset"]
    rows = d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("val")) for n in names])).alias("x")).select("x.*")
    q = quantiles(rows, ["metric"], F.col("val"), {"p25": 0.25, "p75": 0.75, "min": 0.0, "max": 1.0}, "nearest")
    return q.join(quantiles(rows, ["metric"], F.col("val"), {"median": 0.5}).drop("n"), "metric")


def worst_pairs(d: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs with the largest inset on any edge."""
    return d.orderBy(F.desc("worst_inset"), "sheet_id", "gt_id").limit(n)


def size_bins(boxes: DataFrame, near_edge: Column, by=()) -> DataFrame:
    """Symbols by diagonal (<8, 8-30, 30-60, >=60 px), those at the sheet edge, and nearest-rank quartiles."""
    d = g.with_box(boxes).withColumn("edge", near_edge)
    c = F.col("diag")
    bins = d.groupBy(*by).agg(F.count_if(c < 8).alias("tiny"), F.count_if((c >= 8) & (c < 30)).alias("small"), F.count_if((c >= 30) & (c < 60)).alias("medium"),
                              F.count_if(c >= 60).alias("large"), F.count_if("edge").alias("near_edge"))
    q = quantiles(d, list(by), c, {"p25": 0.25, "median": 0.5, "p75": 0.75, "min": 0.0, "max": 1.0}, "nearest")
    u = quantiles(d, list(by), c, {"upper_median": 0.5}, "upper").drop("n")
    if by:
        return q.join(u, list(by)).join(bins, list(by))
    return q.crossJoin(F.broadcast(u)).crossJoin(F.broadcast(bins))  # one row each


def orientation_share(boxes: DataFrame, by=()) -> DataFrame:
    """Count and share of horizontal, vertical and square symbols."""
    from pyspark.sql import Window
    c = boxes.groupBy(*by, g.orientation(g.width(), g.height()).alias("orientation")).agg(n_rows().alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))  # three rows per group


def bookkeeping(d: DataFrame, gt: DataFrame, matches: DataFrame, keys=SHEET) -> DataFrame:
    """Per sheet and in total: ground truth, predictions, matched pairs, and what is left on either side."""
    part = lambda df, n: df.select(*keys, F.lit(n).alias("what"))
    rows = part(gt, "gt").unionByName(part(d, "pred")).unionByName(part(matches, "match"))
    n = lambda w: F.count_if(F.col("what") == w)
    return rows.rollup(*keys).agg(n("gt").alias("n_gt"), n("pred").alias("n_pred"), n("match").alias("matched"),
                                  (n("gt") - n("match")).alias("gt_unmatched"), (n("pred") - n("match")).alias("pred_unmatched"))


def funnel(stages: dict[str, DataFrame], keys=SHEET) -> DataFrame:
    """Row counts of each stage per sheet, in one aggregation over the union of their keys."""
    rows = None
    for name, df in stages.items():
        part = df.select(*keys, F.lit(name).alias("stage"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("stage") == n).alias(n) for n in stages])
