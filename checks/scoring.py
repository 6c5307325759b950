"""Detection metrics and statistics (M1-M16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.matching import BUCKETS, IOU_MATCH, PRED_FIRST, labelled, scored_det, scored_gt
from checks.sqlparts import FAM, TYPE, nms
from checks.views import H, W, area
from sheetgraph import params as P
from sheetgraph.functions import geometry as g
from sheetgraph.operators import boxes, match, metrics, suppress

QUERIES, ORACLES, check = area()


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def ap_sql(pred: str, by: str) -> dict[str, str]:
    """AP row by row: `pred` has the keys, conf, det_id and tp."""
    return {
        "curve": f"SELECT *, sum(tp) OVER w AS ctp, row_number() OVER w AS rn FROM {pred} WINDOW w AS (PARTITION BY {by} ORDER BY conf DESC, det_id)",
        "envelope": f"SELECT *, max(CAST(ctp AS DOUBLE)/rn) OVER (PARTITION BY {by} ORDER BY rn DESC ROWS UNBOUNDED PRECEDING) AS env FROM curve",
        "area_t": f"SELECT {by}, sum(CASE WHEN tp=1 THEN env ELSE 0 END) AS area, CAST(sum(tp) AS BIGINT) AS n_tp, CAST(count(*) AS BIGINT) AS n_pred FROM envelope GROUP BY {by}",
    }


AP50 = dict(IOU_MATCH, pred="SELECT d.cls, d.conf, d.det_id, CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM dc d LEFT JOIN s_match m ON m.sheet_id=d.sheet_id AND m.det_id=d.det_id",
            ngt="SELECT cls, CAST(count(*) AS BIGINT) AS n_gt FROM gc GROUP BY 1", **ap_sql("pred", "cls"),
            apt="SELECT coalesce(n.cls,a.cls) AS cls, coalesce(n_gt,0) AS n_gt, coalesce(n_pred,0) AS n_pred, coalesce(n_tp,0) AS n_tp, CASE WHEN n_gt>0 THEN coalesce(area,0)/n_gt END AS ap FROM ngt n FULL JOIN area_t a ON a.cls=n.cls")


def many_thresholds(levels: list[float]) -> dict[str, str]:
    """One recursive matching with the threshold as one more key."""
    from checks.sqlparts import inter, iou, serial
    vals = ",".join(f"CAST({t} AS DOUBLE)" for t in levels)
    return dict(
        dc=IOU_MATCH["dc"], gc=IOU_MATCH["gc"], lev=f"SELECT unnest([{vals}]) AS thr",
        cand=f"SELECT d.sheet_id, d.cls, thr, d.det_id, d.conf, g.gt_id, {iou('d','g')} AS iou FROM dc d JOIN gc g ON g.sheet_id=d.sheet_id AND g.cls=d.cls AND {inter('d','g')}>0 JOIN lev ON {iou('d','g')}>=thr",
        **serial("cand", "conf DESC", "iou DESC", "det_id", "gt_id", "sheet_id, cls, thr"),
        pred="SELECT d.cls, thr, d.conf, d.det_id, CASE WHEN m.det_id IS NULL THEN 0 ELSE 1 END AS tp FROM dc d JOIN lev ON true LEFT JOIN s_match m ON m.sheet_id=d.sheet_id AND m.det_id=d.det_id AND m.thr=lev.thr".replace("cls, thr,", "cls, lev.thr AS thr,"),
        ngt="SELECT cls, thr, CAST(count(*) AS BIGINT) AS n_gt FROM gc JOIN lev ON true GROUP BY 1,2", **ap_sql("pred", "cls, thr"),
        apt="SELECT n.cls, n.thr, n_gt, coalesce(n_pred,0) AS n_pred, coalesce(n_tp,0) AS n_tp, coalesce(area,0)/n_gt AS ap FROM ngt n LEFT JOIN area_t a ON a.cls=n.cls AND a.thr=n.thr")


@check("m1_average_precision", "SELECT cls, n_gt, n_pred, n_tp, round(ap,6) AS ap FROM apt", **AP50)
def m1(v):
    d, gt = scored_det(v.det), scored_gt(v)
    m = match.greedy_iou(d, gt, 0.5)
    return metrics.ap(metrics.flagged(d, m), metrics.gt_counts(gt)).select("cls", "n_gt", "n_pred", "n_tp", *r6("ap"))


@check("m2_ap50_95", "SELECT cls, round(avg(ap),6) AS ap50_95, round(max(CASE WHEN thr=0.5 THEN ap END),6) AS ap50 FROM apt GROUP BY 1", **many_thresholds(P.AP_THRESHOLDS))
def _(v):
    return metrics.ap_range(scored_det(v.det), scored_gt(v)).select("cls", *r6("ap50_95", "ap50"))


# per-class AP over all 32 classes against boxes of the same class, for the tables that compare with a recorded run
CLS32 = dict(
    dc="SELECT *, cls_id AS cls FROM det", gc="SELECT det_id AS gt_id, sheet_id, cls_id AS cls, x1+h%7-3 AS x1, y1+h%5-2 AS y1, x2+h%7-3 AS x2, y2+h%5-2 AS y2 FROM det WHERE h%10<7 AND cls_id<>4",
    cand=IOU_MATCH["cand"], **{k: IOU_MATCH[k] for k in ("s_turn", "s_walk", "s_match")}, **{k: AP50[k] for k in ("pred", "ngt", "curve", "envelope", "area_t", "apt")})


def ap32(v):
    d = v.det.withColumn("cls", F.col("cls_id"))
    h = F.col("h")
    gt = v.det.filter("h%10<7 and cls_id<>4").select(F.col("det_id").alias("gt_id"), "sheet_id", F.col("cls_id").alias("cls"), (F.col("x1") + h % 7 - 3).alias("x1"),
                                       (F.col("y1") + h % 5 - 2).alias("y1"), (F.col("x2") + h % 7 - 3).alias("x2"), (F.col("y2") + h % 5 - 2).alias("y2"))
    m = match.greedy_iou(d, gt, 0.5)
    return metrics.ap(metrics.flagged(d, m), metrics.gt_counts(gt)), d


@check("m3_per_class_table", "SELECT a.cls, n_gt, round(ap,6) AS ap, round(b.ap50,6) AS base, round(ap-b.ap50,6) AS delta, CASE WHEN b.cls IS NULL THEN 'not recorded' WHEN ap-b.ap50 < -0.1 THEN 'DROP' ELSE '' END AS flag FROM apt a LEFT JOIN baseline b ON b.cls=a.cls", **CLS32)
def _(v):
    return metrics.per_class(ap32(v)[0], v.baseline).select("cls", "n_gt", *r6("ap", "base", "delta"), "flag")


@check("m4_group_baseline", f"SELECT node_type, round(avg(ap50),6) AS mean_ap50, CAST(count(ap50) AS BIGINT) AS n_recorded, CAST(count(*) AS BIGINT) AS n_total FROM (SELECT DISTINCT cls_id AS cls, {TYPE} AS node_type FROM det) q LEFT JOIN baseline b ON b.cls=q.cls GROUP BY 1")
def _(v):
    members = v.det.select(F.col("cls_id").alias("cls"), g.node_type().alias("node_type")).distinct()
    return metrics.group_baseline(members, v.baseline, "node_type").select("node_type", *r6("mean_ap50"), "n_recorded", "n_total")


def _center_sql(f, name):
    from checks.sqlparts import d2, serial
    side = "greatest(g.x2-g.x1,1)*greatest(g.y2-g.y1,1)"
    parts = serial(f"cand_{name}", "0", "d2", "gt_id", "det_id", "sheet_id, cls")
    out = {f"cand_{name}": f"SELECT d.sheet_id, d.cls, d.det_id, g.gt_id, {d2('d','g')} AS d2 FROM dc d JOIN gc g ON g.sheet_id=d.sheet_id AND g.cls=d.cls AND {d2('d','g')}<{f*f}*{side}"}
    import re
    for k, b in parts.items():
        out[k + name] = re.sub(r"\b(s_turn|s_walk|s_match)\b", lambda m: m.group(1) + name, b)
    return out


@check("m5_extended_metrics", """SELECT a.cls, a.n_gt, a.n_tp, round(a.n_tp/a.n_gt,6) AS recall, round(a.n_tp/a.n_pred,6) AS precision, round(a.ap,6) AS ap50, round(b.ap,6) AS ap30,
 round(coalesce(c1.n,0)/a.n_gt,6) AS center25, round(coalesce(c2.n,0)/a.n_gt,6) AS center50 FROM apt a JOIN apt b ON b.cls=a.cls AND b.thr=0.3 LEFT JOIN (SELECT cls, count(*) AS n FROM s_matcha GROUP BY 1) c1 ON c1.cls=a.cls LEFT JOIN (SELECT cls, count(*) AS n FROM s_matchb GROUP BY 1) c2 ON c2.cls=a.cls WHERE a.thr=0.5""",
       **many_thresholds([0.5, 0.3]), **_center_sql(0.25, "a"), **_center_sql(0.5, "b"))
def _(v):
    return metrics.extended(scored_det(v.det), scored_gt(v)).select("cls", "n_gt", "n_tp", *r6("recall", "precision", "ap50", "ap30", "center25", "center50"))


@check("m6_compare_runs", "SELECT coalesce(a.cls,b.cls) AS cls, round(a.ap,6) AS before, round(b.ap50,6) AS after, round(b.ap50-a.ap,6) AS delta FROM apt a FULL JOIN baseline b ON b.cls=a.cls", **CLS32)
def _(v):
    return metrics.compare_runs(ap32(v)[0], v.baseline.withColumnRenamed("ap50", "ap")).select("cls", *r6("before", "after", "delta"))


@check("m7_class_counts", "SELECT t.cls_id, coalesce(n,0) AS n, round(max(n) OVER () / min(n) OVER (),6) AS imbalance FROM (SELECT CAST(unnest(range(40)) AS INT) AS cls_id) t LEFT JOIN (SELECT cls_id, CAST(count(*) AS BIGINT) AS n FROM det GROUP BY 1) d ON d.cls_id=t.cls_id")
def _(v):
    spark = v._s
    taxonomy = spark.range(40).select(F.col("id").cast("int").alias("cls_id"))  # eight ids beyond the data stay at zero
    return metrics.class_counts(v.det, taxonomy).select("cls_id", "n", *r6("imbalance"))


@check("m8_image_stats", """SELECT metric, CAST(count(*) AS BIGINT) AS n, min(val) AS min, quantile_cont(val,0.5) AS median, max(val) AS max FROM (
 SELECT unnest(['width','height','boxes']) AS metric, unnest([CAST(width AS DOUBLE), CAST(height AS DOUBLE), CAST(coalesce(n,0) AS DOUBLE)]) AS val FROM image i LEFT JOIN (SELECT sheet_id, count(*) AS n FROM gt GROUP BY 1) b ON b.sheet_id=i.sheet_id) q GROUP BY 1""")
def _(v):
    return metrics.image_stats(v.image, v.gt).select("metric", "n", "min", "median", "max")


@check("m9_box_sizes", "SELECT side, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(val,0.1),6) AS p10, round(quantile_cont(val,0.5),6) AS median, round(quantile_cont(val,0.9),6) AS p90, max(val) AS max, round(quantile_cont(val,0.9)*4,6) AS tile FROM (SELECT 'w' AS side, x2-x1 AS val FROM det UNION ALL SELECT 'h', y2-y1 FROM det) q GROUP BY 1")
def _(v):
    return metrics.box_sizes(v.det).select("side", "n", *r6("p10", "median", "p90"), "max", *r6("tile"))


@check("m10_class_sizes", "SELECT cls_id, CAST(count(*) AS BIGINT) AS n, median(x2-x1) AS median_w, median(y2-y1) AS median_h FROM det GROUP BY 1")
def _(v):
    return metrics.class_sizes(v.det)


@check("m11_offset_stats", """SELECT metric, CAST(count(*) AS BIGINT) AS n, round(avg(val),6) AS mean, round(stddev_pop(val),6) AS std, round(quantile_cont(val,0.25),6) AS p25, round(median(val),6) AS median, round(quantile_cont(val,0.75),6) AS p75, round(min(val),6) AS min, round(max(val),6) AS max, round(avg(CASE WHEN abs(val)<=0.25 THEN 1.0 ELSE 0.0 END),6) AS within
FROM (SELECT unnest(['dx','dy','area_ratio']) AS metric, unnest([((p.x1+p.x2)/2-(g.x1+g.x2)/2)/greatest(g.x2-g.x1,1), ((p.y1+p.y2)/2-(g.y1+g.y2)/2)/greatest(g.y2-g.y1,1), (p.x2-p.x1)*(p.y2-p.y1)/greatest((g.x2-g.x1)*(g.y2-g.y1),1)]) AS val
 FROM fb g JOIN det p ON p.sheet_id=g.sheet_id AND p.det_id=g.best_det WHERE g.bucket='B') q GROUP BY 1""", ("det",), **BUCKETS)
def _(v):
    b = match.failure_buckets(v.det, v.gt, v.ignore_box).filter("bucket='B'").select("sheet_id", "gt_id", F.col("best_det").alias("det_id"))
    pref = lambda d, p: d.select("sheet_id", p[0], *[F.col(c).alias(p[1] + c) for c in P.BOX])
    pairs = b.join(pref(v.gt, ("gt_id", "g_")), ["sheet_id", "gt_id"]).join(pref(v.det, ("det_id", "p_")), ["sheet_id", "det_id"])
    return metrics.offset_stats(pairs).select("metric", "n", *r6("mean", "std", "p25", "median", "p75", "min", "max", "within"))


def matched_pairs(v):
    d = labelled(suppress.centroid(v.det)).filter("label='instrumentation'")
    m = match.greedy_center(d, v.gt)
    pref = lambda d, id, p: d.select("sheet_id", id, *[F.col(c).alias(p + c) for c in P.BOX])
    pairs = m.join(pref(v.gt, "gt_id", "g_"), ["sheet_id", "gt_id"]).join(pref(v.det, "det_id", "p_"), ["sheet_id", "det_id"])
    return metrics.inset_pairs(pairs)


INSET = dict(PRED_FIRST, pr="""SELECT m.sheet_id, m.gt_id, (p.x2-p.x1)/(g.x2-g.x1) AS width_ratio, (p.y2-p.y1)/(g.y2-g.y1) AS height_ratio, (p.x2-p.x1)*(p.y2-p.y1)/((g.x2-g.x1)*(g.y2-g.y1)) AS area_ratio,
 p.x1-g.x1 AS left_inset, g.x2-p.x2 AS right_inset, p.y1-g.y1 AS top_inset, g.y2-p.y2 AS bottom_inset, greatest(p.x1-g.x1,g.x2-p.x2,p.y1-g.y1,g.y2-p.y2) AS worst_inset
 FROM s_match m JOIN det p ON p.sheet_id=m.sheet_id AND p.det_id=m.det_id JOIN gt g ON g.sheet_id=m.sheet_id AND g.gt_id=m.gt_id WHERE m.label='instrumentation'""")
_NAMES = ["area_ratio", "width_ratio", "height_ratio", "left_inset", "right_inset", "top_inset", "bottom_inset", "worst_inset"]


@check("m12_inset_stats", f"""SELECT metric, CAST(count(*) AS BIGINT) AS n, round(list(val ORDER BY val)[1+CAST(round_even(0.25*(count(*)-1),0) AS BIGINT)],6) AS p25, round(median(val),6) AS median, round(list(val ORDER BY val)[1+CAST(round_even(0.75*(count(*)-1),0) AS BIGINT)],6) AS p75, round(min(val),6) AS min, round(max(val),6) AS max
FROM (SELECT unnest({_NAMES}) AS metric, unnest([{','.join(_NAMES)}]) AS val FROM pr) q GROUP BY 1""", **INSET)
def _(v):
    return metrics.inset_stats(matched_pairs(v)).select("metric", "n", *r6("p25", "median", "p75", "min", "max"))


@check("m12_worst_pairs", "SELECT sheet_id, gt_id, round(area_ratio,6) AS area_ratio, worst_inset FROM pr ORDER BY worst_inset DESC, sheet_id, gt_id LIMIT 10", **INSET)
def _(v):
    return metrics.worst_pairs(matched_pairs(v)).select("sheet_id", "gt_id", *r6("area_ratio"), "worst_inset")


@check("m13_size_bins", f"""SELECT cls_id, CAST(count(*) AS BIGINT) AS n, CAST(count_if(d<8) AS BIGINT) AS tiny, CAST(count_if(d>=8 AND d<30) AS BIGINT) AS small, CAST(count_if(d>=30 AND d<60) AS BIGINT) AS medium, CAST(count_if(d>=60) AS BIGINT) AS large, CAST(count_if(e) AS BIGINT) AS near_edge,
 round(list(d ORDER BY d)[1+CAST(round_even(0.25*(count(*)-1),0) AS BIGINT)],6) AS p25, round(list(d ORDER BY d)[1+CAST(round_even(0.5*(count(*)-1),0) AS BIGINT)],6) AS median, round(list(d ORDER BY d)[1+CAST(floor(count(*)/2) AS BIGINT)],6) AS upper_median
FROM (SELECT cls_id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS d, x1<65 OR y1<65 OR x2>{W}-65 OR y2>{H}-65 AS e FROM det) q GROUP BY 1""")
def _(v):
    return metrics.size_bins(v.det, g.box_near_edge(W, H, 65), ["cls_id"]).select(
        "cls_id", "n", "tiny", "small", "medium", "large", "near_edge", *r6("p25", "median", "upper_median"))


@check("m14_orientation_share", "SELECT src, orientation, CAST(count(*) AS BIGINT) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY src),6) AS share FROM (SELECT src, CASE WHEN r>1.4 THEN 'Horizontal' WHEN r<0.71 THEN 'Vertical' ELSE 'Square/diagonal' END AS orientation FROM (SELECT 'det' AS src, (x2-x1)/greatest(y2-y1,1) AS r FROM det UNION ALL SELECT 'gt', (x2-x1)/greatest(y2-y1,1) FROM gt) a) b GROUP BY 1,2")
def _(v):
    both = v.det.select(F.lit("det").alias("src"), *P.BOX).unionByName(v.gt.select(F.lit("gt").alias("src"), *P.BOX))
    return metrics.orientation_share(both, ["src"]).select("src", "orientation", "n", *r6("share"))


@check("m15_match_bookkeeping", """SELECT sheet_id, CAST(sum(a) AS BIGINT) AS n_gt, CAST(sum(b) AS BIGINT) AS n_pred, CAST(sum(c) AS BIGINT) AS matched, CAST(sum(a-c) AS BIGINT) AS gt_unmatched, CAST(sum(b-c) AS BIGINT) AS pred_unmatched
FROM (SELECT sheet_id, 1 AS a, 0 AS b, 0 AS c FROM gt WHERE label<>'arrow' UNION ALL SELECT sheet_id, 0, 1, 0 FROM lk UNION ALL SELECT sheet_id, 0, 0, 1 FROM s_match) q GROUP BY ROLLUP (sheet_id)""", **PRED_FIRST)
def _(v):
    d, gt = labelled(suppress.centroid(v.det)), v.gt.filter("label<>'arrow'")
    return metrics.bookkeeping(d, gt, match.greedy_center(d, gt))


@check("m16_sheet_funnel", f"""SELECT r.sheet_id, r.raw, coalesce(n_roi,0) AS roi, coalesce(n_kept,0) AS kept, coalesce(valve,0) AS valve, coalesce(instrument,0) AS instrument, coalesce(e.edges,0) AS edges FROM (SELECT sheet_id, CAST(count(*) AS BIGINT) AS raw FROM det GROUP BY 1) r
 LEFT JOIN (SELECT sheet_id, CAST(count(*) AS BIGINT) AS n_roi FROM roi GROUP BY 1) a ON a.sheet_id=r.sheet_id
 LEFT JOIN (SELECT n.sheet_id, CAST(count_if(keep) AS BIGINT) AS n_kept, CAST(count_if(keep AND grp='valve') AS BIGINT) AS valve, CAST(count_if(keep AND grp='instrument') AS BIGINT) AS instrument FROM nms_walk n GROUP BY 1) b ON b.sheet_id=r.sheet_id
 LEFT JOIN (SELECT sheet_id, CAST(count(*) AS BIGINT) AS edges FROM edge GROUP BY 1) e ON e.sheet_id=r.sheet_id""",
       roi=f"SELECT * FROM (SELECT *, (x1+x2)/2 AS pcx, (y1+y2)/2 AS pcy FROM det) d WHERE CASE WHEN sheet_id IN (SELECT sheet_id FROM background) THEN NOT EXISTS (SELECT 1 FROM background b WHERE b.sheet_id=d.sheet_id AND pcx BETWEEN b.x1 AND b.x2 AND pcy BETWEEN b.y1 AND b.y2) ELSE pcx BETWEEN {W}*0.04 AND {W}*0.96 AND pcy BETWEEN {H}*0.04 AND {H}*0.96 END",
       **nms("roi", FAM))
def _(v):
    roi = boxes.roi_filter(v.det, v.background, W, H)
    kept = suppress.centroid(roi)
    typed = boxes.with_node_type(kept)
    return metrics.funnel({"raw": v.det, "roi": roi, "kept": kept, "valve": typed.filter("node_type='valve'"),
                           "instrument": typed.filter("node_type='instrument'"), "edges": v.edge})
