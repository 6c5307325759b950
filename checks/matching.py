"""Suppression, overlap joins, matching and triage (J1-J16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlparts import FAM, GSUPER, SUPER, TYPE, box_area, d2, inter, iou, nms, serial
from checks.views import Views, area, oracle
from sheetgraph import params as P
from sheetgraph.functions import geometry as g
from sheetgraph.operators import match, suppress

QUERIES, ORACLES, check = area()


def scored_gt(v):
    return v.gt.withColumn("cls", P.lookup(P.SCORED_LABELS, F.col("label")))


def scored_det(d):
    return d.withColumn("cls", g.supercategory()).filter("cls is not null")


def labelled(d):
    """Detections of graded node types under their ground-truth label."""
    return d.withColumn("label", P.lookup(P.NODE_TO_LABEL, g.node_type())).filter("label is not null")


def node_match_by_type(spark, sf_dir):
    v = Views(spark, sf_dir)
    kept = labelled(suppress.centroid(v.det))
    gt = v.gt.filter("label in ('valve','instrumentation')")
    m = match.greedy_center(kept, gt)
    total = gt.groupBy("label").agg(F.count(F.lit(1)).alias("n_gt"))
    hit = m.groupBy("label").agg(F.count(F.lit(1)).alias("n_matched"))
    return total.join(hit, "label", "left").select("label", "n_gt", F.coalesce("n_matched", F.lit(0)).alias("n_matched"),
                                                   F.round(F.coalesce("n_matched", F.lit(0)) / F.col("n_gt"), 6).alias("recall"))


LAB = "CASE WHEN cls_id<=13 THEN 'valve' WHEN cls_id IN (25,26,27,28,30) THEN 'instrumentation' END"
PRED_FIRST = dict(
    cand=f"SELECT p.sheet_id, p.label, p.det_id, p.conf, g.gt_id, {d2('p','g')} AS d2 FROM lk p JOIN gt g ON g.sheet_id=p.sheet_id AND g.label=p.label AND {d2('p','g')}<=0.25*(g.x2-g.x1)*(g.y2-g.y1)",
    lk=f"SELECT * FROM (SELECT *, {LAB} AS label FROM kept) q WHERE label IS NOT NULL",
    **serial("cand", "conf DESC", "d2", "det_id", "gt_id"))
QUERIES["flagship_node_match"] = node_match_by_type
ORACLES["flagship_node_match"] = oracle("SELECT g.label, CAST(count(*) AS BIGINT) AS n_gt, CAST(count(m.gt_id) AS BIGINT) AS n_matched, round(count(m.gt_id)/count(*),6) AS recall FROM gt g LEFT JOIN s_match m ON m.sheet_id=g.sheet_id AND m.gt_id=g.gt_id WHERE g.label<>'arrow' GROUP BY 1", **PRED_FIRST)


@check("j1_centroid_suppression", "SELECT det_id, sheet_id FROM kept")
def _(v):
    return suppress.centroid(v.det).select("det_id", "sheet_id")


@check("j1_per_class", "SELECT det_id, sheet_id FROM nms_walk WHERE keep", **nms("det", "cls_id"))
def _(v):
    return suppress.centroid(v.det, group=F.col("cls_id")).select("det_id", "sheet_id")


@check("j2_subtype_conflicts", """SELECT o.sheet_id, o.owner AS det_id, CAST(count(*) AS BIGINT) AS n_suppressed, CAST(count(DISTINCT o.cls_id) AS BIGINT) AS n_names
FROM (SELECT n.sheet_id, n.owner, r.cls_id, k.cls_id AS kc FROM nms_walk n JOIN nms_rank r ON r.sheet_id=n.sheet_id AND r.det_id=n.det_id JOIN nms_rank k ON k.sheet_id=n.sheet_id AND k.det_id=n.owner WHERE n.owner IS NOT NULL) o WHERE o.cls_id<>o.kc GROUP BY 1,2""")
def _(v):
    d = v.det
    a = suppress.annotate(d, suppress.centroid(d)).filter("subtype_conflict")
    n = F.aggregate("suppressed_subtypes", F.lit(0).cast("bigint"), lambda s, x: s + x["times"])
    return a.select("sheet_id", "det_id", n.alias("n_suppressed"), F.size("suppressed_subtypes").cast("bigint").alias("n_names"))


@check("j3_node_set", "SELECT sheet_id, node_id, det_id, node_type FROM node")
def _(v):
    return suppress.node_set(suppress.centroid(v.det)).select("sheet_id", "node_id", "det_id", "node_type")


@check("j4_duplicate_guard", f"""SELECT a.sheet_id, a.node_type, a.node_id AS a_node_id, b.node_id AS b_node_id FROM vertex a JOIN vertex b ON a.sheet_id=b.sheet_id AND a.node_type=b.node_type AND a.node_id<b.node_id
WHERE a.node_type IN ('valve','instrument') AND {d2('a','b')}<0.25*greatest((a.x2-a.x1)*(a.y2-a.y1),1)""")
def _(v):
    return suppress.duplicates(v.vertex)


@check("j5_close_pairs", f"""SELECT family, cls_lo, cls_hi, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN a.node_type='instrument' AND b.node_type='instrument' THEN 'instrument' WHEN a.node_type='valve' AND b.node_type='valve' THEN 'valve' ELSE 'other' END AS family,
  least(a.cls_id,b.cls_id) AS cls_lo, greatest(a.cls_id,b.cls_id) AS cls_hi FROM typed a JOIN typed b ON a.sheet_id=b.sheet_id AND a.node_id<b.node_id AND a.cls_id<>b.cls_id
  WHERE {d2('a','b')}<0.25*greatest((a.x2-a.x1)*(a.y2-a.y1),(b.x2-b.x1)*(b.y2-b.y1),1)) q GROUP BY GROUPING SETS ((family,cls_lo,cls_hi),(family),())""",
       typed=f"SELECT sheet_id, node_id, cls_id, x1,y1,x2,y2, {TYPE} AS node_type FROM vertex")
def _(v):
    return suppress.close_class_counts(v.vertex.withColumn("node_type", g.node_type()))


@check("j6_iou_join", f"SELECT d.sheet_id, d.det_id, g.gt_id, round({iou('d','g')},12) AS iou, round({inter('d','g')}/{box_area('d','1e-6')},12) AS frac FROM det d JOIN gt g ON g.sheet_id=d.sheet_id AND {inter('d','g')}>0 AND {iou('d','g')}>=0.3")
def _(v):
    j = match.iou_join(v.det.select("sheet_id", "det_id", *P.BOX), v.gt.select("sheet_id", "gt_id", *P.BOX), 0.3)
    return j.select("sheet_id", F.col("p_det_id").alias("det_id"), F.col("g_gt_id").alias("gt_id"), F.round("iou", 12).alias("iou"), F.round("frac", 12).alias("frac"))


@check("j7_ignore_suppression", f"SELECT det_id, sheet_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM ignore_box g WHERE g.sheet_id=d.sheet_id AND {iou('d','g')}>=0.3)")
def _(v):
    return match.drop_ignored(v.det, v.ignore_box).select("det_id", "sheet_id")


IOU_MATCH = dict(
    dc=f"SELECT *, {SUPER} AS cls FROM det WHERE {SUPER} IS NOT NULL", gc=f"SELECT *, {GSUPER} AS cls FROM gt",
    cand=f"SELECT d.sheet_id, d.cls, d.det_id, d.conf, g.gt_id, {iou('d','g')} AS iou FROM dc d JOIN gc g ON g.sheet_id=d.sheet_id AND g.cls=d.cls AND {inter('d','g')}>0 AND {iou('d','g')}>=0.5",
    **serial("cand", "conf DESC", "iou DESC", "det_id", "gt_id", "sheet_id, cls"))


@check("j8_iou_matching", "SELECT sheet_id, cls, det_id, gt_id FROM s_match", **IOU_MATCH)
def _(v):
    return match.greedy_iou(scored_det(v.det), scored_gt(v), 0.5).select("sheet_id", "cls", "det_id", "gt_id")


SIDE = "greatest(g.x2-g.x1,1)*greatest(g.y2-g.y1,1)"


@check("j9_center_gt_first", "SELECT sheet_id, cls, gt_id, det_id FROM s_match",
       dc=IOU_MATCH["dc"], gc=IOU_MATCH["gc"],
       cand=f"SELECT d.sheet_id, d.cls, d.det_id, g.gt_id, {d2('d','g')} AS d2 FROM dc d JOIN gc g ON g.sheet_id=d.sheet_id AND g.cls=d.cls AND {d2('d','g')}<0.25*{SIDE}",
       **serial("cand", "0", "d2", "gt_id", "det_id", "sheet_id, cls"))
def _(v):
    return match.greedy_center(scored_det(v.det), scored_gt(v), 0.5, "gt", True, "side", ("sheet_id", "cls")).select("sheet_id", "cls", "gt_id", "det_id")


@check("j10_hit_counts", f"SELECT g.sheet_id, g.cls, g.gt_id, CAST(count(d.det_id) AS BIGINT) AS hits FROM gc g LEFT JOIN dc d ON g.sheet_id=d.sheet_id AND g.cls=d.cls AND {d2('d','g')}<0.25*{SIDE} GROUP BY 1,2,3", ("det",), dc=IOU_MATCH["dc"], gc=IOU_MATCH["gc"])
def _(v):
    return match.hit_counts(scored_det(v.det), scored_gt(v), 0.5, ("sheet_id", "cls"))


@check("j11_unmatched", f"SELECT d.sheet_id, d.det_id, d.super FROM (SELECT *, {SUPER} AS super FROM det) d WHERE NOT EXISTS (SELECT 1 FROM gc g WHERE g.sheet_id=d.sheet_id AND g.cls=d.super AND {d2('d','g')}<0.25*{SIDE})", gc=IOU_MATCH["gc"])
def _(v):
    return match.unmatched(v.det, v.gt).select("sheet_id", "det_id", "super")


@check("j12_center_pred_first", "SELECT sheet_id, label, det_id, gt_id FROM s_match", **PRED_FIRST)
def _(v):
    return match.greedy_center(labelled(suppress.centroid(v.det)), v.gt).select("sheet_id", "label", "det_id", "gt_id")


@check("j13_nearest", f"""SELECT sheet_id, probe_id, node_id, round(d2,6) AS d2, CASE WHEN node_id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS found FROM (
 SELECT p.sheet_id, p.ig_id AS probe_id, min({d2('p','n')}) AS d2, arg_min(n.node_id, ({d2('p','n')}, n.node_id)) AS node_id FROM ignore_box p LEFT JOIN vertex n ON n.sheet_id=p.sheet_id AND n.det_id<>p.ig_id AND {d2('p','n')}<900 GROUP BY 1,2) q""")
def _(v):
    b = v.ignore_box
    probes = b.select("sheet_id", F.col("ig_id").alias("probe_id"), g.cx().alias("x"), g.cy().alias("y"))
    # the box a probe was made from sits exactly on it, so it is taken out of the search by its id
    n = v.vertex
    p = probes.withColumnsRenamed({"x": "qx", "y": "qy"})
    from sheetgraph.operators.cells import points_in_reach
    others = points_in_reach(p, [F.col("qx") - 30, F.col("qy") - 30, F.col("qx") + 30, F.col("qy") + 30],
                             n.select("sheet_id", "node_id", "det_id", *P.BOX), g.cx(), g.cy(), ["sheet_id"],
                             F.col("probe_id") != F.col("det_id"))
    own = others.select(F.concat_ws("|", "sheet_id", "probe_id").alias("sheet_probe"), "sheet_id", "probe_id", "node_id", *P.BOX)
    by_probe = own.drop("sheet_id", "probe_id").withColumnRenamed("sheet_probe", "sheet_id")
    near = match.nearest(probes.select(F.concat_ws("|", "sheet_id", "probe_id").alias("sheet_id"), F.col("sheet_id").alias("sheet"), "probe_id", "x", "y"),
                         by_probe, 30)
    return near.select(F.col("sheet").alias("sheet_id"), "probe_id", "node_id", F.round("d2", 6).alias("d2"), "found")


@check("j14_unmatched_triage", f"""SELECT l.sheet_id, l.label, l.det_id, c.gt_id, CASE WHEN c.gt_id IS NULL THEN 'NO_NEARBY_GT' WHEN m.gt_id IS NOT NULL THEN 'DUPLICATE' ELSE 'WOULD_MATCH' END AS verdict
FROM (SELECT * FROM lk WHERE det_id NOT IN (SELECT det_id FROM s_match)) l LEFT JOIN (SELECT sheet_id, label, det_id, arg_min(gt_id,(d2,gt_id)) AS gt_id FROM cand GROUP BY 1,2,3) c ON c.sheet_id=l.sheet_id AND c.label=l.label AND c.det_id=l.det_id LEFT JOIN s_match m ON m.sheet_id=l.sheet_id AND m.gt_id=c.gt_id""", **{**PRED_FIRST, "lk": f"SELECT * FROM (SELECT *, {LAB} AS label FROM det) q WHERE label IS NOT NULL"})
def _(v):
    d = labelled(v.det)
    return match.triage(d, v.gt, match.greedy_center(d, v.gt)).select("sheet_id", "label", "det_id", "gt_id", "verdict")


BUCKETS = dict(
    gs=f"SELECT * FROM gt g WHERE label IN ('valve','arrow') AND NOT EXISTS (SELECT 1 FROM ignore_box i WHERE i.sheet_id=g.sheet_id AND {iou('g','i')}>=0.5)",
    ov=f"SELECT g.sheet_id, g.gt_id, d.det_id, d.cls_id, {iou('d','g')} AS iou, CASE g.label WHEN 'valve' THEN d.cls_id<=13 ELSE d.cls_id=23 END AS own FROM gs g JOIN det d ON d.sheet_id=g.sheet_id AND {inter('d','g')}>0",
    best="SELECT sheet_id, gt_id, max(CASE WHEN own THEN iou END) AS own_iou, max(iou) AS iou, arg_max(det_id,(iou,det_id)) AS best_det, arg_max(cls_id,(iou,det_id)) AS best_cls FROM ov GROUP BY 1,2",
    fb="SELECT g.sheet_id, g.gt_id, g.label, g.x1,g.y1,g.x2,g.y2, CASE WHEN coalesce(own_iou,0)>=0.5 THEN 'TP' WHEN coalesce(iou,0)<0.1 THEN 'A' WHEN iou<0.5 THEN 'B' WHEN g.label='valve' AND best_cls IN (14,15,16,17,18,24) THEN 'D' ELSE 'C' END AS bucket, coalesce(iou,0) AS best_iou, best_det, best_cls FROM gs g LEFT JOIN best b ON b.sheet_id=g.sheet_id AND b.gt_id=g.gt_id")


@check("j15_failure_buckets", "SELECT sheet_id, gt_id, label, bucket, round(best_iou,6) AS best_iou, best_det FROM fb", **BUCKETS)
def _(v):
    return match.failure_buckets(v.det, v.gt, v.ignore_box).select("sheet_id", "gt_id", "label", "bucket", F.round("best_iou", 6).alias("best_iou"), "best_det")


@check("j16_wrong_class_top", "SELECT label, best_cls, n, rank FROM (SELECT label, best_cls, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, best_cls) AS INT) AS rank FROM fb WHERE bucket='C' GROUP BY 1,2) q WHERE rank<=8", **BUCKETS)
def _(v):
    return match.top_wrong(match.failure_buckets(v.det, v.gt, v.ignore_box))
