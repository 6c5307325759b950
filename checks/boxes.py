"""Scalar geometry, filters and box-table operators (P1-P17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlparts import GSUPER, SUPER, TYPE, inter
from checks.views import H, W, area
from sheetgraph.functions import geometry as g, polyline, text
from sheetgraph.operators import boxes

QUERIES, ORACLES, check = area()


@check("p1_norm_boxes", f"SELECT det_id, sheet_id, round((x1+x2)/2/{W},6) AS xc, round((y1+y2)/2/{H},6) AS yc, round((x2-x1)/{W},6) AS bw, round((y2-y1)/{H},6) AS bh, round((x2-x1),6) AS w_back FROM det")
def _(v):
    d = v.det.withColumns({"width": F.lit(W), "height": F.lit(H)})
    n = g.to_norm(d, digits=12).drop("x1", "y1", "x2", "y2")
    back = g.to_px(n)
    return back.select("det_id", "sheet_id", *[F.round(c, 6).alias(c) for c in ("xc", "yc", "bw", "bh")], F.round(g.width(), 6).alias("w_back"))


@check("p2_box_geometry", "SELECT det_id, sheet_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h_px, (x2-x1)*(y2-y1) AS area, round(sqrt(pow(x2-x1,2)+pow(y2-y1,2)),6) AS diag, round((x2-x1)/greatest(y2-y1,1),6) AS aspect FROM det")
def _(v):
    d = g.with_box(v.det)
    return d.select("det_id", "sheet_id", "cx", "cy", "w", "h_px", "area", F.round("diag", 6).alias("diag"), F.round("aspect", 6).alias("aspect"))


@check("p3_node_type", f"SELECT cls_id, {TYPE} AS node_type, CAST(count(*) AS BIGINT) AS n FROM det GROUP BY 1,2")
def _(v):
    return boxes.with_node_type(v.det).groupBy("cls_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


@check("p4_supercategory", f"SELECT det_id, sheet_id, {SUPER} AS super FROM det WHERE {SUPER} IS NOT NULL")
def _(v):
    return boxes.remap(v.det).select("det_id", "sheet_id", "super")


@check("p5_label_kind", f"SELECT gt_id, sheet_id, label, CASE WHEN label IN ('valve','arrow','instrumentation') THEN 'scored' WHEN label IN ('tank','pump','general','inlet/outlet') THEN 'ignore' ELSE 'drop' END AS kind, {GSUPER} AS super FROM lab",
       lab="SELECT gt_id, sheet_id, label FROM gt UNION ALL SELECT ig_id, sheet_id, 'tank' FROM ignore_box UNION ALL SELECT det_id, sheet_id, node_type FROM vertex WHERE node_type IN ('connector','crossing')")
def _(v):
    lab = v.gt.select("gt_id", "sheet_id", "label").unionAll(v.ignore_box.select("ig_id", "sheet_id", F.lit("tank")))\
        .unionAll(v.vertex.filter("node_type in ('connector','crossing')").select("det_id", "sheet_id", "node_type"))
    return boxes.classify_labels(lab)


@check("p6_min_conf", "SELECT det_id, conf FROM det WHERE conf>=0.25")
def _(v):
    return boxes.min_conf(v.det, 0.25).select("det_id", "conf")


@check("p7_roi_filter", f"""SELECT det_id, sheet_id FROM ctr c WHERE CASE WHEN sheet_id IN (SELECT sheet_id FROM background)
  THEN NOT EXISTS (SELECT 1 FROM background b WHERE b.sheet_id=c.sheet_id AND cx BETWEEN b.x1 AND b.x2 AND cy BETWEEN b.y1 AND b.y2)
  ELSE cx BETWEEN {W}*0.04 AND {W}*0.96 AND cy BETWEEN {H}*0.04 AND {H}*0.96 END""",
       ctr="SELECT det_id, sheet_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM det")
def _(v):
    return boxes.roi_filter(v.det, v.background, W, H).select("det_id", "sheet_id")


@check("p8_dilate", f"SELECT det_id, sheet_id, greatest(0,CAST(trunc(x1) AS INT)-m) AS dx1, greatest(0,CAST(trunc(y1) AS INT)-m) AS dy1, least({W},CAST(trunc(x2) AS INT)+m) AS dx2, least({H},CAST(trunc(y2) AS INT)+m) AS dy2 FROM (SELECT *, CASE WHEN cls_id=22 THEN 15 ELSE 3 END AS m FROM det) q")
def _(v):
    d = v.det.withColumn("node_type", F.when(F.col("cls_id") == 22, "vessel").otherwise(g.node_type()))
    return boxes.with_dilated(d, W, H).select("det_id", "sheet_id", "dx1", "dy1", "dx2", "dy2")


@check("p9_border_flags", f"SELECT det_id, sheet_id, CAST(x1<100 OR x1>={W}-100 OR y1<100 OR y1>={H}-100 AS INT) AS near_border, CAST(x1<65 OR y1<65 OR x2>{W}-65 OR y2>{H}-65 AS INT) AS near_edge FROM det")
def _(v):
    return v.det.select("det_id", "sheet_id", g.near_border(F.col("x1"), F.col("y1"), W, H, 100).cast("int").alias("near_border"),
                        g.box_near_edge(W, H, 65).cast("int").alias("near_edge"))


@check("p10_orientation", "SELECT det_id, sheet_id, CASE WHEN (x2-x1)/greatest(y2-y1,1)>1.4 THEN 'Horizontal' WHEN (x2-x1)/greatest(y2-y1,1)<0.71 THEN 'Vertical' ELSE 'Square/diagonal' END AS orientation FROM det")
def _(v):
    return v.det.select("det_id", "sheet_id", g.orientation(g.width(), g.height()).alias("orientation"))


@check("p11_size_bucket", f"SELECT det_id, sheet_id, CASE WHEN d<8 OR (d<15 AND near) THEN 'b' WHEN d<30 THEN 'c' ELSE 'a' END AS bucket FROM (SELECT *, sqrt(pow((x2-x1)/4,2)+pow((y2-y1)/4,2)) AS d, x1<65 OR y1<65 OR x2>{W}-65 OR y2>{H}-65 AS near FROM det) q")
def _(v):
    return v.det.select("det_id", "sheet_id", g.size_bucket(g.width() / 4, g.height() / 4, g.box_near_edge(W, H, 65)).alias("bucket"))


@check("p12_edge_label", """SELECT sheet_id, u, v, lbl AS edge_type, CASE WHEN lbl IN ('direct','tip_to_junction','junction_to_junction') THEN 'TRACED' ELSE 'INFERRED' END AS provenance FROM (
 SELECT *, CASE WHEN v%5=4 THEN CASE WHEN u%2=0 THEN 'connector' ELSE 'crossing' END WHEN v%5=0 THEN 'short_gap' ELSE CASE branch_type WHEN 0 THEN 'direct' WHEN 1 THEN 'tip_to_junction' WHEN 2 THEN 'junction_to_junction' ELSE 'cycle' END END AS lbl FROM route) q""")
def _(v):
    code = F.when(F.col("v") % 5 == 4, None).when(F.col("v") % 5 == 0, -1).otherwise(F.col("branch_type"))
    via = F.when(F.col("v") % 5 == 4, F.when(F.col("u") % 2 == 0, "connector").otherwise("crossing"))
    d = v.route.withColumn("edge_type", g.edge_label(code, via))
    return d.select("sheet_id", "u", "v", "edge_type", g.provenance(F.col("edge_type")).alias("provenance"))


@check("p13_port_check", "SELECT sheet_id, node_id, n_ports FROM (SELECT v.sheet_id, v.node_id, v.node_type, CAST(count(*) AS INT) AS n_ports FROM vertex v JOIN (SELECT sheet_id, u AS n FROM edge UNION ALL SELECT sheet_id, v FROM edge) e ON e.sheet_id=v.sheet_id AND e.n=v.node_id GROUP BY 1,2,3) q WHERE node_type IN ('valve','instrument') AND n_ports>4 OR node_type='unknown_fitting' AND n_ports>2")
def _(v):
    e = v.edge
    ends = e.select("sheet_id", F.col("u").alias("node_id"), "v").unionAll(e.select("sheet_id", "v", "u"))
    ports = ends.groupBy("sheet_id", "node_id").agg(F.collect_list("v").alias("ports"))
    typed = v.vertex.withColumn("node_type", F.when(F.col("node_type") == "unknown_fitting", "off_page").otherwise(F.col("node_type")))
    return boxes.port_check(typed.join(ports, ["sheet_id", "node_id"])).select("sheet_id", "node_id", "n_ports")


@check("p15_crop_windows", f"""SELECT w.sheet_id, w.node_id, w.wx1, w.wy1, w.wx2, w.wy2, CAST(count(o.node_id) AS BIGINT) AS n_masks,
  CAST(coalesce(sum(CASE WHEN o.node_id IS NOT NULL THEN (CAST(least(o.x2,wx2)-wx1 AS INT)-CAST(greatest(o.x1,wx1)-wx1 AS INT))*(CAST(least(o.y2,wy2)-wy1 AS INT)-CAST(greatest(o.y1,wy1)-wy1 AS INT)) END),0) AS BIGINT) AS masked_px
FROM win w LEFT JOIN node o ON o.sheet_id=w.sheet_id AND o.node_type='instrument' AND o.node_id<>w.node_id AND greatest(o.x1,wx1)<least(o.x2,wx2) AND greatest(o.y1,wy1)<least(o.y2,wy2) GROUP BY 1,2,3,4,5,6""",
       win=f"SELECT sheet_id, node_id, greatest(0,CAST(x1 AS INT)-6) AS wx1, greatest(0,CAST(y1 AS INT)-6) AS wy1, least({W},CAST(x2 AS INT)+6) AS wx2, least({H},CAST(y2 AS INT)+6) AS wy2 FROM node WHERE node_type='instrument'")
def _(v):
    from sheetgraph.operators import suppress
    nodes = suppress.node_set(suppress.centroid(v.det))
    px = F.aggregate("masks", F.lit(0).cast("bigint"), lambda a, m: a + (m["x2"] - m["x1"]) * (m["y2"] - m["y1"]))
    return boxes.crop_windows(nodes, W, H).select(
        "sheet_id", "node_id", "wx1", "wy1", "wx2", "wy2", F.coalesce(F.size("masks"), F.lit(0)).cast("bigint").alias("n_masks"),
        F.coalesce(px, F.lit(0)).cast("bigint").alias("masked_px"))


@check("p16_polyline", """SELECT sheet_id, branch_id, string_agg(r||':'||c, ' ' ORDER BY k DESC) AS back, string_agg(CASE WHEN k%3=0 THEN r||':'||c END, ' ' ORDER BY k) AS thin, CAST(49 AS INT) AS there_and_back FROM branch_pt GROUP BY 1,2""")
def _(v):
    spell = lambda a: F.array_join(F.transform(a, lambda p: F.concat_ws(":", p["r"], p["c"])), " ")
    u, w = F.lit("u"), F.lit("v")
    back = polyline.oriented(F.col("coords"), u, w, w, u)
    return v.branch.select("sheet_id", "branch_id", spell(back).alias("back"), spell(polyline.thinned(F.col("coords"), 8)).alias("thin"),
                           F.size(polyline.joined(F.col("coords"), back)).alias("there_and_back"))


@check("p17_id_order", "SELECT sheet_id, node_id, det_id, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY CASE WHEN node_type IN ('connector','crossing') THEN 'junc' ELSE 'sym' END, node_id) AS BIGINT) AS pos FROM vertex")
def _(v):
    from sheetgraph.operators.ranking import numbered
    d = v.vertex.withColumn("gid", F.concat(F.when(F.col("node_type").isin("connector", "crossing"), "junc_").otherwise("sym_"), F.col("node_id")))
    prefix, number = text.id_order(F.col("gid"))
    d = numbered(d.withColumns({"pre": prefix, "num": number}), ["sheet_id"], F.struct("pre", F.floor(F.col("num") / 1000)), [F.col("pre"), F.col("num")], "pos")
    return d.select("sheet_id", "node_id", "det_id", (F.col("pos") + 1).alias("pos"))
