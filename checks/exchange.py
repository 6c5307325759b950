"""Documents, exports, streams and whole plans over the derived tables (S1 to S9, W1, W2 and the composed pipelines)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.answers import XNODE, xnode
from checks.reading import GT_TAG, gt_tags
from checks.sqlparts import FAM, TYPE, nms
from checks.views import H, W, area
from sheetgraph.operators.ranking import numbered
from sheetgraph.operators.stage import shared_folder, staged
from sheetgraph.params import BOX
from sheetgraph.plans import dataset, drawing, scoring
from sheetgraph.sources import documents, graphml, labels
from sheetgraph.streaming import ingest, jobs

QUERIES, ORACLES, check = area()


def exported(v):
    geo = v.vertex.select("sheet_id", F.concat(F.when(F.col("node_type").isin("connector", "crossing"), "junc_").otherwise("sym_"), "node_id").alias("id"), *BOX, "conf")
    return xnode(v).join(geo, ["sheet_id", "id"])


FULL = dict(XNODE, fx="SELECT x.*, v.x1, v.y1, v.x2, v.y2, v.conf FROM xnode x JOIN vertex v ON v.sheet_id=x.sheet_id AND concat(CASE WHEN v.node_type IN ('connector','crossing') THEN 'junc_' ELSE 'sym_' END, v.node_id)=x.id")


@check("s4_graph_documents", "SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, id, node_type, cls_name, x1, y1, x2, y2, round(conf,4) AS conf, CASE WHEN node_type='instrument' THEN tag_function END AS tag_function, CASE WHEN node_type='instrument' THEN raw_text END AS raw_text, CASE WHEN node_type='instrument' THEN parse_status END AS parse_status FROM fx", **FULL)
def _(v):
    n, _e = documents.read_graph_docs(documents.graph_docs(exported(v), v.xedge, 64))
    return n.select("sheet_id", "id", "node_type", "cls_name", *BOX, "conf", "tag_function", "raw_text", "parse_status")


@check("s4_graph_document_edges", "SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, u, v, branch_type FROM xedge")
def _(v):
    _n, e = documents.read_graph_docs(documents.graph_docs(exported(v), v.xedge, 64))
    return e.select("sheet_id", "u", "v", "branch_type")


@check("s5_graphml_export", "SELECT sheet_id, id, CASE node_type WHEN 'instrument' THEN 'instrumentation' WHEN 'off_page' THEN 'inlet/outlet' ELSE node_type END AS label, x1 AS xmin, y1 AS ymin, CASE WHEN node_type='instrument' AND parse_status IS NOT NULL THEN coalesce(tag_function,'') END AS tag_function, CASE WHEN node_type='instrument' THEN parse_status END AS parse_status FROM fx", **FULL)
def _(v):
    return graphml.graphml_rows(exported(v), v.xedge)[0].select("sheet_id", "id", "label", "xmin", "ymin", "tag_function", "parse_status")


@check("s7_baseline_document", "SELECT cls, concat('class ', cls) AS name, round(ap50,6) AS ap50, round(recall,6) AS recall FROM baseline")
def _(v):
    rows = v.baseline.withColumn("name", F.concat(F.lit("class "), "cls"))
    return documents.baseline_rows(documents.baseline_docs(rows)).select("cls", "name", "ap50", "recall")


@check("s3_prediction_documents", "SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY det_id)-1 AS BIGINT) AS det_id, cls_id, round(conf,4) AS conf, CAST(x1 AS INT) AS x1, CAST(y2 AS INT) AS y2 FROM det")
def _(v):
    d = v.det.withColumns({"cls_name": F.lit("c"), "width": F.lit(W), "height": F.lit(H)})
    return documents.prediction_rows(documents.prediction_docs(d, 64).drop("sheet_id")).select("sheet_id", "det_id", "cls_id", "conf", "x1", "y2")


@check("s3_prediction_headers", f"SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, {W} AS width, {H} AS height, CAST(count(*) AS INT) AS n_detections, 'best' AS model, 640 AS slice_size, CAST(NULL AS INT) AS imgsz, 0.2::DOUBLE AS overlap, 0.25::DOUBLE AS conf_threshold FROM det GROUP BY sheet_id")
def _(v):
    d = v.det.withColumns({"cls_name": F.lit("c"), "width": F.lit(W), "height": F.lit(H)})
    docs = documents.prediction_docs(d, 64, model="best", slice_size=640, overlap=0.2, conf_threshold=0.25)
    return documents.prediction_headers(docs.drop("sheet_id")).drop("iou_threshold", "inference_s")


def fresh(v, name: str) -> str:
    """A new folder in the cluster's shared folder."""
    return f"{shared_folder(v._s)}/{name}-{uuid.uuid4().hex}"


@check("s1_label_files", "SELECT CAST(i.sheet_id AS VARCHAR) AS image, CASE label WHEN 'valve' THEN 0 WHEN 'arrow' THEN 1 WHEN 'instrumentation' THEN 2 END AS cls_id, round(g.x1,3) AS x1, round(g.y1,3) AS y1, round(g.x2,3) AS x2, round(g.y2,3) AS y2 FROM image i LEFT JOIN gt g ON g.sheet_id=i.sheet_id")
def _(v):
    image = v.image.select(F.col("sheet_id").cast("string").alias("image"), "width", "height")
    cls = F.when(F.col("label") == "valve", 0).when(F.col("label") == "arrow", 1).otherwise(2)
    norm = lambda a, b, size: [((F.col(a) + F.col(b)) / 2 / F.col(size)), (F.col(b) - F.col(a)) / F.col(size)]
    (xc, bw), (yc, bh) = norm("x1", "x2", "width"), norm("y1", "y2", "height")
    rows = v.gt.withColumn("image", F.col("sheet_id").cast("string")).join(image, "image").select("image", cls.alias("cls_id"), xc.alias("xc"), yc.alias("yc"), bw.alias("bw"), bh.alias("bh"))
    labels.write_labels(rows, path := fresh(v, "labels"))
    return labels.read_labels(v._s, path, image).select("image", "cls_id", *[F.round(c, 3).alias(c) for c in BOX])


@check("s2_graphml_source", "SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, id AS node_id, CASE node_type WHEN 'instrument' THEN 'instrumentation' WHEN 'off_page' THEN 'inlet/outlet' ELSE node_type END AS label, x1, y1, x2, y2 FROM fx", **FULL)
def _(v):
    graphml.write_graphml(exported(v), v.xedge, path := fresh(v, "graphml"))
    return graphml.read_graphml(v._s, path)[0].select("sheet_id", "node_id", "label", *BOX)


@check("s2_graphml_source_edges", "SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, u, v, 'solid' AS edge_label FROM xedge", **FULL)
def _(v):
    graphml.write_graphml(exported(v), v.xedge, path := fresh(v, "graphml"))
    return graphml.read_graphml(v._s, path)[1].select("sheet_id", "u", "v", "edge_label")


@check("s6_tag_truth", "SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, CAST(node_id AS VARCHAR) AS gt_id, function, loop, label_status FROM gtt", gtt=GT_TAG)
def _(v):
    t = gt_tags(v).select("sheet_id", "node_id", "function", "loop", F.concat_ws(" ", "function", "loop").alias("raw_tag"), F.lit("sheet").alias("source"), "label_status")
    t.write.csv(path := fresh(v, "tags"), header=True)
    return documents.read_tags_gt(v._s, path).select("sheet_id", "gt_id", "function", "loop", "label_status")


def connectivity(v):
    """One document per sheet, of its vertices as symbols and its edges as connections."""
    s = v.vertex.select("sheet_id", F.struct(F.col("node_id").alias("id"), F.col("cls_id").alias("cls"), ((F.col("x1") + F.col("x2")) / 2).alias("cx_px"), ((F.col("y1") + F.col("y2")) / 2).alias("cy_px"), (F.col("x2") - F.col("x1")).alias("w_px"), (F.col("y2") - F.col("y1")).alias("h_px")).alias("s"))
    c = v.edge.select("sheet_id", F.struct(F.col("u").alias("from_id"), F.col("v").alias("to_id"), F.when((F.col("u") + F.col("v")) % 9 == 0, "signal").otherwise("process").alias("type")).alias("c"))
    d = s.groupBy("sheet_id").agg(F.collect_list("s").alias("symbols")).join(c.groupBy("sheet_id").agg(F.collect_list("c").alias("connections")), "sheet_id", "left")
    d.select("sheet_id", F.to_json(F.struct(F.col("sheet_id").cast("string").alias("sheet"), "symbols", "connections")).alias("value")).repartition("sheet_id").write.partitionBy("sheet_id").text(path := fresh(v, "synth"))
    return documents.read_connectivity(v._s, path)


@check("s8_connectivity_nodes", f"SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, node_id, cls_id, {TYPE} AS node_type, x1, y1, x2, y2 FROM vertex")
def _(v):
    return connectivity(v)[0].select("sheet_id", "node_id", "cls_id", "node_type", *BOX)


@check("s8_connectivity_edges", "SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, u, v, CASE WHEN (u+v)%9=0 THEN 'signal' ELSE 'process' END AS edge_label FROM edge")
def _(v):
    return connectivity(v)[1]


@check("s9_questions", "SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) AS INT) AS id, role AS expected_kind, text AS question, 'find_nodes' AS tool, CAST(turn AS VARCHAR) AS expected FROM conversations")
def _(v):
    given = v._s.read.parquet(f"{v._d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    q = numbered(given.withColumn("all", F.lit(1)), ["all"], F.floor(F.col("conv_id") / 16), [F.col("conv_id"), F.col("turn")], "n")
    one = F.struct((F.col("n") + 1).cast("int").alias("id"), F.col("role").alias("expected_kind"), F.col("text").alias("question"), F.array(F.lit("find_nodes")).alias("tools"), "turn")
    docs = q.groupBy(F.floor(F.col("conv_id") / 16).alias("block")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("questions"))).alias("value"))
    docs.select("block", F.replace("value", F.lit('"turn":'), F.lit('"expected":')).alias("value")).repartition("block").write.partitionBy("block").text(path := fresh(v, "questions"))
    return documents.read_questions(v._s, path).select("id", "expected_kind", "question", F.col("tools")[0].alias("tool"), "expected")


# documents carry four decimals and numbers in the order of the ids; a sheet's parts come in several batches
@check("w1_stream_ingest", f"SELECT CAST(sheet_id AS VARCHAR) AS sheet_id, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY {FAM}, conf DESC, det_id)-1 AS BIGINT) AS node_id, {TYPE} AS node_type, x1, y1 FROM (SELECT p.* FROM w1_box p JOIN nms_walk n ON n.sheet_id=p.sheet_id AND n.det_id=p.det_id WHERE n.keep) q",
       w1_box=f"SELECT * FROM (SELECT sheet_id, lpad(CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY det_id)-1 AS VARCHAR), 9, '0') AS det_id, cls_id, round(conf,4) AS conf, x1, y1, x2, y2 FROM det) d WHERE (x1+x2)/2 BETWEEN {W}*0.04 AND {W}*0.96 AND (y1+y2)/2 BETWEEN {H}*0.04 AND {H}*0.96", **nms("w1_box", FAM))
def _(v):
    spark, d = v._s, v.det.withColumns({"cls_name": F.lit("c"), "width": F.lit(W), "height": F.lit(H)})
    docs, path = staged(documents.prediction_docs(d, 64).drop("sheet_id")), fresh(v, "predictions")
    # first parts and later parts of all sheets as two sets of two files; written by folder, so that no task sorts a whole set
    for later in ("false", "true"):
        docs.filter(f"(part > 0) = {later}").drop("part").repartition(2).write.json(f"{path}/later={later}")
    ingest.ingest(spark, path, sink := fresh(v, "nodes"), fresh(v, "stream"), W, H, files_per_batch=3, multi_line=False).awaitTermination()
    return spark.read.parquet(sink).select("sheet_id", "node_id", "node_type", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1")])


@check("w2_job_state", "SELECT job_id, arg_max(stage,(ts,seq)) AS stage, round(arg_max(value,(ts,seq)),6) AS value, CAST(count(*) AS BIGINT) AS n_events FROM job_event GROUP BY 1")
def _(v):
    return jobs.job_state(v.job_event).select("job_id", "stage", F.round("value", 6).alias("value"), "n_events")


@check("plan_sheet_graph")
def _(v):
    _v, e = drawing.sheet_graph(v.det, v.background, v.ink, v.branch, W, H)
    return e.select("sheet_id", "u", "v", "branch_id", "via", "short_gap", "flow_direction", F.size("coords").alias("n_points"))


@check("plan_detection_scoring")
def _(v):
    d = scoring.score_detections(v.det, v.gt, v.ignore_box)
    return d.select("name", "n_gt", "n_tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ap50", "ap30", "center25", "center50")])


@check("plan_dataset_build", tables=("det", "image"))
def _(v):
    real = (v.image, v.gt.withColumn("cls_id", F.lit(0)))
    synth = (v.image.withColumn("sheet_id", F.col("sheet_id") + 1000000), v.gt.withColumn("sheet_id", F.col("sheet_id") + 1000000))
    return dataset.build(real, synth)
