"""Tag reading and scoring (X1-X6, P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import area
from sheetgraph.functions import text
from sheetgraph.operators import tags

QUERIES, ORACLES, check = area()

TAG = dict(
    asm="SELECT sheet_id, node_id, list(t ORDER BY y_center, line_no) FILTER (t<>'') AS texts, avg(conf) AS tag_confidence FROM (SELECT *, trim(regexp_replace(txt,'\\s+',' ','g')) AS t FROM ocr_line) q GROUP BY 1,2",
    up="SELECT *, array_to_string(texts,' ') AS raw_text, upper(array_to_string(texts,' ')) AS j, upper(texts[1]) AS a, upper(texts[-1]) AS b, len(texts) AS n FROM asm",
    st="""SELECT *, CASE WHEN n=0 THEN 'failed' WHEN n>=2 AND regexp_matches(a,'^[A-Z]{1,5}$') AND regexp_matches(b,'^\\d{2,6}[A-Z]{0,2}$') THEN 'ok' WHEN n>=2 AND regexp_matches(a,'^[A-Z]{1,5}$') AND regexp_matches(b,'^X{2,6}$') THEN 'ok_placeholder'
 WHEN regexp_matches(j,'^([A-Z]{1,5})[\\s\\-]?(\\d{2,6}[A-Z]{0,2}|X{2,6})$') THEN 'single_line_split' WHEN n=1 THEN 'single_line_unsplit' ELSE 'failed' END AS parse_status FROM up""",
    tag="""SELECT sheet_id, node_id, raw_text, tag_confidence, parse_status, CASE WHEN parse_status IN ('ok','ok_placeholder') THEN a WHEN parse_status='single_line_split' THEN regexp_extract(j,'^([A-Z]{1,5})[\\s\\-]?(\\d{2,6}[A-Z]{0,2}|X{2,6})$',1) END AS tag_function,
 CASE WHEN parse_status IN ('ok','ok_placeholder') THEN b WHEN parse_status='single_line_split' THEN regexp_extract(j,'^([A-Z]{1,5})[\\s\\-]?(\\d{2,6}[A-Z]{0,2}|X{2,6})$',2) END AS loop_number FROM st""")

# ground-truth tags of the derived instruments: most as read, some with another number, some placeholders or unreadable
GT_TAG = """SELECT sheet_id, node_id, CASE h%6 WHEN 0 THEN 'PT' WHEN 1 THEN 'TCV' WHEN 2 THEN 'PSV' WHEN 3 THEN 'FT' WHEN 4 THEN 'PSV' ELSE 'AORV' END AS function,
 CASE WHEN h%6=5 THEN 'XXX' ELSE CAST((CASE WHEN h%6=3 THEN 100+h%900 ELSE 1400+h%600 END)+(CASE WHEN h%13=0 THEN 1 ELSE 0 END) AS VARCHAR(8)) END AS loop, CASE WHEN h%97=0 THEN 'unreadable' WHEN h%6=5 THEN 'placeholder' ELSE 'ok' END AS label_status FROM vertex WHERE node_type='instrument'"""


def reads(v):
    return tags.parse(tags.assemble(v.ocr_line))


def gt_tags(v):
    from checks.views import register
    register("gt_tag", GT_TAG)
    return v.gt_tag


PAIR = dict(TAG, gtt=GT_TAG, pr="""SELECT g.sheet_id, g.node_id, label_status, coalesce(upper(trim(function||' '||loop)),'') AS want, coalesce(upper(trim(t.tag_function||' '||t.loop_number)),'') AS got, CASE WHEN t.node_id IS NULL THEN 0 ELSE 1 END AS matched
 FROM gtt g LEFT JOIN tag t ON t.sheet_id=g.sheet_id AND t.node_id=g.node_id WHERE label_status<>'unreadable'""")


def pairs(v):
    return tags.scored(gt_tags(v), reads(v), id="node_id")


@check("p14_tag_display", "SELECT sheet_id, node_id, CASE WHEN parse_status IN ('ok','ok_placeholder') THEN trim(coalesce(tag_function,'')||' '||coalesce(loop_number,'')) WHEN raw_text<>'' THEN '? '||raw_text ELSE '? (unread)' END AS display FROM tag", **TAG)
def _(v):
    return reads(v).select("sheet_id", "node_id", text.tag_display(F.col("tag_function"), F.col("loop_number"), F.col("raw_text"), F.col("parse_status")).alias("display"))


@check("x1_line_assembly", "SELECT sheet_id, node_id, raw_text, CAST(n AS INT) AS n_lines, round(tag_confidence,6) AS tag_confidence FROM up", **TAG)
def _(v):
    return tags.assemble(v.ocr_line).select("sheet_id", "node_id", "raw_text", F.size("texts").alias("n_lines"), F.round("tag_confidence", 6).alias("tag_confidence"))


@check("x2_tag_parse", "SELECT sheet_id, node_id, tag_function, loop_number, parse_status FROM tag", **TAG)
def _(v):
    return reads(v).select("sheet_id", "node_id", "tag_function", "loop_number", "parse_status")


@check("x3_normalised_tag", "SELECT sheet_id, node_id, coalesce(upper(trim(tag_function||' '||loop_number)),'') AS tag FROM tag", **TAG)
def _(v):
    return reads(v).select("sheet_id", "node_id", text.normalised_tag(F.col("tag_function"), F.col("loop_number")).alias("tag"))


@check("x4_character_errors", "SELECT label_status, CAST(sum(levenshtein(want,got)) AS BIGINT) AS edits, CAST(sum(greatest(1,length(want))) AS BIGINT) AS chars, round(sum(levenshtein(want,got))/sum(greatest(1,length(want))),6) AS cer FROM pr GROUP BY 1", **PAIR)
def _(v):
    return tags.cer(pairs(v), ["label_status"]).withColumn("cer", F.round("cer", 6))


@check("x5_exact_match", """SELECT label_status, CAST(count(*) AS BIGINT) AS n, CAST(count_if(want=got) AS BIGINT) AS exact, CAST(count_if(matched=0) AS BIGINT) AS unmatched, round(count_if(want=got)/count(*),6) AS accuracy,
 CAST(CASE WHEN label_status='ok' THEN count_if(want=got)/count(*)>=0.9 WHEN label_status IS NULL THEN count_if(want=got)/count(*)>=0.8 END AS INT) AS passed FROM pr GROUP BY ROLLUP(label_status)""", **PAIR)
def _(v):
    return tags.exact_match(pairs(v)).withColumn("accuracy", F.round("accuracy", 6))


@check("x6_rejected_noise", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(st) AS BIGINT) AS found, CAST(count_if(st='failed') AS BIGINT) AS rejected FROM (
 SELECT p.sheet_id, p.ig_id, arg_min(t.parse_status, (pow((p.x1+p.x2)/2-(n.x1+n.x2)/2,2)+pow((p.y1+p.y2)/2-(n.y1+n.y2)/2,2), n.node_id)) AS st FROM ignore_box p LEFT JOIN (vertex n JOIN tag t ON t.sheet_id=n.sheet_id AND t.node_id=n.node_id) ON n.sheet_id=p.sheet_id AND pow((p.x1+p.x2)/2-(n.x1+n.x2)/2,2)+pow((p.y1+p.y2)/2-(n.y1+n.y2)/2,2)<14400 GROUP BY 1,2) q""", **TAG)
def _(v):
    from sheetgraph.functions import geometry as g
    from sheetgraph.operators import match
    inst = v.vertex.filter("node_type='instrument'")
    t = reads(v).select("sheet_id", "node_id", "parse_status")
    probes = v.ignore_box.select("sheet_id", F.col("ig_id").alias("probe_id"), g.cx().alias("x"), g.cy().alias("y"))
    return tags.rejected(match.nearest(probes, inst, 120).join(t, ["sheet_id", "node_id"], "left"))
