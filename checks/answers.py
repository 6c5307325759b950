"""Lookups and transcript checks (Q1-Q15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.reading import TAG, reads
from checks.views import area, register
from sheetgraph import params as P
from sheetgraph.operators import grounding, lookup

QUERIES, ORACLES, check = area()

_CLS = "CASE cls_id " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in P.CLASS_NAMES.items()) + " END"
_ID = "concat(CASE WHEN node_type IN ('connector','crossing') THEN 'junc_' ELSE 'sym_' END, {0})"
register("xedge", """SELECT e.sheet_id, concat(CASE WHEN a.node_type IN ('connector','crossing') THEN 'junc_' ELSE 'sym_' END, a.node_id) AS u, concat(CASE WHEN b.node_type IN ('connector','crossing') THEN 'junc_' ELSE 'sym_' END, b.node_id) AS v,
 CASE (e.u+e.v)%5 WHEN 0 THEN 'short_gap' WHEN 1 THEN 'direct' WHEN 2 THEN 'tip_to_junction' WHEN 3 THEN 'connector' ELSE 'junction_to_junction' END AS branch_type FROM edge e JOIN vertex a ON a.sheet_id=e.sheet_id AND a.node_id=e.u JOIN vertex b ON b.sheet_id=e.sheet_id AND b.node_id=e.v""")
register("xbase", f"SELECT sheet_id, node_id, {_ID.format('node_id')} AS id, CASE WHEN cls_id=22 AND node_type='unknown_fitting' THEN 'off_page' ELSE node_type END AS node_type, {_CLS} AS cls_name FROM vertex")
XNODE = dict(TAG, xnode="SELECT b.sheet_id, b.id, b.node_type, b.cls_name, t.tag_function, t.loop_number, t.raw_text, t.parse_status FROM xbase b LEFT JOIN tag t ON t.sheet_id=b.sheet_id AND t.node_id=b.node_id")
# requests: one per detection of a class, asking for various filters
register("request", f"""SELECT sheet_id, det_id AS req_id, CASE h%7 WHEN 0 THEN 'valve' WHEN 1 THEN 'instrument' END AS want_node_type, CASE h%7 WHEN 2 THEN {_CLS} END AS want_cls_name, CASE h%7 WHEN 3 THEN 'PT' WHEN 4 THEN 'ZZ' END AS want_function,
 CASE h%7 WHEN 5 THEN '14' ELSE CASE WHEN h%35=1 THEN 'ft-9' ELSE CASE WHEN h%63=6 THEN 'nothing' END END END AS want_contains FROM det WHERE cls_id IN (23,24)""")
register("wanted", "SELECT sheet_id, concat('sym_', CAST(h%140 AS VARCHAR(8))) AS id, min(det_id) AS req_id FROM det WHERE cls_id IN (23,24,29) GROUP BY 1,2")
register("term", """SELECT sheet_id, det_id AS term_id, CASE h%6 WHEN 0 THEN 'valve' WHEN 1 THEN 'reducer' WHEN 2 THEN 'PSV' WHEN 3 THEN '14' WHEN 4 THEN 'pump' ELSE 'angle_valve' END AS term FROM det WHERE cls_id IN (23,24)""")
# turns: every message as a question and an answer with appended literals; two or three calls each
register("turns", """SELECT conv_id*100+turn AS turn_id, conv_id%(SELECT max(sheet_id)+1 FROM image) AS sheet_id,
 concat(text, CASE (conv_id+turn)%7 WHEN 0 THEN concat(' What connects to sym_', turn, '?') WHEN 1 THEN ' Is this sheet safe?' WHEN 2 THEN concat(' Trace the line from sym_', turn, ' to sym_999.') WHEN 3 THEN ' How many reducer nodes carry PT?' WHEN 4 THEN ' Count the valves with ''14'' in them.' WHEN 5 THEN ' Is it a well-designed instrument layout?' ELSE ' angle_valve with ''PT 14''' END) AS question,
 concat(text, CASE (conv_id*3+turn)%5 WHEN 0 THEN concat(' sym_', turn, ' and sym_', turn+1) WHEN 1 THEN ' It looks adequate, see sym_3.' WHEN 2 THEN ' None found.' WHEN 3 THEN ' junc_4 is next to sym_2.' ELSE ' There are 12.' END) AS answer, conv_id, turn FROM conversations""")
register("tcall", """SELECT turn_id, 1 AS seq, 'list_systems_or_lines' AS name, CAST(NULL AS VARCHAR(20)) AS a_id, CAST(NULL AS VARCHAR(20)) AS a_cls, CAST(NULL AS VARCHAR(20)) AS a_fn, CAST(NULL AS VARCHAR(20)) AS a_sub,
 concat('{"instrument_tags":[{"id":"sym_3","function":"PT","loop_number":"14', turn, '","raw_text":"PT 14', turn, '"}],"off_page_connectors":["heat_exchanger"]}') AS result FROM turns WHERE (conv_id+turn)%3<>0
 UNION ALL SELECT turn_id, 2, 'find_nodes', NULL, CASE WHEN turn%2=0 THEN 'reducer' ELSE 'angle_valve' END, CASE WHEN conv_id%3=0 THEN 'PT' WHEN conv_id%3=1 THEN 'QQ' END, CASE WHEN conv_id%4=0 THEN 'pt 14' WHEN conv_id%4=1 THEN '99' END, concat('{"matches":[{"id":"sym_', turn+1, '"}]}') FROM turns WHERE (conv_id+turn)%2=0
 UNION ALL SELECT turn_id, 3, 'get_neighbors', concat('sym_', turn), NULL, NULL, NULL, concat('[{"neighbor_id":"junc_', turn, '"}]') FROM turns WHERE (conv_id+turn)%7=0""")


def xnode(v):
    t = reads(v).drop("tag_confidence", "texts")
    return v.xbase.join(t, ["sheet_id", "node_id"], "left").drop("node_id")


def calls(v):
    args = F.map_filter(F.create_map(*[x for k, c in (("id", "a_id"), ("cls_name", "a_cls"), ("tag_function", "a_fn"), ("tag_contains", "a_sub")) for x in (F.lit(k), F.col(c))]), lambda k, x: x.isNotNull())
    return v.tcall.select("turn_id", "seq", "name", args.alias("args"), "result")


FIT = "(r.want_node_type IS NULL OR n.node_type=r.want_node_type) AND (r.want_cls_name IS NULL OR n.cls_name=r.want_cls_name) AND (r.want_function IS NULL OR coalesce(n.tag_function=r.want_function,false))"
SUMM = "CASE WHEN length(tag_function)>0 AND length(loop_number)>0 THEN tag_function||'-'||loop_number END"
FIND = dict(XNODE, fnd=f"SELECT r.sheet_id, r.req_id, n.id, n.node_type, n.cls_name, {SUMM} AS tag_summary FROM request r JOIN xnode n ON n.sheet_id=r.sheet_id AND {FIT} AND (r.want_contains IS NULL OR contains(lower(coalesce(n.raw_text,'')), lower(r.want_contains)))")


@check("q1_find_nodes", "SELECT * FROM fnd", **FIND)
def _(v):
    return lookup.find_nodes(xnode(v), v.request)


OKREAD = "node_type='instrument' AND parse_status IN ('ok','ok_placeholder','single_line_split','single_line_unsplit')"


@check("q1_alternatives", f"""SELECT r.sheet_id, r.req_id, k.kind, k.existing FROM (SELECT *, CASE WHEN want_function IS NOT NULL THEN 'function' ELSE 'text' END AS kind FROM request r WHERE (want_function IS NOT NULL OR want_contains IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM fnd f WHERE f.sheet_id=r.sheet_id AND f.req_id=r.req_id)) r
 JOIN (SELECT DISTINCT sheet_id, 'function' AS kind, tag_function AS existing FROM xnode WHERE {OKREAD} AND tag_function<>'' UNION SELECT DISTINCT sheet_id, 'text', raw_text FROM xnode WHERE {OKREAD} AND raw_text<>'') k ON k.sheet_id=r.sheet_id AND k.kind=r.kind""", **FIND)
def _(v):
    return lookup.find_alternatives(xnode(v), v.request).select("sheet_id", "req_id", "kind", "existing")


@check("q2_get_node", "SELECT w.sheet_id, w.id, w.req_id, n.node_type, n.cls_name, n.raw_text, CASE WHEN n.id IS NULL THEN 'not_found' END AS error FROM wanted w LEFT JOIN xnode n ON n.sheet_id=w.sheet_id AND n.id=w.id", **XNODE)
def _(v):
    return lookup.get_node(xnode(v), v.wanted).select("sheet_id", "id", "req_id", "node_type", "cls_name", "raw_text", "error")


NEI = dict(XNODE, adj="SELECT sheet_id, u AS id, v AS neighbor_id, branch_type FROM xedge UNION ALL SELECT sheet_id, v, u, branch_type FROM xedge",
           nei=f"SELECT a.*, n.node_type AS neighbor_node_type, n.cls_name AS neighbor_cls_name, {SUMM} AS neighbor_tag_summary, CASE WHEN branch_type IN ('direct','tip_to_junction','junction_to_junction') THEN 'TRACED' ELSE 'INFERRED' END AS provenance FROM adj a LEFT JOIN xnode n ON n.sheet_id=a.sheet_id AND n.id=a.neighbor_id")
NEI_COLS = ["sheet_id", "req_id", "id", "neighbor_id", "neighbor_node_type", "neighbor_tag_summary", "provenance", "error"]


@check("q3_get_neighbors", "SELECT w.sheet_id, w.req_id, w.id, n.neighbor_id, neighbor_node_type, neighbor_tag_summary, provenance, NULL AS error FROM wanted w JOIN nei n ON n.sheet_id=w.sheet_id AND n.id=w.id UNION ALL SELECT sheet_id, req_id, id, NULL, NULL, NULL, NULL, 'not_found' FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM xnode n WHERE n.sheet_id=w.sheet_id AND n.id=w.id)", **NEI)
def _(v):
    return lookup.get_neighbors(xnode(v), v.xedge, v.wanted).select(*NEI_COLS)


@check("q4_count_nodes", f"SELECT r.sheet_id, r.req_id, NULL AS node_type, CAST(count(n.id) AS BIGINT) AS n FROM request r LEFT JOIN xnode n ON n.sheet_id=r.sheet_id AND {FIT} GROUP BY 1,2 UNION ALL SELECT r.sheet_id, r.req_id, n.node_type, CAST(count(*) AS BIGINT) FROM request r JOIN xnode n ON n.sheet_id=r.sheet_id WHERE want_node_type IS NULL AND want_cls_name IS NULL AND want_function IS NULL GROUP BY 1,2,3", **XNODE)
def _(v):
    return lookup.count_nodes(xnode(v), v.request)


@check("q5_list_tags", f"SELECT sheet_id, 'instrument_tag' AS kind, id, tag_function, loop_number, raw_text FROM xnode WHERE {OKREAD} UNION ALL SELECT DISTINCT sheet_id, 'off_page', NULL, NULL, NULL, cls_name FROM xnode WHERE node_type='off_page'", **XNODE)
def _(v):
    return lookup.list_tags(xnode(v))


@check("q6_resolve_term", """SELECT sheet_id, term_id, term, CASE WHEN term IN ('valve','instrument','unknown_fitting','flow_arrow','off_page','vessel') THEN 'node_type' WHEN nt IS NOT NULL THEN 'cls_name' WHEN f THEN 'tag_function' WHEN k>0 THEN 'tag_contains' ELSE 'unknown' END AS axis, CAST(k AS BIGINT) AS n_contains FROM (
 SELECT t.*, (SELECT min(node_type) FROM xnode n WHERE n.sheet_id=t.sheet_id AND n.cls_name=t.term) AS nt, EXISTS (SELECT 1 FROM xnode n WHERE n.sheet_id=t.sheet_id AND n.tag_function=t.term) AS f, (SELECT count(*) FROM xnode n WHERE n.sheet_id=t.sheet_id AND contains(lower(n.raw_text),lower(t.term))) AS k FROM term t) q""", **XNODE)
def _(v):
    return lookup.resolve_term(xnode(v), v.term).select("sheet_id", "term_id", "term", "axis", "n_contains")


@check("q6_term_matches", "SELECT DISTINCT t.sheet_id, t.term_id, n.id FROM term t JOIN xnode n ON n.sheet_id=t.sheet_id AND contains(lower(n.raw_text),lower(t.term))", **XNODE)
def _(v):
    return lookup.term_matches(xnode(v), v.term)


IDS = dict(
    aid="SELECT DISTINCT turn_id, unnest(regexp_extract_all(answer,'\\b(?:sym|junc)_\\d+\\b')) AS id FROM turns",
    kid="SELECT turn_id, unnest(regexp_extract_all(question,'\\b(?:sym|junc)_\\d+\\b')) AS id FROM turns UNION SELECT turn_id, unnest(regexp_extract_all(concat_ws(' ',a_id,a_cls,a_fn,a_sub,result),'\\b(?:sym|junc)_\\d+\\b')) FROM tcall",
    unc="SELECT * FROM aid a WHERE NOT EXISTS (SELECT 1 FROM kid k WHERE k.turn_id=a.turn_id AND k.id=a.id)")
LIST = dict(
    lst="SELECT turn_id, unnest(['PT', '14'||(turn_id%100), 'PT 14'||(turn_id%100), 'heat_exchanger']) AS listed FROM tcall WHERE name='list_systems_or_lines'",
    ung="SELECT turn_id, seq, name, 'tag_function' AS arg, a_fn AS value FROM tcall c WHERE name='find_nodes' AND a_fn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lst l WHERE l.turn_id=c.turn_id AND l.listed=a_fn) UNION ALL SELECT turn_id, seq, name, 'tag_contains', a_sub FROM tcall c WHERE name='find_nodes' AND a_sub IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lst l WHERE l.turn_id=c.turn_id AND contains(lower(l.listed),lower(a_sub)))")
_W = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in __import__("sheetgraph.functions.text", fromlist=["x"]).NODE_TYPE_WORDS.items())
FILT = dict(XNODE, 
    wrd="SELECT DISTINCT turn_id, sheet_id, unnest(regexp_extract_all(question,'[A-Za-z][A-Za-z0-9_]*')) AS word FROM turns",
    axs=f"SELECT turn_id, 'node_type' AS axis, CASE lower(word) {_W} END AS value FROM wrd UNION SELECT w.turn_id, 'cls_name', word FROM wrd w JOIN xnode n ON n.sheet_id=w.sheet_id AND n.cls_name=w.word UNION SELECT w.turn_id, 'tag_function', word FROM wrd w JOIN xnode n ON n.sheet_id=w.sheet_id AND n.tag_function=w.word",
    one="SELECT turn_id, axis, max(value) AS value FROM axs WHERE value IS NOT NULL GROUP BY 1,2 HAVING count(*)=1",
    qot="""SELECT turn_id, sheet_id, CASE WHEN len(q)=1 THEN q[1] END AS exp_tag_contains FROM (SELECT turn_id, sheet_id, regexp_extract_all(question, '[''"]([^''"]+)[''"]', 1) AS q FROM turns) z""",
    ef="SELECT q.turn_id, q.exp_tag_contains, a.value AS exp_node_type, b.value AS exp_cls_name, c.value AS exp_tag_function FROM qot q LEFT JOIN one a ON a.turn_id=q.turn_id AND a.axis='node_type' LEFT JOIN one b ON b.turn_id=q.turn_id AND b.axis='cls_name' LEFT JOIN one c ON c.turn_id=q.turn_id AND c.axis='tag_function'",
    inc="SELECT * FROM ef WHERE exp_cls_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tcall c WHERE c.turn_id=ef.turn_id AND name='find_nodes' AND a_cls=exp_cls_name AND (exp_tag_function IS NULL OR a_fn=exp_tag_function) AND (exp_tag_contains IS NULL OR contains(lower(coalesce(a_sub,'')),lower(exp_tag_contains))))")
_T = __import__("sheetgraph.functions.text", fromlist=["x"])
JUDGE = dict(vg=f"SELECT turn_id, regexp_extract(answer, '{_T.VERDICT_PATTERN}') AS word FROM turns WHERE regexp_matches(question, '{_T.JUDGEMENT_PATTERN}')")
ALLV = dict(IDS, **LIST, **FILT, **JUDGE,
    vio="SELECT turn_id, 'uncited_id' AS kind, id AS detail FROM unc UNION ALL SELECT turn_id, 'ungrounded_query', name||'('||arg||'='||value||')' FROM ung UNION ALL SELECT turn_id, 'incomplete_filter', exp_cls_name FROM inc UNION ALL SELECT turn_id, 'verdict', lower(word) FROM vg WHERE word<>''",
    ver="SELECT t.turn_id, CAST(coalesce(count_if(kind='uncited_id'),0) AS BIGINT) AS uncited_id, CAST(coalesce(count_if(kind='ungrounded_query'),0) AS BIGINT) AS ungrounded_query, CAST(coalesce(count_if(kind='incomplete_filter'),0) AS BIGINT) AS incomplete_filter, CAST(coalesce(count_if(kind='verdict'),0) AS BIGINT) AS verdict, CAST(count(kind)=0 AS INT) AS ok FROM turns t LEFT JOIN vio v ON v.turn_id=t.turn_id GROUP BY 1")


@check("q7_uncited_ids", "SELECT turn_id, id FROM unc", **IDS)
def _(v):
    return grounding.uncited_ids(v.turns, calls(v))


@check("q8_ungrounded_queries", "SELECT turn_id, CAST(seq AS INT) AS seq, name, arg, value FROM ung", **LIST)
def _(v):
    return grounding.ungrounded_queries(calls(v)).select("turn_id", "seq", "name", "arg", "value")


@check("q9_expected_filters", "SELECT turn_id, exp_tag_contains, exp_node_type, exp_cls_name, exp_tag_function FROM ef", **FILT)
def _(v):
    return grounding.expected_filters(v.turns, xnode(v)).drop("sheet_id")


@check("q10_incomplete_filters", "SELECT turn_id, exp_cls_name FROM inc", **FILT)
def _(v):
    return grounding.incomplete_filters(grounding.expected_filters(v.turns, xnode(v)), calls(v)).select("turn_id", "exp_cls_name")


@check("q11_intent", f"SELECT turn_id, CASE WHEN regexp_matches(question,'{_T.TRAVERSAL_PATTERN}') THEN 'traversal' WHEN regexp_matches(question,'{_T.JUDGEMENT_PATTERN}') THEN 'judgement' ELSE 'lookup' END AS intent FROM turns")
def _(v):
    return grounding.intent(v.turns).select("turn_id", "intent")


@check("q11_verdicts", "SELECT turn_id, word FROM vg WHERE word<>''", **JUDGE)
def _(v):
    return grounding.verdicts_given(v.turns)


@check("q12_grounding", "SELECT * FROM ver", **ALLV)
def _(v):
    return grounding.grounding(v.turns, calls(v), xnode(v))


@check("q13_refusal_facts", f"""SELECT t.turn_id, 'neighbour' AS fact, t.id, coalesce(n.neighbor_id, CASE WHEN x.id IS NULL THEN 'not_found' END) AS detail, n.provenance AS note FROM (SELECT DISTINCT turn_id, sheet_id, unnest(regexp_extract_all(question,'\\b(?:sym|junc)_\\d+\\b')) AS id FROM it WHERE intent='traversal') t LEFT JOIN xnode x ON x.sheet_id=t.sheet_id AND x.id=t.id LEFT JOIN nei n ON n.sheet_id=t.sheet_id AND n.id=t.id AND x.id IS NOT NULL WHERE x.id IS NULL OR n.id IS NOT NULL
 UNION ALL SELECT t.turn_id, 'count', n.node_type, CAST(count(*) AS VARCHAR), NULL FROM it t JOIN xnode n ON n.sheet_id=t.sheet_id WHERE intent='judgement' GROUP BY 1,3 UNION ALL SELECT t.turn_id, 'tag', n.id, n.raw_text, n.tag_function FROM it t JOIN xnode n ON n.sheet_id=t.sheet_id AND {OKREAD} WHERE intent='judgement' AND contains(lower(question),'instrument')""",
       **NEI, it=f"SELECT *, CASE WHEN regexp_matches(question,'{_T.TRAVERSAL_PATTERN}') THEN 'traversal' WHEN regexp_matches(question,'{_T.JUDGEMENT_PATTERN}') THEN 'judgement' ELSE 'lookup' END AS intent FROM turns")
def _(v):
    return grounding.refusal_facts(v.turns, xnode(v), v.xedge)


@check("q14_expected_answers", """SELECT sheet_id, 'count_by_type' AS question, node_type AS item, CAST(count(*) AS VARCHAR) AS value FROM xnode GROUP BY 1,3 UNION ALL SELECT sheet_id, 'ids_of_class', id, cls_name FROM xnode WHERE cls_name='control_valve_diaphragm'
 UNION ALL SELECT sheet_id, 'loops_of_function', id, loop_number FROM xnode WHERE node_type='instrument' AND tag_function='PT' UNION ALL SELECT sheet_id, 'neighbours', neighbor_id, provenance FROM nei WHERE id='sym_0'""", **NEI)
def _(v):
    return lookup.expected(xnode(v), v.xedge, "control_valve_diaphragm", "PT", "sym_0")


QST = "SELECT turn_id, CASE (conv_id+turn)%4 WHEN 0 THEN 'found' WHEN 1 THEN 'not_found' WHEN 2 THEN 'refusal_required' ELSE 'found' END AS kind, CASE WHEN turn%2=0 THEN 'find_nodes' ELSE 'get_neighbors' END AS tool, CASE WHEN turn%2=0 THEN 'reducer' ELSE concat('sym_', turn) END AS want, CASE WHEN turn%2=0 THEN concat('{\"matches\":[{\"id\":\"sym_', turn+CASE WHEN conv_id%5=0 THEN 2 ELSE 1 END, '\"}]}') ELSE concat('[{\"neighbor_id\":\"junc_', turn, '\"}]') END AS expected FROM turns"
register("qst", QST)
SCORED = dict(ALLV, scr="""SELECT q.turn_id, q.kind, q.tool, CAST(CASE WHEN v.ok=0 THEN 0 WHEN q.kind='refusal_required' THEN 1 ELSE CASE WHEN coalesce((SELECT arg_max(c.result,c.seq) FROM tcall c WHERE c.turn_id=q.turn_id AND c.name=q.tool AND CASE q.tool WHEN 'find_nodes' THEN c.a_cls ELSE c.a_id END=q.want)=q.expected,false) THEN 1 ELSE 0 END END AS INT) AS passed FROM qst q JOIN ver v ON v.turn_id=q.turn_id""")


def scored(v):
    key = F.when(F.col("tool") == "find_nodes", "cls_name").otherwise("id")
    q = v.qst.select("turn_id", "kind", "tool", F.create_map(key, F.col("want")).alias("match"), "expected")
    return grounding.score(q, calls(v), grounding.grounding(v.turns, calls(v), xnode(v)))


@check("q15_answer_scores", "SELECT turn_id, kind, tool, passed FROM scr", **SCORED)
def _(v):
    return scored(v).select("turn_id", "kind", "tool", "passed")


@check("q15_report", """SELECT *, CAST(CASE WHEN axis='overall' THEN n_passed/n>=0.9 WHEN axis='kind' AND value IN ('not_found','refusal_required') THEN n_passed=n END AS INT) AS gate FROM (SELECT 'overall' AS axis, 'all' AS value, CAST(count(*) AS BIGINT) AS n, CAST(sum(passed) AS BIGINT) AS n_passed FROM scr UNION ALL SELECT 'kind', kind, CAST(count(*) AS BIGINT), CAST(sum(passed) AS BIGINT) FROM scr GROUP BY 2
 UNION ALL SELECT 'tool', u.name, CAST(count(*) AS BIGINT), CAST(sum(passed) AS BIGINT) FROM scr s JOIN (SELECT DISTINCT turn_id, name FROM tcall) u ON u.turn_id=s.turn_id GROUP BY 2) q""", **SCORED)
def _(v):
    return grounding.report(scored(v), calls(v))
