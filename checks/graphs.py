"""Graph construction, contraction and evaluation (G3-G23; the ink-fed ones are in checks.inkwork)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlparts import d2, serial
from checks.views import H, W, area, register
from sheetgraph import params as P
from sheetgraph.functions import geometry as g
from sheetgraph.operators import components as comp, contract, evaluate, graph, match

QUERIES, ORACLES, check = area()
r6 = lambda *n: [F.round(x, 6).alias(x) for x in n]

# ground-truth graph: the same vertices slightly moved and relabelled, some edges missing and some added
register("gt_vertex", """SELECT sheet_id, node_id, CASE node_type WHEN 'instrument' THEN 'instrumentation' WHEN 'unknown_fitting' THEN CASE WHEN h%3=0 THEN 'general' WHEN h%3=1 THEN 'tank' ELSE 'background' END ELSE node_type END AS label,
  x1+h%7-3 AS x1, y1+h%5-2 AS y1, x2+h%7-3 AS x2, y2+h%5-2 AS y2, (x1+x2)/2+h%7-3 AS cx, (y1+y2)/2+h%5-2 AS cy FROM vertex""")
register("gt_edge", """SELECT sheet_id, u, v, CASE WHEN (u+v)%9=0 THEN 'non-solid' ELSE 'solid' END AS edge_label FROM edge WHERE (u*31+v*17)%7<>0
 UNION SELECT sheet_id, u, w, 'solid' FROM (SELECT sheet_id, u, u+4 AS w, count(*) OVER (PARTITION BY sheet_id, u+4) AS x FROM edge WHERE (u*13+v)%11=0) e WHERE w IN (SELECT node_id FROM vertex v WHERE v.sheet_id=e.sheet_id)""")


def reach(edges: str, pre: str) -> dict[str, str]:
    """Smallest reachable id per vertex by recursive closure; isolated vertices are left to the caller."""
    return {
        pre + "both": f"SELECT sheet_id, u AS a, v AS b FROM {edges} UNION SELECT sheet_id, v, u FROM {edges}",
        pre + "walk": f"SELECT sheet_id, a AS node_id, a AS root FROM {pre}both UNION SELECT w.sheet_id, e.b, w.root FROM {pre}walk w JOIN {pre}both e ON e.sheet_id=w.sheet_id AND e.a=w.node_id AND w.root<e.b",
        pre + "comp": f"SELECT sheet_id, node_id, min(root) AS comp FROM {pre}walk GROUP BY 1,2",
    }


def elim(vertices: str, edges: str, labels: str, lab: str, pre: str) -> dict[str, str]:
    """Contraction by closure over removed vertices."""
    gone = f"SELECT sheet_id, node_id FROM {vertices} WHERE {lab} IN ({labels})"
    return {
        pre + "gone": gone,
        pre + "way": f"SELECT sheet_id, u AS a, v AS b FROM {edges} UNION SELECT sheet_id, v, u FROM {edges}",
        pre + "trail": f"SELECT w.sheet_id, w.a AS s, w.b AS spot FROM {pre}way w WHERE NOT EXISTS (SELECT 1 FROM {pre}gone g WHERE g.sheet_id=w.sheet_id AND g.node_id=w.a) UNION SELECT t.sheet_id, t.s, w.b FROM {pre}trail t JOIN {pre}gone g ON g.sheet_id=t.sheet_id AND g.node_id=t.spot JOIN {pre}way w ON w.sheet_id=t.sheet_id AND w.a=t.spot",
        pre + "left": f"SELECT DISTINCT t.sheet_id, least(s,spot) AS u, greatest(s,spot) AS v FROM {pre}trail t WHERE s<>spot AND NOT EXISTS (SELECT 1 FROM {pre}gone g WHERE g.sheet_id=t.sheet_id AND g.node_id=t.spot)",
    }


def placed(v):
    return v.vertex.withColumns({"cx": g.cx(), "cy": g.cy()})


COMP = reach("edge", "c_")


@check("g3_components", "SELECT v.sheet_id, v.node_id, coalesce(c.comp, v.node_id) AS comp FROM vertex v LEFT JOIN c_comp c ON c.sheet_id=v.sheet_id AND c.node_id=v.node_id", **COMP)
def _(v):
    return comp.components(v.vertex, v.edge).select("sheet_id", "node_id", "comp")


@check("g3_component_summary", """SELECT sheet_id, CAST(count(*) AS BIGINT) AS n_components, CAST(max(n) AS BIGINT) AS largest, CAST(count_if(n=1) AS BIGINT) AS isolated, array_to_string(list(n ORDER BY n DESC)[1:5],',') AS top5 FROM (SELECT sheet_id, comp, count(*) AS n FROM (
 SELECT v.sheet_id, coalesce(c.comp, v.node_id) AS comp FROM vertex v LEFT JOIN c_comp c ON c.sheet_id=v.sheet_id AND c.node_id=v.node_id) q GROUP BY 1,2) z GROUP BY 1""", **COMP)
def _(v):
    s = comp.summary(comp.components(v.vertex, v.edge))
    return s.select("sheet_id", "n_components", "largest", "isolated", F.array_join("sizes_top5", ",").alias("top5"))


@check("g4_eliminate", "SELECT sheet_id, u, v FROM e_left", **elim("vertex", "edge", "'connector','crossing'", "node_type", "e_"))
def _(v):
    return graph.eliminate(v.vertex, v.edge, ["connector", "crossing"])


def crossing_ready(v):
    """Crossing vertices with declared pass-through pairs: first with second branch, third with fourth."""
    ends = v.branch.select("sheet_id", F.col("u").alias("node_id"), "branch_id").unionByName(v.branch.select("sheet_id", F.col("v").alias("node_id"), "branch_id"))
    ids = ends.join(v.vertex.filter("node_type='crossing'").select("sheet_id", "node_id"), ["sheet_id", "node_id"], "left_semi")\
        .groupBy("sheet_id", "node_id").agg(F.sort_array(F.collect_list("branch_id")).alias("b"))
    pairs = F.expr("transform(filter(sequence(0, size(b) - 2), i -> i % 2 = 0), i -> named_struct('a', b[i], 'b', b[i + 1]))")
    ids = ids.select("sheet_id", "node_id", F.when(F.size("b") >= 2, pairs).alias("pass_pairs"))
    return placed(v).join(ids, ["sheet_id", "node_id"], "left")


@check("g5_connector_contraction")
def _(v):
    e = contract.connectors(v.vertex, v.branch)
    return e.select("sheet_id", "u", "v", "branch_id", "via", "backbone", F.size("coords").alias("n_points"), F.size("parts").alias("n_parts"))


DECLARED = dict(
    g6_end="SELECT sheet_id, u AS x, v AS n, branch_id, sx AS px, sy AS py FROM branch UNION ALL SELECT sheet_id, v, u, branch_id, tx, ty FROM branch",
    g6_leg="SELECT e.*, row_number() OVER (PARTITION BY e.sheet_id, e.x ORDER BY branch_id)-1 AS i FROM g6_end e JOIN vertex c ON c.sheet_id=e.sheet_id AND c.node_id=e.x AND c.node_type='crossing'",
    g6_made="""SELECT a.sheet_id, least(a.n,b.n) AS u, greatest(a.n,b.n) AS v, a.x, a.i, CAST(50-CASE WHEN a.px=b.px AND a.py=b.py THEN 1 ELSE 0 END AS INT) AS n_points FROM g6_leg a JOIN g6_leg b ON b.sheet_id=a.sheet_id AND b.x=a.x AND b.i=a.i+1 AND a.i%2=0
 JOIN vertex p ON p.sheet_id=a.sheet_id AND p.node_id=a.n AND p.node_type<>'crossing' JOIN vertex q ON q.sheet_id=b.sheet_id AND q.node_id=b.n AND q.node_type<>'crossing' WHERE a.n<>b.n""",
    g6_old="SELECT b.sheet_id, b.u, b.v, b.branch_id, CAST(NULL AS VARCHAR) AS via, CAST(25 AS INT) AS n_points FROM branch b JOIN vertex p ON p.sheet_id=b.sheet_id AND p.node_id=b.u AND p.node_type<>'crossing' JOIN vertex q ON q.sheet_id=b.sheet_id AND q.node_id=b.v AND q.node_type<>'crossing'")


# at a crossing the first branch goes with the second, the third with the fourth
@check("g6_crossing_contraction", """SELECT * FROM g6_old UNION ALL SELECT sheet_id, u, v, CAST(NULL AS BIGINT) AS branch_id, 'crossing' AS via, arg_min(n_points, (x, i)) AS n_points FROM g6_made m
 WHERE NOT EXISTS (SELECT 1 FROM g6_old o WHERE o.sheet_id=m.sheet_id AND o.u=m.u AND o.v=m.v) GROUP BY 1,2,3""", **DECLARED)
def _(v):
    e = contract.crossings(crossing_ready(v), v.branch)
    return e.select("sheet_id", "u", "v", "branch_id", "via", F.size("coords").alias("n_points"))


# one step of crossing pairing on the ground-truth graph as it stands
def crossings_sql(edges: str, pre: str) -> dict[str, str]:
    err = lambda a, b: f"abs((((degrees(atan2({b}.ny-{a}.py,{b}.nx-{a}.px)-atan2({a}.ny-{a}.py,{a}.nx-{a}.px))%360)+360)%360)-180)"
    return {
        pre + "nb": f"SELECT *, row_number() OVER (PARTITION BY sheet_id, x ORDER BY n)-1 AS i, count(*) OVER (PARTITION BY sheet_id, x) AS k FROM (SELECT DISTINCT e.sheet_id, c.node_id AS x, c.cx AS px, c.cy AS py, o.node_id AS n, o.cx AS nx, o.cy AS ny FROM (SELECT sheet_id, u AS a, v AS b FROM {edges} UNION SELECT sheet_id, v, u FROM {edges}) e JOIN gt_vertex c ON c.sheet_id=e.sheet_id AND c.node_id=e.a AND c.label='crossing' JOIN gt_vertex o ON o.sheet_id=e.sheet_id AND o.node_id=e.b) q",
        pre + "pp": f"SELECT a.sheet_id, a.x, a.n AS a, b.n AS b, a.i, b.i AS j, a.k, {err('a','b')} AS err FROM {pre}nb a JOIN {pre}nb b ON b.sheet_id=a.sheet_id AND b.x=a.x AND a.i<b.i",
        pre + "op": f"SELECT *, CASE WHEN k>=4 THEN CASE WHEN i=0 AND j=1 OR i=2 AND j=3 THEN 1 WHEN i=0 AND j=2 OR i=1 AND j=3 THEN 2 WHEN i=0 AND j=3 OR i=1 AND j=2 THEN 3 END WHEN k=3 THEN i+j ELSE 1 END AS opt FROM {pre}pp",
        pre + "tot": f"SELECT sheet_id, x, opt, round(sum(err),9) AS t FROM {pre}op WHERE opt IS NOT NULL GROUP BY 1,2,3",
        pre + "ch": f"SELECT sheet_id, x, arg_min(opt,(t,opt)) AS opt FROM {pre}tot GROUP BY 1,2",
        pre + "pairs": f"SELECT o.sheet_id, o.x AS crossing, a, b, coalesce(o.opt=c.opt,false) AS passes FROM {pre}op o JOIN {pre}ch c ON c.sheet_id=o.sheet_id AND c.x=o.x",
    }


@check("g7_crossing_pairs", "SELECT sheet_id, crossing, a, b, CAST(passes AS INT) AS passes FROM x_pairs", **crossings_sql("gt_edge", "x_"))
def _(v):
    gv = v.gt_vertex
    return graph.crossing_pairs(gv.filter("label='crossing'"), v.gt_edge, gv).withColumn("passes", F.col("passes").cast("int"))


# ground truth round by round: crossings without a smaller one beside them are settled together, edges between other vertices leave
def rounds_sql() -> str:
    one = crossings_sql("cur", "i_")
    one["i_nb"] = one["i_nb"].replace("c.label='crossing'", "c.label='crossing' AND NOT EXISTS (SELECT 1 FROM wait w WHERE w.sheet_id=e.sheet_id AND w.x=e.a)")
    inner = ",\n ".join(f"{n} AS ({b})" for n, b in one.items())
    return f"""SELECT 0 AS k, 'e' AS kind, sheet_id, CAST(NULL AS BIGINT) AS crossing, u, v, false AS passes FROM k_left
 UNION ALL SELECT * FROM (WITH cur AS (SELECT r.k, r.sheet_id, r.u, r.v FROM gt_round r WHERE r.kind='e' AND EXISTS (SELECT 1 FROM gt_vertex c WHERE c.sheet_id=r.sheet_id AND c.node_id IN (r.u, r.v) AND c.label='crossing')),
 wait AS (SELECT DISTINCT e.sheet_id, e.v AS x FROM cur e JOIN gt_vertex a ON a.sheet_id=e.sheet_id AND a.node_id=e.u AND a.label='crossing' JOIN gt_vertex b ON b.sheet_id=e.sheet_id AND b.node_id=e.v AND b.label='crossing'),
 {inner},
 gone AS (SELECT DISTINCT sheet_id, x FROM i_nb),
 step AS (SELECT max(k)+1 AS k FROM cur)
 SELECT k, 'p' AS kind, sheet_id, crossing, a AS u, b AS v, passes FROM i_pairs, step
 UNION ALL SELECT k, 'e', sheet_id, NULL, u, v, false FROM step, (SELECT sheet_id, u, v FROM cur e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.sheet_id=e.sheet_id AND g.x IN (e.u, e.v))
  UNION SELECT sheet_id, least(a,b), greatest(a,b) FROM i_pairs WHERE passes) z) y"""


GTC = dict(
    gv="SELECT * FROM gt_vertex WHERE label<>'background'",
    ge="SELECT e.sheet_id, e.u, e.v FROM gt_edge e JOIN gv a ON a.sheet_id=e.sheet_id AND a.node_id=e.u JOIN gv b ON b.sheet_id=e.sheet_id AND b.node_id=e.v",
    **elim("gv", "ge", "'connector','general'", "label", "k_"),
    gt_round=rounds_sql(),
    gtc="SELECT DISTINCT r.sheet_id, r.u, r.v FROM gt_round r JOIN gv a ON a.sheet_id=r.sheet_id AND a.node_id=r.u JOIN gv b ON b.sheet_id=r.sheet_id AND b.node_id=r.v WHERE kind='e' AND a.label<>'crossing' AND b.label<>'crossing'",
    sep="SELECT sheet_id, u AS a, v AS b FROM gt_round WHERE kind='p' AND NOT passes")


def gt_graph(v):
    """Contracted ground truth: vertices, edges and separated pairs. Lines run on over any number of adjacent crossings."""
    gv, edges, pairs = graph.gt_contracted(v.gt_vertex, v.gt_edge)
    return gv, edges, pairs.filter("not passes")


@check("g8_gt_contracted", "SELECT sheet_id, u, v FROM gtc", **GTC)
def _(v):
    return gt_graph(v)[1].select("sheet_id", "u", "v")


@check("g8_gt_contracted_whole", "SELECT sheet_id, u, v FROM gtc", **GTC)
def _(v):
    return graph.gt_contracted(v.gt_vertex, v.gt_edge)[1].select("sheet_id", "u", "v")


# predicted graph: connectors and crossings bridged; scored vertices matched to the moved ground truth
SCORE = dict(
    GTC, **elim("vertex", "edge", "'connector','crossing'", "node_type", "e_"),
    cand=f"SELECT p.sheet_id, p.label, p.node_id, p.conf, g.node_id AS gt_id, {d2('p','g')} AS d2 FROM (SELECT *, CASE node_type WHEN 'valve' THEN 'valve' WHEN 'instrument' THEN 'instrumentation' END AS label FROM vertex) p JOIN gt_vertex g ON g.sheet_id=p.sheet_id AND g.label=p.label AND {d2('p','g')}<=0.25*(g.x2-g.x1)*(g.y2-g.y1)",
    **serial("cand", "conf DESC", "d2", "node_id", "gt_id"),
    es="""SELECT coalesce(p.sheet_id,t.sheet_id) AS sheet_id, p.u, p.v, coalesce(p.gu,t.gu) AS gu, coalesce(p.gv,t.gv) AS gv, CASE WHEN p.gu IS NULL THEN 'FN' WHEN t.gu IS NULL THEN 'FP' ELSE 'TP' END AS status
 FROM (SELECT e.sheet_id, e.u, e.v, least(a.gt_id,b.gt_id) AS gu, greatest(a.gt_id,b.gt_id) AS gv FROM e_left e JOIN s_match a ON a.sheet_id=e.sheet_id AND a.node_id=e.u JOIN s_match b ON b.sheet_id=e.sheet_id AND b.node_id=e.v) p
 FULL JOIN (SELECT g.sheet_id, g.u AS gu, g.v AS gv FROM gtc g WHERE EXISTS (SELECT 1 FROM s_match m WHERE m.sheet_id=g.sheet_id AND m.gt_id=g.u) AND EXISTS (SELECT 1 FROM s_match m WHERE m.sheet_id=g.sheet_id AND m.gt_id=g.v)) t ON t.sheet_id=p.sheet_id AND t.gu=p.gu AND t.gv=p.gv""",
    em="SELECT *, CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1 FROM (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS precision, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS recall FROM (SELECT sheet_id, CAST(count_if(status='TP') AS BIGINT) AS tp, CAST(count_if(status='FP') AS BIGINT) AS fp, CAST(count_if(status='FN') AS BIGINT) AS fn FROM es GROUP BY 1) q) z")


def node_matches(v):
    d = v.vertex.withColumn("label", P.lookup(P.NODE_TO_LABEL, F.col("node_type"))).filter("label is not null")
    m = match.greedy_center(d.withColumn("det_id", F.col("node_id")), v.gt_vertex.withColumn("gt_id", F.col("node_id")))
    return m.withColumnRenamed("det_id", "node_id")


def scored(v):
    from sheetgraph.operators.stage import staged
    pred = staged(graph.eliminate(v.vertex, v.edge, ["connector", "crossing"]))
    gv, ge, sep = gt_graph(v)
    m = staged(node_matches(v))
    return pred, gv, ge, sep, m, evaluate.edge_status(pred, ge, m)


@check("g12_edge_metrics", "SELECT sheet_id, tp, fp, fn, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM em", **SCORE)
def _(v):
    return evaluate.edge_metrics(scored(v)[-1]).select("sheet_id", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


@check("g13_crossing_violations", """SELECT s.sheet_id, CAST(count(*) AS BIGINT) AS total, CAST(count(e.u) AS BIGINT) AS violations, round(count(e.u)/count(*),6) AS rate FROM sep s JOIN s_match a ON a.sheet_id=s.sheet_id AND a.gt_id=s.a JOIN s_match b ON b.sheet_id=s.sheet_id AND b.gt_id=s.b
 LEFT JOIN e_left e ON e.sheet_id=s.sheet_id AND e.u=least(a.node_id,b.node_id) AND e.v=greatest(a.node_id,b.node_id) GROUP BY 1""", **SCORE)
def _(v):
    pred, gv, ge, sep, m, st = scored(v)
    return evaluate.crossing_violations(pred, sep, m).withColumn("rate", F.round("rate", 6))


@check("g14_evaluation_summary", """SELECT CAST(count(*) AS BIGINT) AS sheets, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(precision),6) AS macro_precision, round(avg(recall),6) AS macro_recall, round(avg(f1),6) AS macro_f1,
 round(sum(tp)/(sum(tp)+sum(fp)),6) AS pooled_precision, round(sum(tp)/(sum(tp)+sum(fn)),6) AS pooled_recall, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),6) AS pooled_f1 FROM em""", **SCORE)
def _(v):
    s = evaluate.summary(evaluate.edge_metrics(scored(v)[-1]))
    return s.select("sheets", "tp", "fp", "fn", *r6(*[a + b for a in ("macro_", "pooled_") for b in ("precision", "recall", "f1")]))


CAUSE = dict(SCORE, **reach("gtc", "q_"), ca="""SELECT es.sheet_id, es.gu, es.gv, CASE WHEN EXISTS (SELECT 1 FROM sep s WHERE s.sheet_id=es.sheet_id AND least(s.a,s.b)=es.gu AND greatest(s.a,s.b)=es.gv) THEN 'S4' WHEN a.comp IS NULL OR b.comp IS NULL OR a.comp<>b.comp THEN 'P3' ELSE 'OTHER' END AS cause
 FROM es LEFT JOIN q_comp a ON a.sheet_id=es.sheet_id AND a.node_id=es.gu LEFT JOIN q_comp b ON b.sheet_id=es.sheet_id AND b.node_id=es.gv WHERE status='FP'""")


@check("g15_false_edge_cause", "SELECT sheet_id, gu, gv, cause FROM ca", **CAUSE)
def _(v):
    pred, gv, ge, sep, m, st = scored(v)
    return evaluate.fp_cause(st, sep, gv, ge).select("sheet_id", "gu", "gv", "cause")


# a second run: predicted edges whose ends sum to a multiple of five are missing, neighbours-of-three added
RUN_B = dict(SCORE, eb="SELECT sheet_id, u, v FROM e_left WHERE (u+v)%5<>0 UNION SELECT sheet_id, u, v+3 FROM e_left WHERE (u+v)%11=0",
             esb="""SELECT p.sheet_id, p.gu, p.gv, CASE WHEN t.u IS NULL THEN 'FP' ELSE 'TP' END AS status FROM (SELECT e.sheet_id, least(a.gt_id,b.gt_id) AS gu, greatest(a.gt_id,b.gt_id) AS gv FROM eb e JOIN s_match a ON a.sheet_id=e.sheet_id AND a.node_id=e.u JOIN s_match b ON b.sheet_id=e.sheet_id AND b.node_id=e.v) p LEFT JOIN gtc t ON t.sheet_id=p.sheet_id AND t.u=p.gu AND t.v=p.gv""")


def run_b(pred):
    return pred.filter("(u+v)%5<>0").unionByName(pred.filter("(u+v)%11=0").select("sheet_id", "u", (F.col("v") + 3).alias("v"))).distinct()


@check("g17_run_diff", """SELECT coalesce(a.sheet_id,b.sheet_id) AS sheet_id, coalesce(a.gu,b.gu) AS gu, coalesce(a.gv,b.gv) AS gv, CASE WHEN a.gu IS NULL THEN CASE b.status WHEN 'TP' THEN 'TP_GAINED' ELSE 'FP_APPEARED' END WHEN b.gu IS NULL THEN CASE a.status WHEN 'TP' THEN 'TP_LOST' ELSE 'FP_KILLED' END ELSE 'UNCHANGED' END AS change
 FROM (SELECT DISTINCT sheet_id, gu, gv, status FROM es WHERE status<>'FN') a FULL JOIN (SELECT DISTINCT * FROM esb) b ON a.sheet_id=b.sheet_id AND a.gu=b.gu AND a.gv=b.gv""", **RUN_B)
def _(v):
    pred, gv, ge, sep, m, st = scored(v)
    return evaluate.run_diff(st, evaluate.edge_status(run_b(pred), ge, m)).select("sheet_id", "gu", "gv", "change")


@check("g18_contraction_effect", """SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT CASE WHEN a.gt_id IS NULL OR b.gt_id IS NULL THEN 'UNSCOREABLE' WHEN g.u IS NOT NULL THEN 'TP' ELSE concat('FP_', ca.cause) END AS outcome
 FROM (SELECT * FROM e_left EXCEPT SELECT sheet_id, u, v FROM edge) e LEFT JOIN s_match a ON a.sheet_id=e.sheet_id AND a.node_id=e.u LEFT JOIN s_match b ON b.sheet_id=e.sheet_id AND b.node_id=e.v
 LEFT JOIN gtc g ON g.sheet_id=e.sheet_id AND g.u=least(a.gt_id,b.gt_id) AND g.v=greatest(a.gt_id,b.gt_id) LEFT JOIN ca ON ca.sheet_id=e.sheet_id AND ca.gu=least(a.gt_id,b.gt_id) AND ca.gv=greatest(a.gt_id,b.gt_id)) q GROUP BY 1""", **CAUSE)
def _(v):
    pred, gv, ge, sep, m, st = scored(v)
    return evaluate.contraction_effect(v.edge, pred, m, ge, sep, gv)


@check("g19_parameter_sweep", """SELECT run, sheet_id, tp, fp, fn, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END,6) AS precision, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END,6) AS recall FROM (
 SELECT run, sheet_id, CAST(count_if(status='TP') AS BIGINT) AS tp, CAST(count_if(status='FP') AS BIGINT) AS fp, CAST(count_if(status='FN') AS BIGINT) AS fn FROM (
 SELECT 1 AS run, sheet_id, status FROM es UNION ALL SELECT 2, sheet_id, status FROM esb UNION ALL SELECT 2, t.sheet_id, 'FN' FROM (SELECT sheet_id, gu, gv FROM es WHERE status IN ('TP','FN')) t WHERE NOT EXISTS (SELECT 1 FROM esb b WHERE b.sheet_id=t.sheet_id AND b.gu=t.gu AND b.gv=t.gv)) q GROUP BY GROUPING SETS ((run, sheet_id),(run))) z""", **RUN_B)
def _(v):
    pred, gv, ge, sep, m, st = scored(v)
    # the parameter is one more key, so all values are scored in one pass
    runs = F.explode(F.array(F.lit(1), F.lit(2))).alias("run")
    both = pred.withColumn("run", F.lit(1)).unionByName(run_b(pred).withColumn("run", F.lit(2)))
    keys = ["run", "sheet_id"]
    s = evaluate.edge_status(both, ge.select("*", runs), m.select("*", runs), keys)
    return evaluate.sweep_table(s, "run").select("run", "sheet_id", "tp", "fp", "fn", *r6("precision", "recall"))


@check("g20_regression_gate", "SELECT sheet_id, u, v, gu, gv FROM es WHERE status='TP' AND (u+v)%5=0", **SCORE)
def _(v):
    pred, gv, ge, sep, m, st = scored(v)
    vetoed = pred.filter("(u+v)%5=0").select("sheet_id", F.col("u").alias("a_id"), F.col("v").alias("b_id"))
    return evaluate.tp_gate(st, vetoed).select("sheet_id", "u", "v", "gu", "gv")


@check("g9_short_gap_veto", """SELECT p.sheet_id, p.u AS a_id, p.v AS b_id, CAST(coalesce(ra.comp=rb.comp,false) AND NOT coalesce(ca.comp=cb.comp,false) AS INT) AS vetoed FROM (SELECT sheet_id, u, v+2 AS v FROM edge WHERE (u+v)%3=0) p
 LEFT JOIN r_comp ra ON ra.sheet_id=p.sheet_id AND ra.node_id=p.u LEFT JOIN r_comp rb ON rb.sheet_id=p.sheet_id AND rb.node_id=p.v LEFT JOIN z_comp ca ON ca.sheet_id=p.sheet_id AND ca.node_id=p.u LEFT JOIN z_comp cb ON cb.sheet_id=p.sheet_id AND cb.node_id=p.v""",
       **reach("edge", "r_"), thin="SELECT * FROM edge WHERE (u*7+v)%4<>0", **reach("thin", "z_"))
def _(v):
    pairs = v.edge.filter("(u+v)%3=0").select("sheet_id", F.col("u").alias("a_id"), (F.col("v") + 2).alias("b_id"))
    return graph.veto(pairs, (v.vertex, v.edge), (v.vertex, v.edge.filter("(u*7+v)%4<>0"))).select("sheet_id", "a_id", "b_id", F.col("vetoed").cast("int").alias("vetoed"))


SEGD = "CASE WHEN dx=0 AND dy=0 THEN pow(ax-ux,2)+pow(ay-uy,2) ELSE pow(ax-(ux+greatest(0,least(1,((ax-ux)*dx+(ay-uy)*dy)/(dx*dx+dy*dy)))*dx),2)+pow(ay-(uy+greatest(0,least(1,((ax-ux)*dx+(ay-uy)*dy)/(dx*dx+dy*dy)))*dy),2) END"
NEAR_EDGE = dict(
    arw="SELECT sheet_id, det_id AS arrow_id, (x1+x2)/2 AS ax, (y1+y2)/2 AS ay, x1,y1,x2,y2,h FROM det WHERE cls_id=23",
    seg="SELECT e.sheet_id, e.u, e.v, (a.x1+a.x2)/2 AS ux, (a.y1+a.y2)/2 AS uy, (b.x1+b.x2)/2 AS vx, (b.y1+b.y2)/2 AS vy, (b.x1+b.x2)/2-(a.x1+a.x2)/2 AS dx, (b.y1+b.y2)/2-(a.y1+a.y2)/2 AS dy FROM edge e JOIN vertex a ON a.sheet_id=e.sheet_id AND a.node_id=e.u JOIN vertex b ON b.sheet_id=e.sheet_id AND b.node_id=e.v",
    ae=f"SELECT sheet_id, arrow_id, round(dd,9) AS d2, u, v, ux, uy, vx, vy, ax, ay, h FROM (SELECT s.*, a.arrow_id, a.ax, a.ay, a.h, {SEGD} AS dd FROM arw a JOIN seg s ON s.sheet_id=a.sheet_id) q WHERE dd<=40000",
    ab="SELECT sheet_id, arrow_id, unnest(b) FROM (SELECT sheet_id, arrow_id, min({'d2':d2,'u':u,'v':v,'ux':ux,'uy':uy,'vx':vx,'vy':vy}) AS b FROM ae GROUP BY 1,2) q")


def arrows(v):
    return v.det.filter("cls_id=23").select("sheet_id", F.col("det_id").alias("arrow_id"), g.cx().alias("ax"), g.cy().alias("ay"), "h", "x1", "y1", "x2", "y2")


@check("g10_nearest_edge", "SELECT sheet_id, arrow_id, u, v, round(d2,6) AS d2 FROM ab", **NEAR_EDGE)
def _(v):
    return graph.nearest_edge(arrows(v), placed(v), v.edge).select("sheet_id", "arrow_id", "u", "v", *r6("d2"))


@check("g11_flow_direction", """SELECT sheet_id, u, v, arg_max(CASE WHEN du<=dv THEN v||' -> '||u ELSE u||' -> '||v END, arrow_id) AS flow_direction FROM (
 SELECT b.*, pow(CASE WHEN a.h%2=0 THEN a.x2 ELSE a.x1 END-ux,2)+pow(a.ay-uy,2) AS du, pow(CASE WHEN a.h%2=0 THEN a.x2 ELSE a.x1 END-vx,2)+pow(a.ay-vy,2) AS dv FROM ab b JOIN arw a ON a.sheet_id=b.sheet_id AND a.arrow_id=b.arrow_id) q GROUP BY 1,2,3""", **NEAR_EDGE)
def _(v):
    a = arrows(v)
    tips = a.select("sheet_id", "arrow_id", F.when(F.col("h") % 2 == 0, F.col("x2")).otherwise(F.col("x1")).alias("tip_x"), F.col("ay").alias("tip_y"))
    return graph.flow(graph.nearest_edge(a, placed(v), v.edge), tips)


def path_pairs(v):
    return v.edge.select("sheet_id", F.col("u").alias("pair_id"), F.col("u").alias("start"), (F.col("u") + 9).alias("goal")).distinct()


# distances from every goal, then the way from each start to its smallest neighbour that is nearer
PATHS = dict(
    g21_pair="SELECT DISTINCT sheet_id, u AS pair_id, u AS start, u+9 AS goal FROM edge",
    g21_both="SELECT sheet_id, u AS a, v AS b FROM edge UNION SELECT sheet_id, v, u FROM edge",
    g21_far="(sheet_id, goal, spot, d) USING KEY (sheet_id, goal, spot) AS SELECT DISTINCT sheet_id, goal, goal AS spot, 0 AS d FROM g21_pair UNION SELECT s.sheet_id, s.goal, e.b, s.d+1 FROM g21_far s JOIN g21_both e ON e.sheet_id=s.sheet_id AND e.a=s.spot WHERE NOT EXISTS (SELECT 1 FROM recurring.g21_far r WHERE r.sheet_id=s.sheet_id AND r.goal=s.goal AND r.spot=e.b)",
    g21_way="SELECT sheet_id, pair_id, goal, 0 AS k, start AS spot FROM g21_pair UNION ALL SELECT p.sheet_id, p.pair_id, p.goal, p.k+1, min(e.b) FROM g21_way p JOIN g21_far a ON a.sheet_id=p.sheet_id AND a.goal=p.goal AND a.spot=p.spot JOIN g21_both e ON e.sheet_id=p.sheet_id AND e.a=p.spot JOIN g21_far b ON b.sheet_id=p.sheet_id AND b.goal=p.goal AND b.spot=e.b AND b.d=a.d-1 GROUP BY 1,2,3,4")


@check("g21_shortest_path", "SELECT p.sheet_id, p.pair_id, CAST(w.d AS INT) AS hops FROM g21_pair p LEFT JOIN g21_far w ON w.sheet_id=p.sheet_id AND w.goal=p.goal AND w.spot=p.start", **PATHS)
def _(v):
    return graph.shortest_path(v.edge, path_pairs(v)).select("sheet_id", "pair_id", "hops")


# each edge has one branch, numbered by its ends
@check("g21_path_culprits", """SELECT DISTINCT sheet_id, pair_id, spot AS crossing FROM (SELECT s.*, least(s.spot,bf)*1000000+greatest(s.spot,bf) AS b1, least(s.spot,af)*1000000+greatest(s.spot,af) AS b2
  FROM (SELECT *, lag(spot) OVER o AS bf, lead(spot) OVER o AS af FROM g21_way WINDOW o AS (PARTITION BY sheet_id, pair_id ORDER BY k)) s JOIN vertex c ON c.sheet_id=s.sheet_id AND c.node_id=s.spot AND c.node_type='crossing' WHERE bf IS NOT NULL AND af IS NOT NULL) q
 WHERE NOT EXISTS (SELECT 1 FROM g6_leg a JOIN g6_leg b ON b.sheet_id=a.sheet_id AND b.x=a.x AND b.i=a.i+1 AND a.i%2=0 WHERE a.sheet_id=q.sheet_id AND a.x=q.spot AND a.branch_id=least(b1,b2) AND b.branch_id=greatest(b1,b2))""", **PATHS, **{k: DECLARED[k] for k in ("g6_end", "g6_leg")})
def _(v):
    paths = graph.shortest_path(v.edge, path_pairs(v)).filter("path is not null")
    return graph.culprits(paths, v.branch, crossing_ready(v).filter("node_type='crossing'"))


@check("g22_inventory", "SELECT 'node' AS what, label AS name, CAST(count(*) AS BIGINT) AS n FROM gt_vertex GROUP BY 2 UNION ALL SELECT 'edge', edge_label, CAST(count(*) AS BIGINT) FROM gt_edge GROUP BY 2")
def _(v):
    return graph.inventory(v.gt_vertex, v.gt_edge)


@check("g22_sample_paths", """SELECT sheet_id, src, via, dst FROM (SELECT sheet_id, src, b.via AS via, b.dst AS dst FROM (SELECT sheet_id, src, min({'k':coalesce(via,-1),'dst':dst,'via':via}) AS b FROM (
 SELECT h.sheet_id, h.a AS src, NULL::BIGINT AS via, h.b AS dst FROM hp h WHERE NOT da AND NOT db UNION ALL SELECT h.sheet_id, h.a, h.b, k.b FROM hp h JOIN hp k ON k.sheet_id=h.sheet_id AND k.a=h.b AND k.b<>h.a WHERE NOT h.da AND h.db AND NOT k.db) q GROUP BY 1,2) y) z ORDER BY md5(concat_ws('_',sheet_id,src)), sheet_id, src LIMIT 3""",
       hp="SELECT e.sheet_id, e.a, e.b, x.label IN ('connector','crossing','background') AS da, y.label IN ('connector','crossing','background') AS db FROM (SELECT sheet_id, u AS a, v AS b FROM gt_edge UNION ALL SELECT sheet_id, v, u FROM gt_edge) e JOIN gt_vertex x ON x.sheet_id=e.sheet_id AND x.node_id=e.a JOIN gt_vertex y ON y.sheet_id=e.sheet_id AND y.node_id=e.b")
def _(v):
    return graph.sample_paths(v.gt_vertex, v.gt_edge, ["connector", "crossing", "background"])


@check("g23_traced_share", "SELECT sheet_id, CAST(count(*) AS BIGINT) AS n_edges, CAST(count_if(branch_type<3) AS BIGINT) AS n_traced, round(avg(CASE WHEN branch_type<3 THEN 0.0 ELSE 1.0 END),6) AS inferred_share FROM route GROUP BY 1")
def _(v):
    e = v.branch.withColumn("path", F.when(F.col("branch_type") < 3, F.col("coords")))
    return graph.traced_share(e).withColumn("inferred_share", F.round("inferred_share", 6))
