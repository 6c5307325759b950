"""Test inputs derived from the given tables, as Spark DataFrames and as the same SQL for the oracle.

Each view is one SQL text that both engines run; where array syntax differs the two texts stand side by side. `oracle(sql)`
puts the views a query names in front of it as materialised CTEs.
"""

from __future__ import annotations

import re

from sheetgraph.operators.stage import staged

W, H = 2000, 1400  # page size of the derived sheets

DET = """SELECT det_id, sheet_id, CAST(cls_id AS INT) AS cls_id, conf, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
  CAST(x1+w AS DOUBLE) AS x2, CAST(y1+hh AS DOUBLE) AS y2, h
FROM (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, pc) AS det_id,
   CAST(floor(l_orderkey/25.0) AS BIGINT) AS sheet_id, h%32 AS cls_id, CAST(h%100003 AS DOUBLE)/100003 AS conf,
   60+(l_partkey%10)*190 + CAST(floor(h/32.0) AS BIGINT)%21 AS x1,
   60+(CAST(floor(l_partkey/10.0) AS BIGINT)%6)*210 + CAST(floor(h/700.0) AS BIGINT)%21 AS y1,
   20+CAST(floor(h/15000.0) AS BIGINT)%40 AS w, 20+CAST(floor(h/600000.0) AS BIGINT)%40 AS hh, h
 FROM (SELECT *, (l_orderkey*7919+l_partkey*104729+l_suppkey*15485863+l_linenumber*32452843+pc*49979687)%2147483647 AS h
  FROM (SELECT *, CAST(round(l_extendedprice*100) AS BIGINT) AS pc FROM lineitem) a) b) c"""

# the same rows: Spark takes a number with a point for a decimal, whose division costs more than all the rest of a box. Hashes stay below
# 2**31, so that doubles are exact; sheets are numbered in integers
DET_SPARK = re.sub(r"/(\d+)\.0\)", r"/\1.0D)", DET.replace("CAST(floor(l_orderkey/25.0) AS BIGINT)", "(l_orderkey-pmod(l_orderkey,25)) div 25"))

BOTH = {
    # most truth boxes lie on a detection, moved by a few pixels; some are half a box off, of another label, or where nothing was found
    "gt": """SELECT gt_id, sheet_id, label, x1+off AS x1, y1, x2+off AS x2, y2 FROM (SELECT det_id AS gt_id, sheet_id,
  CASE WHEN h%10=8 THEN CASE WHEN cls_id<=13 THEN 'arrow' ELSE 'valve' END WHEN cls_id<=13 THEN 'valve' WHEN cls_id=23 THEN 'arrow' ELSE 'instrumentation' END AS label,
  CAST(CASE h%10 WHEN 7 THEN floor((x2-x1)/2) WHEN 9 THEN 95 ELSE 0 END AS DOUBLE) AS off, x1+h%7-3 AS x1, y1+h%5-2 AS y1, x2+h%7-3 AS x2, y2+h%5-2 AS y2
FROM det WHERE cls_id<=13 OR cls_id IN (23,25,26,27,28,30) OR h%10=8) g""",
    "ignore_box": """SELECT det_id AS ig_id, sheet_id, x1-4 AS x1, y1-4 AS y1, x2+4 AS x2, y2+4 AS y2 FROM det WHERE cls_id IN (19,20) AND h%3=0""",
    "background": """SELECT DISTINCT sheet_id, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(420 AS DOUBLE) AS x2, CAST(260 AS DOUBLE) AS y2 FROM det WHERE sheet_id%4=0""",
    "vertex": """SELECT sheet_id, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY det_id)-1 AS BIGINT) AS node_id, det_id, cls_id,
  CASE WHEN h%5=0 THEN 'connector' WHEN h%23=0 THEN 'crossing' WHEN cls_id<=13 THEN 'valve' WHEN cls_id IN (25,26,27,28,30) THEN 'instrument' ELSE 'unknown_fitting' END AS node_type,
  conf, x1,y1,x2,y2,h FROM det""",
    "edge": """SELECT DISTINCT a.sheet_id, least(a.node_id,b.node_id) AS u, greatest(a.node_id,b.node_id) AS v
FROM vertex a JOIN vertex b ON a.sheet_id=b.sheet_id AND b.node_id=a.node_id+1+a.h%3 WHERE a.h%4<>1""",
    "ocr_line": """SELECT sheet_id, node_id, line_no, txt, CAST(line_no*12+h%5 AS DOUBLE) AS y_center, CAST(500+h%500 AS DOUBLE)/1000 AS conf FROM (
 SELECT sheet_id,node_id,h,1 AS line_no, CASE h%6 WHEN 0 THEN 'PT' WHEN 1 THEN 'tcv' WHEN 2 THEN 'PSV ' WHEN 3 THEN concat('FT-',CAST(100+h%900 AS VARCHAR(8))) WHEN 4 THEN '07 PSV' ELSE 'AORV' END AS txt FROM vertex WHERE node_type='instrument'
 UNION ALL SELECT sheet_id,node_id,h,2, CASE WHEN h%6=5 THEN 'XXX' ELSE concat(CAST(1400+h%600 AS VARCHAR(8)), CASE WHEN h%11=0 THEN 'A' ELSE '' END) END FROM vertex WHERE node_type='instrument' AND h%6<>3) t""",
    # traced branches: one per edge, ends pulled back from the vertices by 3/64, 11/64 or 19/64 of the way
    "route": """SELECT e.sheet_id, e.u*1000000+e.v AS branch_id, e.u, e.v, (a.x1+a.x2)/2 AS ax, (a.y1+a.y2)/2 AS ay,
  (b.x1+b.x2)/2-(a.x1+a.x2)/2 AS dx, (b.y1+b.y2)/2-(a.y1+a.y2)/2 AS dy, 3+8*(a.h%3) AS lo, 61-8*(b.h%3) AS hi, CAST((a.h+b.h)%4 AS INT) AS branch_type
FROM edge e JOIN vertex a ON a.sheet_id=e.sheet_id AND a.node_id=e.u JOIN vertex b ON b.sheet_id=e.sheet_id AND b.node_id=e.v""",
    "image": """SELECT sheet_id, CAST(1900+150*(sheet_id%3) AS INT) AS width, CAST(1250+150*(sheet_id%2) AS INT) AS height, CASE WHEN sheet_id%5=0 THEN 'val' ELSE 'train' END AS split FROM det GROUP BY sheet_id""",
    # recorded per-class figures of an earlier run; every third class was not recorded
    "baseline": """SELECT cls_id AS cls, avg(conf) AS ap50, avg(conf*conf) AS ap50_95, avg(1-conf) AS recall FROM det WHERE cls_id%3<>0 GROUP BY cls_id""",
    "job_event": """SELECT user_id AS job_id, event_id AS seq, ts, event_type AS stage, value FROM events""",
    "call": """SELECT user_id AS turn_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'get_node' WHEN 'click' THEN 'get_neighbors' WHEN 'signup' THEN 'list_systems_or_lines' WHEN 'purchase' THEN 'find_nodes' ELSE 'count_nodes' END AS name,
  concat('sym_', CAST(CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)%100 AS VARCHAR(8))) AS arg_id FROM events""",
}

STEPS = 24
_PT = "CAST(floor({0}+{1}*(CAST(lo*24+(hi-lo)*k AS DOUBLE)/1536)) AS BIGINT)"

# views whose array or series syntax differs, or whose rows Spark deals to TASKS tasks by sheet: (Spark text, oracle text)
SPLIT = {
    "det": (DET_SPARK, DET),
    # what is drawn from vertices stays with its sheet
    "vertex": (BOTH["vertex"].removesuffix("FROM det") + "FROM (SELECT /*+ REPARTITION(TASKS, sheet_id) */ * FROM det) d", BOTH["vertex"]),
    "ink": (
        """SELECT DISTINCT sheet_id, CAST(floor(ax+dx*i/64) AS BIGINT) AS x, CAST(floor(ay+dy*i/64) AS BIGINT) AS y
FROM (SELECT *, explode(sequence(0,64)) AS i FROM (SELECT /*+ REPARTITION(TASKS, sheet_id) */ * FROM (
  SELECT e.sheet_id, (a.x1+a.x2)/2 AS ax, (a.y1+a.y2)/2 AS ay, (b.x1+b.x2)/2-(a.x1+a.x2)/2 AS dx, (b.y1+b.y2)/2-(a.y1+a.y2)/2 AS dy, a.h AS h
  FROM edge e JOIN vertex a ON a.sheet_id=e.sheet_id AND a.node_id=e.u
  JOIN vertex b ON b.sheet_id=e.sheet_id AND b.node_id=e.v) r) d) t WHERE (h+i)%9<>0""",
        """SELECT DISTINCT sheet_id, CAST(floor(ax+dx*i/64) AS BIGINT) AS x, CAST(floor(ay+dy*i/64) AS BIGINT) AS y
FROM (SELECT e.sheet_id, (a.x1+a.x2)/2 AS ax, (a.y1+a.y2)/2 AS ay, (b.x1+b.x2)/2-(a.x1+a.x2)/2 AS dx, (b.y1+b.y2)/2-(a.y1+a.y2)/2 AS dy,
  a.h AS h, unnest(range(65)) AS i FROM edge e JOIN vertex a ON a.sheet_id=e.sheet_id AND a.node_id=e.u
  JOIN vertex b ON b.sheet_id=e.sheet_id AND b.node_id=e.v) t WHERE (h+i)%9<>0"""),
    "branch_pt": (
        f"SELECT sheet_id, branch_id, branch_type, k, {_PT.format('ay','dy')} AS r, {_PT.format('ax','dx')} AS c "
        "FROM (SELECT *, explode(sequence(0,24)) AS k FROM route) t",
        f"SELECT sheet_id, branch_id, branch_type, k, {_PT.format('ay','dy')} AS r, {_PT.format('ax','dx')} AS c "
        "FROM (SELECT *, unnest(range(25)) AS k FROM route) t"),
    "branch": (
        "SELECT sheet_id, branch_id, branch_type, u, v, transform(transform(sequence(0,24), k -> CAST(a+b*k AS DOUBLE)/1536), t -> named_struct("
        "'r', CAST(floor(ay+dy*t) AS BIGINT), 'c', CAST(floor(ax+dx*t) AS BIGINT))) AS coords FROM (SELECT *, lo*24 AS a, hi-lo AS b FROM route) r",
        "SELECT sheet_id, branch_id, any_value(branch_type) AS branch_type, branch_id//1000000 AS u, branch_id%1000000 AS v, "
        "max(CASE WHEN k=0 THEN c END) AS sx, max(CASE WHEN k=0 THEN r END) AS sy, "
        "max(CASE WHEN k=24 THEN c END) AS tx, max(CASE WHEN k=24 THEN r END) AS ty FROM branch_pt GROUP BY sheet_id, branch_id"),
    # grey levels of the derived sheets as histogram rows: light paper, dark ink
    "grey_hist": (
        "SELECT sheet_id, grey, count(*) AS n FROM (SELECT sheet_id, CAST(CASE WHEN h%3=0 THEN 20+h%60 ELSE 190+h%50 END AS INT) AS grey FROM det) t GROUP BY 1,2",
    ) * 2,
}

ALL = {**{k: (v, v) for k, v in BOTH.items()}, **SPLIT}
TABLES = ["lineitem", "events", "conversations", "documents"]


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_][a-z_0-9]*\b", sql))


def register(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    ALL[name] = (spark_sql, duck_sql or spark_sql)


def closure(sql: str, which: int, extra: dict[str, str] | None = None, ready=()) -> list[tuple[str, str]]:
    """Named views a text needs, dependencies first; those in `ready` are tables already."""
    extra = extra or {}
    found: dict[str, str] = {}

    def visit(text: str, seen: tuple):
        for n in sorted(_names(text)):
            if n in found or n in seen or n in ready:
                continue
            body = extra.get(n) or (ALL[n][which] if n in ALL else None)
            if body is not None:
                visit(body, seen + (n,))
                found[n] = body

    visit(sql, ())
    return list(found.items())


def oracle(sql: str, **ctes: str) -> str:
    """Final SQL for the oracle with every named view, and the given extra CTEs, in front. A text that begins with its columns in
    brackets and `USING KEY` is a recursion that keeps one row per key."""
    def part(n, b):
        if b.startswith("("):
            head, body = b.split(" AS ", 1)
            return f"{n} {head} AS (\n{body}\n)"
        return f"{n} AS {'' if n in _names(b) else 'MATERIALIZED '}(\n{b}\n)"
    parts = [part(n, b) for n, b in closure(sql, 1, ctes)]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql if parts else sql


ROWS_A_TASK = 30_000  # of lineitem; a task then draws some 1.5 million ink pixels


def tasks(spark, sf_dir: str) -> int:
    """Tasks to deal sheets to, by the rows there are. One vertex becomes some forty pixels after the shuffle, so tasks sized by the
    bytes of the vertices would hold far more pixels than fit into memory."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return max(rows // ROWS_A_TASK, min(spark.sparkContext.defaultParallelism, rows // 2_000)) + 1


# views that others name several times and that cost a window or a join: a query computes each of them once, as a table
KEPT = ["vertex", "edge", "route", "branch", "gt_edge"]


def view(spark, sf_dir: str, name: str, ready: dict | None = None):
    """One view as a DataFrame; nested views are inlined as subqueries, but for those that are `ready` as tables."""
    ready = ready or {}
    text = ALL[name][0]
    deps = closure(text, 0, ready=ready)
    with_ = "WITH " + ", ".join(f"{n} AS ({b})" for n, b in deps) + " " if deps else ""
    frames = {}
    body = with_ + text
    if "TASKS" in body:
        body = body.replace("TASKS", str(tasks(spark, sf_dir)))
    body = body.replace("{", "{{").replace("}", "}}")
    for t in [*TABLES, *ready]:
        if t in _names(body):
            # only where rows are read: a column may bear the same name
            body = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", body) if t in ready else re.sub(rf"\b{t}\b", "{" + t + "}", body)
            frames[t] = ready[t] if t in ready else spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(body, **{t: d for t, d in frames.items() if "{" + t + "}" in body})


class Views:
    """Views of one scale-factor folder by attribute."""

    def __init__(self, spark, sf_dir):
        self._s, self._d, self._kept, self._tables = spark, sf_dir, {}, ()

    def _table(self, name):
        if name not in self._kept:
            self._kept[name] = staged(self._inlined(name))
        return self._kept[name]

    def _inlined(self, name):
        needs = {n for n, _ in closure(ALL[name][0], 0)} - {name}
        kept = [*KEPT, *self._tables]
        # those behind another kept view are read through it
        direct = {n for n, _ in closure(ALL[name][0], 0, ready=kept)} | {name}
        named = set().union(*(_names(ALL[n][0]) for n in direct))
        return view(self._s, self._d, name, {n: self._table(n) for n in kept if n in needs and n in named})

    def __getattr__(self, name):
        if name in self._tables:
            return self._table(name)
        # vertices asked for before anything needed their table stay dealt to their tasks by sheet
        return self._table(name) if name in KEPT and (name != "vertex" or name in self._kept) else self._inlined(name)


def area():
    """Registries of one check module and the decorator that fills them: a query over the views, and its SQL.

    `tables` are views the query reads from tables made once. Boxes that are joined by cell belong there: conditions on their columns are
    pushed below the columns, so the long expressions of a view would be computed again in every one of them. So do sheets that are tiled:
    conditions on their tiles would be tested on every box before sheets are grouped.
    """
    queries, oracles = {}, {}

    def check(name, sql=None, tables=(), **ctes):
        def run(fn, v):
            v._tables = tables
            return fn(v)

        def add(fn):
            queries[name] = lambda spark, sf_dir: run(fn, Views(spark, sf_dir))
            if sql is not None:
                oracles[name] = oracle(sql, **ctes)
            return fn
        return add

    return queries, oracles, check
