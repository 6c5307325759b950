"""Ink and branch evidence, junctions and the graph steps fed by them (L1-L27, G1, G2, G16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlparts import TYPE, inter
from checks.views import H, W, area, register
from sheetgraph.functions import geometry as g
from sheetgraph.operators import evaluate, graph, ink, junctions
from sheetgraph.operators.stage import staged

QUERIES, ORACLES, check = area()
r6 = lambda *n: [F.round(x, 6).alias(x) for x in n]

# small boxes around the detection centres, so that neighbours have gaps, with their dilated boxes
register("inode", f"""SELECT *, CAST(greatest(0,x1-3) AS INT) AS dx1, CAST(greatest(0,y1-3) AS INT) AS dy1, CAST(least({W},x2+3) AS INT) AS dx2, CAST(least({H},y2+3) AS INT) AS dy2 FROM (
 SELECT sheet_id, node_id, {TYPE} AS node_type, floor((x1+x2)/2)-4.0-h%4 AS x1, floor((y1+y2)/2)-4.0-h%3 AS y1, floor((x1+x2)/2)+4.0 AS x2, floor((y1+y2)/2)+4.0 AS y2, h FROM vertex) q""".replace("4.0", "CAST(4 AS DOUBLE)"))
# ink with printed borders on every third sheet
_FRAME = "UNION SELECT sheet_id, x, y FROM (SELECT sheet_id, {ex} AS x, CAST(10 AS BIGINT) AS y FROM sheetid WHERE sheet_id%3=0) f WHERE (x*7+sheet_id)%10<9 UNION SELECT sheet_id, x, y FROM (SELECT sheet_id, CAST(1985 AS BIGINT) AS x, {ey} AS y FROM sheetid WHERE sheet_id%3=1) f WHERE (y*3+sheet_id)%10<9"
register("sheetid", "SELECT DISTINCT sheet_id FROM det")
# edges and borders go to the task of their sheet before any pixel is drawn; places are plain columns, which Spark compiles, unlike lambdas
_DRAWN = """SELECT DISTINCT sheet_id, CASE side WHEN 0 THEN CAST(floor(ax+dx*i/64) AS BIGINT) WHEN 1 THEN CAST(i AS BIGINT) ELSE CAST(1985 AS BIGINT) END AS x,
  CASE side WHEN 0 THEN CAST(floor(ay+dy*i/64) AS BIGINT) WHEN 1 THEN CAST(10 AS BIGINT) ELSE CAST(i AS BIGINT) END AS y
 FROM (SELECT *, explode(sequence(0, CASE side WHEN 0 THEN 64 WHEN 1 THEN 1999 ELSE 1399 END)) AS i
 FROM (SELECT /*+ REPARTITION(TASKS, sheet_id) */ * FROM (
  SELECT e.sheet_id, 0 AS side, (a.x1+a.x2)/2 AS ax, (a.y1+a.y2)/2 AS ay, (b.x1+b.x2)/2-(a.x1+a.x2)/2 AS dx, (b.y1+b.y2)/2-(a.y1+a.y2)/2 AS dy, a.h AS h
  FROM edge e JOIN vertex a ON a.sheet_id=e.sheet_id AND a.node_id=e.u JOIN vertex b ON b.sheet_id=e.sheet_id AND b.node_id=e.v
  UNION ALL SELECT sheet_id, 1, NULL, NULL, NULL, NULL, NULL FROM sheetid WHERE sheet_id%3=0
  UNION ALL SELECT sheet_id, 2, NULL, NULL, NULL, NULL, NULL FROM sheetid WHERE sheet_id%3=1) u) t) q
 WHERE CASE side WHEN 0 THEN (h+i)%9<>0 WHEN 1 THEN (i*7+sheet_id)%10<9 ELSE (i*3+sheet_id)%10<9 END"""
register("framed", _DRAWN, "SELECT sheet_id, x, y FROM ink " + _FRAME.format(ex="unnest(range(2000))", ey="unnest(range(1400))"))
register("grey_px", "SELECT sheet_id, x, y, CAST((x*3+y)%7+200 AS INT) AS grey FROM framed")


def lines(v):
    """Branches with their traced length."""
    return ink.with_length(v.branch)


@check("l1_otsu_threshold", """SELECT sheet_id, arg_max(grey,(s,-grey)) AS threshold FROM (SELECT *, CASE WHEN nt>n0 THEN round(n0*(nt-n0)*pow(s0/n0-(st-s0)/(nt-n0),2)/nt,3) ELSE -1 END AS s FROM (
 SELECT sheet_id, grey, CAST(sum(n) OVER w AS DOUBLE) AS n0, CAST(sum(n*grey) OVER w AS DOUBLE) AS s0, CAST(sum(n) OVER (PARTITION BY sheet_id) AS DOUBLE) AS nt, CAST(sum(n*grey) OVER (PARTITION BY sheet_id) AS DOUBLE) AS st FROM grey_hist WINDOW w AS (PARTITION BY sheet_id ORDER BY grey)) a) b GROUP BY 1""")
def _(v):
    return ink.otsu(v.grey_hist)


@check("l2_frame_removal", f"""SELECT sheet_id, x, y FROM framed f WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.sheet_id=f.sheet_id AND fl.axis='y' AND f.y>=fl.lo AND f.y<fl.hi) AND NOT EXISTS (SELECT 1 FROM fl WHERE fl.sheet_id=f.sheet_id AND fl.axis='x' AND f.x>=fl.lo AND f.x<fl.hi)""",
       fl=f"""SELECT sheet_id, axis, CASE WHEN at_<80 THEN greatest(0,at_-6) ELSE greatest(len-80,at_-6) END AS lo, CASE WHEN at_<80 THEN least(80,at_+7) ELSE least(len,at_+7) END AS hi FROM (
 SELECT sheet_id, 'y' AS axis, y AS at_, {H} AS len FROM framed WHERE y<80 OR y>={H}-80 GROUP BY 1,2,3 HAVING count(*)>=0.75*{W} UNION ALL SELECT sheet_id, 'x', x, {W} FROM framed WHERE x<80 OR x>={W}-80 GROUP BY 1,2,3 HAVING count(*)>=0.75*{H}) q""")
def _(v):
    sheets = v.sheetid.withColumns({"width": F.lit(W), "height": F.lit(H)})
    return ink.drop_frame(v.framed, sheets)


@check("l3_modal_border", f"SELECT sheet_id, arg_max(grey,(k,-grey)) AS background FROM (SELECT sheet_id, grey, sum(CAST(y<30 AS INT)+CAST(y>={H}-30 AS INT)+CAST(x<30 AS INT)+CAST(x>={W}-30 AS INT)) AS k FROM grey_px WHERE y<30 OR y>={H}-30 OR x<30 OR x>={W}-30 GROUP BY 1,2) q GROUP BY 1")
def _(v):
    return ink.modal_border(v.grey_px, W, H)


@check("l4_erase", "SELECT sheet_id, x, y FROM ink i WHERE NOT EXISTS (SELECT 1 FROM inode n WHERE n.sheet_id=i.sheet_id AND i.x>=dx1 AND i.x<dx2 AND i.y>=dy1 AND i.y<dy2)")
def _(v):
    return ink.erase(v.ink, v.inode)


NB = dict(nbr="SELECT a.sheet_id, a.x, a.y, count(*) AS neighbours FROM ink a JOIN (SELECT sheet_id, x+dx AS x, y+dy AS y FROM ink, (SELECT unnest([-1,0,1]) AS dx) p, (SELECT unnest([-1,0,1]) AS dy) q WHERE dx<>0 OR dy<>0) b ON b.sheet_id=a.sheet_id AND b.x=a.x AND b.y=a.y GROUP BY 1,2,3")


@check("l5_junction_pixels", "SELECT sheet_id, x, y, CAST(neighbours AS BIGINT) AS neighbours FROM nbr WHERE neighbours>=3", **NB)
def _(v):
    return ink.junction_pixels(v.ink)


_REACH = ink.touching_offsets(3)
CLU = dict(NB, jp="SELECT sheet_id, x, y, CAST(y AS BIGINT)*4294967296+x AS pid FROM nbr WHERE neighbours>=3",
           je="SELECT a.sheet_id, a.pid AS u, b.pid AS v FROM (SELECT *, x//15 AS kx, y//15 AS ky FROM jp) a JOIN (SELECT sheet_id, x, y, pid, x//15+ox AS kx, y//15+oy AS ky FROM jp, (SELECT unnest([-1,0,1]) AS ox) p, (SELECT unnest([-1,0,1]) AS oy) q) b ON b.sheet_id=a.sheet_id AND b.kx=a.kx AND b.ky=a.ky AND a.pid<>b.pid AND abs(a.x-b.x)<=CASE abs(a.y-b.y) "
              + " ".join(f"WHEN {k} THEN {w}" for k, w in _REACH.items()) + " ELSE -1 END",
           jw="SELECT sheet_id, pid, pid AS root FROM jp UNION SELECT w.sheet_id, e.v, w.root FROM jw w JOIN je e ON e.sheet_id=w.sheet_id AND e.u=w.pid AND w.root<e.v",
           jc="SELECT jp.sheet_id, jp.x, jp.y, m.cluster FROM jp JOIN (SELECT sheet_id, pid, min(root) AS cluster FROM jw GROUP BY 1,2) m ON m.sheet_id=jp.sheet_id AND m.pid=jp.pid",
           cc="SELECT sheet_id, cluster, avg(x) AS cx, avg(y) AS cy, CAST(count(*) AS BIGINT) AS n_pixels FROM jc GROUP BY 1,2")


def clusters(v):
    return staged(ink.cluster(ink.junction_pixels(v.ink)))


@check("l6_junction_clusters", "SELECT sheet_id, cluster, round(cx,6) AS cx, round(cy,6) AS cy, n_pixels FROM cc", **CLU)
def _(v):
    return ink.cluster_centres(clusters(v)).select("sheet_id", "cluster", *r6("cx", "cy"), "n_pixels")


BL = dict(bl="SELECT sheet_id, branch_id, sum(sqrt(pow(r-pr,2)+pow(c-pc,2))) AS length_px FROM (SELECT *, lag(r) OVER w AS pr, lag(c) OVER w AS pc FROM branch_pt WINDOW w AS (PARTITION BY sheet_id, branch_id ORDER BY k)) q GROUP BY 1,2")


@check("l7_branch_length", "SELECT sheet_id, branch_id, round(length_px,4) AS length_px FROM bl WHERE length_px>=150", **BL)
def _(v):
    return ink.min_length(lines(v), 150).select("sheet_id", "branch_id", F.round("length_px", 4).alias("length_px"))


BIND = dict(
    be="SELECT sheet_id, branch_id, branch_type, CASE k WHEN 0 THEN 'src' ELSE 'dst' END AS which_end, c AS px, r AS py FROM branch_pt WHERE k IN (0,24)",
    bh="SELECT e.sheet_id, e.branch_id, e.which_end, n.node_id, pow(greatest(dx1-px,0,px-dx2),2)+pow(greatest(dy1-py,0,py-dy2),2) AS e, pow(px-(n.x1+n.x2)/2,2)+pow(py-(n.y1+n.y2)/2,2) AS c FROM be e JOIN inode n ON n.sheet_id=e.sheet_id AND n.node_type<>'tag_rect' AND px BETWEEN dx1-5 AND dx2+5 AND py BETWEEN dy1-5 AND dy2+5",
    ep=f"""SELECT b.*, w.node_id AS bound_node_id, coalesce(w.k>1,false) AS contested, w.node_id IS NULL AND (px<300 OR px>={W}-300 OR py<300 OR py>={H}-300) AS is_off_page FROM be b LEFT JOIN (SELECT sheet_id, branch_id, which_end, arg_min(node_id,(e,c,node_id)) AS node_id, count(*) AS k FROM bh GROUP BY 1,2,3) w ON w.sheet_id=b.sheet_id AND w.branch_id=b.branch_id AND w.which_end=b.which_end""")


def ends(v):
    """Bound ends; the border strip is wide here because the derived pages have nothing at their very edge."""
    return ink.bind(v.branch, v.inode, W, H, 5, 300)


@check("l8_endpoint_binding", "SELECT sheet_id, branch_id, which_end, px, py, bound_node_id, CAST(contested AS INT) AS contested, CAST(is_off_page AS INT) AS is_off_page FROM ep", **BIND)
def _(v):
    return ends(v).select("sheet_id", "branch_id", "which_end", "px", "py", "bound_node_id", F.col("contested").cast("int"), F.col("is_off_page").cast("int"))


@check("l8_ports", "SELECT sheet_id, bound_node_id AS node_id, CAST(count(*) AS INT) AS n_ports FROM ep WHERE bound_node_id IS NOT NULL GROUP BY 1,2", **BIND)
def _(v):
    return ink.ports(ends(v)).select("sheet_id", "node_id", F.size("ports").alias("n_ports"))


OFF = dict(BIND, oc="SELECT *, CAST(round_even(px/20.0,0) AS BIGINT) AS kx, CAST(round_even(py/20.0,0) AS BIGINT) AS ky, branch_id*2+CASE which_end WHEN 'dst' THEN 1 ELSE 0 END AS o FROM ep WHERE is_off_page",
           on_="SELECT q.sheet_id, kx, ky, px, py, coalesce(l.last,-1)+row_number() OVER (PARTITION BY q.sheet_id ORDER BY o) AS node_id FROM (SELECT sheet_id, kx, ky, min(o) AS o, arg_min(px,o) AS px, arg_min(py,o) AS py FROM oc GROUP BY 1,2,3) q LEFT JOIN (SELECT sheet_id, max(node_id) AS last FROM inode GROUP BY 1) l ON l.sheet_id=q.sheet_id")


@check("l9_off_page_nodes", "SELECT sheet_id, CAST(node_id AS BIGINT) AS node_id, px-CAST(4 AS DOUBLE) AS x1, py-CAST(4 AS DOUBLE) AS y1 FROM on_", **OFF)
def _(v):
    return ink.off_page(ends(v), v.inode)[0].select("sheet_id", "node_id", "x1", "y1")


@check("l9_off_page_binding", "SELECT e.sheet_id, e.branch_id, e.which_end, CAST(coalesce(e.bound_node_id, n.node_id) AS BIGINT) AS bound_node_id FROM ep e LEFT JOIN oc o ON o.sheet_id=e.sheet_id AND o.branch_id=e.branch_id AND o.which_end=e.which_end LEFT JOIN on_ n ON n.sheet_id=o.sheet_id AND n.kx=o.kx AND n.ky=o.ky", **OFF)
def _(v):
    return ink.off_page(ends(v), v.inode)[1].select("sheet_id", "branch_id", "which_end", "bound_node_id")


@check("l10_unbound_tips", """SELECT t.sheet_id, t.branch_id, t.which_end, w.near_id, CASE WHEN w.near_id IS NULL THEN 'a' WHEN w.near_id IN (SELECT bound_node_id FROM ep p WHERE p.sheet_id=t.sheet_id AND bound_node_id IS NOT NULL) THEN 'c' ELSE 'b' END AS bucket FROM tp t
 LEFT JOIN (SELECT e.sheet_id, e.branch_id, e.which_end, arg_min(n.node_id,(pow(px-(n.x1+n.x2)/2,2)+pow(py-(n.y1+n.y2)/2,2), n.node_id)) AS near_id FROM tp e JOIN inode n ON n.sheet_id=e.sheet_id AND n.node_type<>'tag_rect' AND px BETWEEN dx1-10 AND dx2+10 AND py BETWEEN dy1-10 AND dy2+10 GROUP BY 1,2,3) w ON w.sheet_id=t.sheet_id AND w.branch_id=t.branch_id AND w.which_end=t.which_end""", **dict(BIND, tp="SELECT * FROM ep WHERE bound_node_id IS NULL AND NOT is_off_page AND branch_type IN (0,1)"))
def _(v):
    return ink.audit_tips(ends(v), v.inode).select("sheet_id", "branch_id", "which_end", "near_id", "bucket")


def dirs(k: int) -> str:
    return f"SELECT e.*, CASE WHEN m>=0.5 THEN dx/m ELSE 0 END AS sx, CASE WHEN m>=0.5 THEN dy/m ELSE 0 END AS sy, degrees(atan2(dy,dx)) AS inward FROM (SELECT e.*, CAST(p.c-e.px AS DOUBLE) AS dx, CAST(p.r-e.py AS DOUBLE) AS dy, sqrt(pow(p.c-e.px,2)+pow(p.r-e.py,2)) AS m FROM ep e JOIN branch_pt p ON p.sheet_id=e.sheet_id AND p.branch_id=e.branch_id AND p.k=CASE e.which_end WHEN 'src' THEN {k} ELSE {24-k} END) e"


@check("l11_stub_direction", "SELECT sheet_id, branch_id, which_end, round(sx,6) AS sx, round(sy,6) AS sy, round(inward,6) AS inward FROM dr", **dict(BIND, dr=dirs(5)))
def _(v):
    return ink.stub_dirs(ends(v), v.branch).select("sheet_id", "branch_id", "which_end", *r6("sx", "sy", "inward"))


GAP = dict(
    gn="SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM inode WHERE node_type<>'tag_rect'",
    gp="SELECT a.sheet_id, a.node_id AS a_id, b.node_id AS b_id, a.cx AS acx, a.cy AS acy, b.cx AS bcx, b.cy AS bcy, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, greatest(0,a.x1-b.x2,b.x1-a.x2)=0 AND greatest(0,a.y1-b.y2,b.y1-a.y2)=0 AS touch FROM gn a JOIN gn b ON a.sheet_id=b.sheet_id AND a.node_id<b.node_id AND pow(greatest(0,a.dx1-b.dx2,b.dx1-a.dx2),2)+pow(greatest(0,a.dy1-b.dy2,b.dy1-a.dy2),2)<=2500",
    ip="SELECT DISTINCT p.sheet_id, p.a_id, p.b_id FROM gp p JOIN gn c ON c.sheet_id=p.sheet_id AND c.node_id<>a_id AND c.node_id<>b_id WHERE pow(bcx-acx,2)+pow(bcy-acy,2)>=1 AND ((cx-acx)*(bcx-acx)+(cy-acy)*(bcy-acy))/(pow(bcx-acx,2)+pow(bcy-acy,2)) BETWEEN 0.15 AND 0.85 AND pow((cy-acy)*(bcx-acx)-(cx-acx)*(bcy-acy),2)<=400*(pow(bcx-acx,2)+pow(bcy-acy,2))",
    dp="SELECT * FROM gp p WHERE NOT EXISTS (SELECT 1 FROM ip WHERE ip.sheet_id=p.sheet_id AND ip.a_id=p.a_id AND ip.b_id=p.b_id)")


def region(margin: str, mask: str | None) -> dict[str, str]:
    """Pixels of each pair's region outside its own boxes, with the third-node test."""
    box = "dx1,dy1,dx2,dy2" if mask == "dilated" else "CAST(x1 AS INT),CAST(y1 AS INT),CAST(x2 AS INT),CAST(y2 AS INT)"
    b = box.split(",")
    return dict(
        rp=f"""SELECT p.*, i.x, i.y FROM gp p JOIN ink i ON i.sheet_id=p.sheet_id AND i.x>=greatest(0,least(ax1,bx1)-{margin}) AND i.x<least({W},greatest(ax2,bx2)+{margin}) AND i.y>=greatest(0,least(ay1,by1)-{margin}) AND i.y<least({H},greatest(ay2,by2)+{margin})
 WHERE NOT (i.x>=ax1 AND i.x<ax2 AND i.y>=ay1 AND i.y<ay2) AND NOT (i.x>=bx1 AND i.x<bx2 AND i.y>=by1 AND i.y<by2)""",
        tr=f"SELECT DISTINCT r.sheet_id, r.a_id, r.b_id, r.x, r.y FROM rp r JOIN inode n ON n.sheet_id=r.sheet_id AND n.node_type<>'flow_arrow' AND n.node_id<>r.a_id AND n.node_id<>r.b_id AND r.x>={b[0]} AND r.x<{b[2]} AND r.y>={b[1]} AND r.y<{b[3]}",
        rt="SELECT r.*, t.x IS NOT NULL AS third FROM rp r LEFT JOIN tr t ON t.sheet_id=r.sheet_id AND t.a_id=r.a_id AND t.b_id=r.b_id AND t.x=r.x AND t.y=r.y",
        al=f"""SELECT *, (x-acx)*ux+(y-acy)*uy AS al, abs((y-acy)*ux-(x-acx)*uy) AS off FROM (SELECT *, CASE WHEN seg>=1 THEN (bcx-acx)/seg ELSE 1 END AS ux, CASE WHEN seg>=1 THEN (bcy-acy)/seg ELSE 0 END AS uy FROM (SELECT *, sqrt((bcx-acx)*(bcx-acx)+(bcy-acy)*(bcy-acy)) AS seg FROM rt {'WHERE NOT third' if mask == 'dilated' else ''}) a) b""",
        lh="SELECT *, min(CASE WHEN off<=10 THEN al END) OVER w AS lo, max(CASE WHEN off<=10 THEN al END) OVER w AS hi FROM al WINDOW w AS (PARTITION BY sheet_id, a_id, b_id)",
        cor="SELECT sheet_id, a_id, b_id, bool_or(touch) AS touch, count(*) AS n_ink, max(seg) AS seg, count_if(off<=10) AS n_corr, max(hi-lo) AS extent, count(DISTINCT CASE WHEN off<=10 THEN floor((al-lo)/2) END) AS bins, coalesce(count_if(off>10 AND off<=30 AND al>=lo AND al<=hi),0) AS n_wider, avg(CASE WHEN off<=10 THEN CAST(third AS INT) END) AS third_share, greatest(1,floor(max(hi-lo)/2)) AS n_bins FROM lh GROUP BY 1,2,3",
        ok="SELECT * FROM cor WHERE CASE WHEN touch THEN n_ink>0 WHEN seg<1 THEN true WHEN n_corr=0 THEN false WHEN extent<2 THEN true WHEN bins/n_bins<0.5 THEN false WHEN n_wider>n_corr*3 THEN false ELSE true END")


MARGIN = "CASE WHEN touch THEN 10 ELSE 2 END"


@check("l13_gap_pairs", "SELECT sheet_id, a_id, b_id FROM gp", **GAP)
def _(v):
    return ink.gap_pairs(v.inode).select("sheet_id", "a_id", "b_id")


@check("l14_interposition", "SELECT sheet_id, a_id, b_id FROM dp", **GAP)
def _(v):
    n = staged(v.inode)  # nodes are a table of the graph, read several times
    return ink.drop_interposed(ink.gap_pairs(n), n).select("sheet_id", "a_id", "b_id")


@check("l15_corridor", "SELECT sheet_id, a_id, b_id, CAST(n_ink AS BIGINT) AS n_ink, CAST(n_corr AS BIGINT) AS n_corr, round(extent,6) AS extent, CAST(bins AS INT) AS bins, CAST(n_wider AS BIGINT) AS n_wider FROM cor WHERE NOT touch", **GAP, **region(MARGIN, "dilated"))
def _(v):
    n = staged(v.inode)  # nodes are a table of the graph, read several times
    p = ink.gap_pairs(n).filter(~ink.touching())
    return ink.corridor(p, v.ink, n, W, H).select("sheet_id", "a_id", "b_id", "n_ink", "n_corr", *r6("extent"), "bins", "n_wider")


@check("l16_touch_ink", "SELECT sheet_id, a_id, b_id FROM ok WHERE touch", **GAP, **region(MARGIN, "dilated"))
def _(v):
    n = staged(v.inode)  # nodes are a table of the graph, read several times
    return ink.with_ink(ink.gap_pairs(n).filter(ink.touching()), v.ink, n, W, H).select("sheet_id", "a_id", "b_id")


@check("l17_any_path", "SELECT sheet_id, a_id, b_id FROM gp WHERE touch UNION SELECT sheet_id, a_id, b_id FROM rp WHERE NOT touch", **GAP, **region("2", None))
def _(v):
    return ink.any_path(ink.gap_pairs(v.inode), v.ink, W, H).select("sheet_id", "a_id", "b_id")


STUB = dict(BIND, **GAP, dr=dirs(5), **region(MARGIN, "dilated"),
            sc="""SELECT sheet_id, a_id, b_id, s, CASE WHEN bool_or(dot>=0.573576436351046) THEN 'toward' WHEN bool_or(dot>-0.573576436351046) THEN 'perpendicular' ELSE 'away' END AS cls FROM (
 SELECT p.sheet_id, p.a_id, p.b_id, 'a' AS s, d.sx*((bcx-acx)/q)+d.sy*((bcy-acy)/q) AS dot FROM (SELECT *, sqrt(pow(bcx-acx,2)+pow(bcy-acy,2)) AS q FROM gp) p JOIN dr d ON d.sheet_id=p.sheet_id AND d.bound_node_id=p.a_id AND (sx<>0 OR sy<>0) WHERE q>=1
 UNION ALL SELECT p.sheet_id, p.a_id, p.b_id, 'b', d.sx*((acx-bcx)/q)+d.sy*((acy-bcy)/q) FROM (SELECT *, sqrt(pow(bcx-acx,2)+pow(bcy-acy,2)) AS q FROM gp) p JOIN dr d ON d.sheet_id=p.sheet_id AND d.bound_node_id=p.b_id AND (sx<>0 OR sy<>0) WHERE q>=1) z GROUP BY 1,2,3,4""",
            sk="SELECT p.sheet_id, p.a_id, p.b_id, a.cls AS a_stub, b.cls AS b_stub, coalesce(a.cls='toward',false) OR coalesce(b.cls='toward',false) OR NOT (coalesce(a.cls='perpendicular',false) OR coalesce(b.cls='perpendicular',false)) AS stub_ok FROM gp p LEFT JOIN sc a ON a.sheet_id=p.sheet_id AND a.a_id=p.a_id AND a.b_id=p.b_id AND a.s='a' LEFT JOIN sc b ON b.sheet_id=p.sheet_id AND b.a_id=p.a_id AND b.b_id=p.b_id AND b.s='b'")


def stubs(v):
    return ink.stub_dirs(ends(v), v.branch)


@check("l12_stub_class", "SELECT sheet_id, a_id, b_id, a_stub, b_stub, CAST(stub_ok AS INT) AS stub_ok FROM sk", **STUB)
def _(v):
    return ink.stub_class(ink.gap_pairs(v.inode), stubs(v)).select("sheet_id", "a_id", "b_id", "a_stub", "b_stub", F.col("stub_ok").cast("int"))


@check("l18_short_gap_pairs", "SELECT p.sheet_id, p.a_id, p.b_id FROM dp p JOIN ok ON ok.sheet_id=p.sheet_id AND ok.a_id=p.a_id AND ok.b_id=p.b_id JOIN sk ON sk.sheet_id=p.sheet_id AND sk.a_id=p.a_id AND sk.b_id=p.b_id WHERE stub_ok", **STUB)
def _(v):
    return ink.short_gap_pairs(v.inode, v.ink, W, H, stubs(v))


@check("l25_corridor_diagnosis", "SELECT sheet_id, a_id, b_id, CAST(n_corr AS BIGINT) AS n_corr, round(CASE WHEN seg<1 OR extent<2 THEN 1 ELSE bins/n_bins END,6) AS continuity, round(third_share,6) AS third_share FROM cor WHERE n_corr>0", **GAP, **region("2", "original"))
def _(v):
    n = staged(v.inode)  # nodes are a table of the graph, read several times
    d = ink.corridor(ink.gap_pairs(n), v.ink, n, W, H, mask_third=False, touch_margin=2).filter("n_corr > 0")
    cont = F.when((F.col("seg") < 1) | (F.col("extent") < 2), 1.0).otherwise(F.col("bins") / F.col("n_bins"))
    return d.select("sheet_id", "a_id", "b_id", "n_corr", F.round(cont, 6).alias("continuity"), *r6("third_share"))


@check("g16_edge_mechanism", "SELECT p.sheet_id, p.a_id, p.b_id, CASE WHEN p.a_id%4=0 THEN 'contracted:connector' WHEN p.a_id%4=1 THEN 'skeleton_branch' WHEN p.touch THEN 'bbox_touch' WHEN third_share>=0.5 THEN 'third_node_ink' ELSE 'short_gap' END AS mechanism FROM gp p LEFT JOIN cor ON cor.sheet_id=p.sheet_id AND cor.a_id=p.a_id AND cor.b_id=p.b_id", **GAP, **region("2", "original"))
def _(v):
    n = staged(v.inode)  # nodes are a table of the graph, read several times
    p = ink.gap_pairs(n)
    d = ink.corridor(p, v.ink, n, W, H, mask_third=False, touch_margin=2).select("sheet_id", "a_id", "b_id", "third_share")
    m = evaluate.mechanism(F.when(F.col("a_id") % 4 == 0, "connector"), F.col("a_id") % 4 >= 2, ink.touching(), F.coalesce("third_share", F.lit(0.0)))
    return p.join(d, ["sheet_id", "a_id", "b_id"], "left").select("sheet_id", "a_id", "b_id", m.alias("mechanism"))


BAT = dict(CLU, be=BIND["be"], bat="""SELECT sheet_id, cluster, branch_id, max(which_end) AS which_end FROM (SELECT e.sheet_id, c.cluster, e.branch_id, e.which_end FROM be e JOIN jc c ON c.sheet_id=e.sheet_id AND c.x=e.px AND c.y=e.py
 UNION ALL SELECT e.sheet_id, c.cluster, e.branch_id, e.which_end FROM be e JOIN cc c ON c.sheet_id=e.sheet_id AND pow(px-cx,2)+pow(py-cy,2)<=100) q GROUP BY 1,2,3""",
    ep=BIND["be"], dr=dirs(8), bd="SELECT b.*, d.inward FROM bat b JOIN dr d ON d.sheet_id=b.sheet_id AND d.branch_id=b.branch_id AND d.which_end=b.which_end",
    ct="""SELECT sheet_id, cluster, CAST(count(*) AS BIGINT) AS degree, CASE WHEN count(*)=2 THEN CASE WHEN abs(least(abs(max(inward)-min(inward)),360-abs(max(inward)-min(inward)))-180)>=20 THEN 'elbow' ELSE 'straight' END WHEN count(*)=3 THEN 'tee' WHEN count(*)=4 THEN '4way' ELSE 'nway' END AS subtype FROM bd GROUP BY 1,2 HAVING count(*)>=2""")


def at_clusters(v):
    c = clusters(v)
    centres = ink.cluster_centres(c)
    return staged(junctions.branches_at(centres, c, v.branch)), centres


@check("l19_branches_at_junction", "SELECT sheet_id, cluster, branch_id, which_end FROM bat", **BAT)
def _(v):
    return at_clusters(v)[0].select("sheet_id", "cluster", "branch_id", "which_end")


@check("l20_connector_type", "SELECT sheet_id, cluster, degree, subtype FROM ct", **BAT)
def _(v):
    return junctions.connector_type(at_clusters(v)[0], v.branch).select("sheet_id", "cluster", "degree", "subtype")


RUN = dict(sg="SELECT sheet_id, branch_id AS pair_id, max(CASE WHEN k=0 THEN c END) AS ax, max(CASE WHEN k=0 THEN r END) AS ay, max(CASE WHEN k=3 THEN c END) AS bx, max(CASE WHEN k=3 THEN r END) AS by_ FROM branch_pt GROUP BY 1,2",
           sm=f"SELECT sheet_id, pair_id, i, least(greatest(CAST(round_even(i*CASE WHEN n>1 THEN (bx-ax)/(n-1) ELSE 0 END+ax,0) AS BIGINT),0),{W-1}) AS x, least(greatest(CAST(round_even(i*CASE WHEN n>1 THEN (by_-ay)/(n-1) ELSE 0 END+ay,0) AS BIGINT),0),{H-1}) AS y FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(abs(bx-ax),abs(by_-ay))+1 AS n FROM sg) a) b",
           il="SELECT s.*, CASE WHEN k.x IS NULL THEN 0 ELSE 1 END AS dark, sum(CASE WHEN k.x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.sheet_id, s.pair_id ORDER BY s.i) AS isl FROM sm s LEFT JOIN ink k ON k.sheet_id=s.sheet_id AND k.x=s.x AND k.y=s.y")


@check("l21_gap_run", "SELECT g.sheet_id, g.pair_id, CAST(coalesce(max(r.n),0) AS BIGINT) AS gap_run FROM sg g LEFT JOIN (SELECT sheet_id, pair_id, isl, count(*) AS n FROM il WHERE dark=0 GROUP BY 1,2,3) r ON r.sheet_id=g.sheet_id AND r.pair_id=g.pair_id GROUP BY 1,2", **RUN)
def _(v):
    at = lambda i, f: F.col("coords")[i][f]
    seg = v.branch.select("sheet_id", F.col("branch_id").alias("pair_id"), at(0, "c").alias("ax"), at(0, "r").alias("ay"), at(3, "c").alias("bx"), at(3, "r").alias("by"))
    return junctions.gap_runs(seg, v.ink, W, H)


FACE = dict(BIND, tip="SELECT * FROM dr WHERE bound_node_id IS NULL AND NOT is_off_page AND branch_type IN (0,1)", dr=dirs(8),
    fp="""SELECT * FROM (SELECT a.sheet_id, concat_ws('-',a.branch_id,a.which_end,b.branch_id,b.which_end) AS pair_id, a.branch_id AS ab, b.branch_id AS bb, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_, pow(a.px-b.px,2)+pow(a.py-b.py,2) AS gap2,
 abs(least(abs(a.inward-b.inward),360-abs(a.inward-b.inward))-180) AS err FROM tip a JOIN tip b ON a.sheet_id=b.sheet_id AND a.branch_id<b.branch_id) q WHERE gap2>=25 AND gap2<=12100 AND err<=30""",
    sg="SELECT sheet_id, pair_id, ax, ay, bx, by_ FROM fp", sm=RUN["sm"], il=RUN["il"],
    fc="SELECT p.* FROM fp p JOIN (SELECT sheet_id, pair_id, max(n) AS n FROM (SELECT sheet_id, pair_id, isl, count(*) AS n FROM il WHERE dark=0 GROUP BY 1,2,3) z GROUP BY 1,2) r ON r.sheet_id=p.sheet_id AND r.pair_id=p.pair_id AND r.n>=4")


@check("l22_facing_tips", "SELECT sheet_id, pair_id, round(gap2,6) AS gap2, round(err,6) AS err FROM fc", **FACE)
def _(v):
    return junctions.facing_tips(ends(v), v.branch, v.ink, W, H).select("sheet_id", "pair_id", *r6("gap2", "err"))


CROSS = dict(FACE, ov="SELECT DISTINCT p.sheet_id, p.pair_id, b.branch_id AS over_ FROM fc p JOIN branch_pt b ON b.sheet_id=p.sheet_id AND b.branch_id<>ab AND b.branch_id<>bb AND pow(b.c-(ax+bx)/2.0,2)+pow(b.r-(ay+by_)/2.0,2)<=225",
    oo="SELECT p.sheet_id, p.pair_id, ab, bb, list(over_ ORDER BY over_) AS o, row_number() OVER (PARTITION BY p.sheet_id ORDER BY any_value(gap2), any_value(err), p.pair_id) AS rn FROM fc p JOIN ov ON ov.sheet_id=p.sheet_id AND ov.pair_id=p.pair_id GROUP BY 1,2,3,4",
    cw="""SELECT sheet_id, pair_id, ab, bb, o, rn, [ab,bb] AS used, true AS take FROM oo WHERE rn=1 UNION ALL SELECT sheet_id, pair_id, ab, bb, o, rn, CASE WHEN free THEN list_concat(used,[ab,bb]) ELSE used END, free FROM (
 SELECT n.*, c.used, NOT list_contains(c.used,n.ab) AND NOT list_contains(c.used,n.bb) AS free FROM cw c JOIN oo n ON n.sheet_id=c.sheet_id AND n.rn=c.rn+1) q""")


@check("l23_crossing_selection", "SELECT sheet_id, pair_id, ab AS a_under, bb AS b_under, o[1] AS a_over, coalesce(o[2],o[1]) AS b_over FROM cw WHERE take", **CROSS)
def _(v):
    c = junctions.crossings(junctions.facing_tips(ends(v), v.branch, v.ink, W, H), v.branch)
    p = lambda i, n: F.col("pass_pairs")[i][n]
    return c.select("sheet_id", "pair_id", p(0, "a").alias("a_under"), p(0, "b").alias("b_under"), p(1, "a").alias("a_over"), p(1, "b").alias("b_over"))


# four-branch junctions: the vertices themselves as cluster centres, with every branch end in reach
@check("l24_reclassify_4way")
def _(v):
    c = v.vertex.select("sheet_id", F.col("node_id").alias("cluster"), g.cx().alias("cx"), g.cy().alias("cy"))
    none = c.select("sheet_id", "cluster", F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("y"))
    at = junctions.branches_at(c, none, v.branch, 45)
    d = junctions.reclassify_4way(at, c, v.branch, v.ink, W, H, tol=60)
    return d.select("sheet_id", "cluster", *r6("gap_p", "gap_q"), F.to_json("pass_pairs").alias("pass_pairs"))


@check("l26_arrow_tips", f"""SELECT a.sheet_id, a.arrow_id, CASE WHEN x2-x1>=y2-y1 THEN CASE WHEN hi THEN x2 ELSE x1 END ELSE (x1+x2)/2 END AS tip_x, CASE WHEN x2-x1>=y2-y1 THEN (y1+y2)/2 ELSE CASE WHEN hi THEN y2 ELSE y1 END END AS tip_y FROM (
 SELECT a.sheet_id, a.arrow_id, a.x1, a.y1, a.x2, a.y2, coalesce(count(i.x) FILTER (WHERE f)>count(i.x) FILTER (WHERE NOT f),false) AS hi FROM (SELECT sheet_id, det_id AS arrow_id, x1,y1,x2,y2 FROM det WHERE cls_id=23) a LEFT JOIN LATERAL (SELECT i.x, CASE WHEN a.x2-a.x1>=a.y2-a.y1 THEN i.x>=a.x1+floor((a.x2-a.x1)/2) ELSE i.y>=a.y1+floor((a.y2-a.y1)/2) END AS f FROM ink i WHERE i.sheet_id=a.sheet_id AND i.x>=a.x1 AND i.x<a.x2 AND i.y>=a.y1 AND i.y<a.y2) i ON true GROUP BY 1,2,3,4,5,6) a""")
def _(v):
    a = v.det.filter("cls_id=23").select("sheet_id", F.col("det_id").alias("arrow_id"), "x1", "y1", "x2", "y2")
    return ink.arrow_tips(a, v.ink, W, H)


@check("l27_short_stubs", "SELECT b.sheet_id, CAST(count(*) AS BIGINT) AS n_short_stubs FROM bl b WHERE length_px<300 AND EXISTS (SELECT 1 FROM ep e JOIN inode n ON n.sheet_id=e.sheet_id AND n.node_id=e.bound_node_id AND n.node_type IN ('valve','instrument') WHERE e.sheet_id=b.sheet_id AND e.branch_id=b.branch_id) GROUP BY 1", **BIND, **BL)
def _(v):
    return ink.short_stubs(lines(v), ends(v), v.inode, 150)


# junction vertices for the endpoint map: derived connectors and crossings with the branches ending near them
MAP = dict(BIND, jv="SELECT sheet_id, node_id AS junc_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM vertex WHERE node_type IN ('connector','crossing')",
    jb="SELECT j.sheet_id, j.junc_id, r.branch_id, cx, cy, sx, sy, tx, ty FROM jv j JOIN branch r ON r.sheet_id=j.sheet_id AND (r.u=j.junc_id OR r.v=j.junc_id)",
    jf="SELECT sheet_id, branch_id, which_end, min(junc_id) AS junc_id FROM (SELECT *, CASE WHEN pow(sx-cx,2)+pow(sy-cy,2)<=pow(tx-cx,2)+pow(ty-cy,2) THEN 'src' ELSE 'dst' END AS which_end FROM jb) q GROUP BY 1,2,3",
    em="SELECT e.sheet_id, e.branch_id, e.which_end, CASE WHEN e.bound_node_id IS NOT NULL THEN concat('sym_',e.bound_node_id) WHEN j.junc_id IS NOT NULL THEN concat('junc_',j.junc_id) END AS gid FROM ep e LEFT JOIN jf j ON j.sheet_id=e.sheet_id AND j.branch_id=e.branch_id AND j.which_end=e.which_end",
    **{k: b for k, b in GAP.items()},
    ge_="SELECT s.sheet_id, least(s.gid,t.gid) AS u, greatest(s.gid,t.gid) AS v, min(s.branch_id) AS branch_id FROM em s JOIN em t ON t.sheet_id=s.sheet_id AND t.branch_id=s.branch_id AND s.which_end='src' AND t.which_end='dst' WHERE s.gid IS NOT NULL AND t.gid IS NOT NULL AND s.gid<>t.gid GROUP BY 1,2,3")


def mapped(v):
    b = v.branch
    near = b.select("sheet_id", F.col("u").alias("junc_id"), "branch_id").unionByName(b.select("sheet_id", F.col("v").alias("junc_id"), "branch_id"))
    j = v.vertex.filter("node_type in ('connector','crossing')").select("sheet_id", F.col("node_id").alias("junc_id"), g.cx().alias("cx"), g.cy().alias("cy"))
    j = j.join(near.groupBy("sheet_id", "junc_id").agg(F.collect_list("branch_id").alias("branch_ids")), ["sheet_id", "junc_id"])
    return graph.endpoint_map(ends(v), j, b)


@check("g1_endpoint_map", "SELECT sheet_id, branch_id, which_end, gid FROM em", **MAP)
def _(v):
    return mapped(v)


@check("g2_graph_build", """SELECT sheet_id, u, v, branch_id FROM ge_ UNION ALL SELECT p.sheet_id, least(concat('sym_',a_id),concat('sym_',b_id)), greatest(concat('sym_',a_id),concat('sym_',b_id)), NULL FROM gp p WHERE NOT EXISTS (SELECT 1 FROM ge_ g WHERE g.sheet_id=p.sheet_id AND g.u=least(concat('sym_',a_id),concat('sym_',b_id)) AND g.v=greatest(concat('sym_',a_id),concat('sym_',b_id)))""", **MAP)
def _(v):
    return graph.build(lines(v), mapped(v), ink.gap_pairs(v.inode)).select("sheet_id", "u", "v", "branch_id")


@check("g2_dangling", "SELECT sheet_id, CAST(count_if(k<2) AS BIGINT) AS n_dangling FROM (SELECT sheet_id, branch_id, count(gid) AS k FROM em GROUP BY 1,2) q GROUP BY 1", **MAP)
def _(v):
    return graph.dangling(mapped(v))
