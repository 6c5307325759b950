"""Connectivity graphs as vertex and edge tables: construction, contraction, paths and flow."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, functions as F

from sheetgraph.functions.geometry import n_rows
from sheetgraph import params as P
from sheetgraph.functions import geometry as g
from sheetgraph.operators.cells import over_cells, points_in_reach
from sheetgraph.operators.components import components
from sheetgraph.operators.stage import has_rows, staged
from sheetgraph.operators.suppress import SHEET


def ordered(e: DataFrame, u="u", v="v") -> DataFrame:
    """Edges with the smaller end first."""
    return e.withColumns({u: F.least(u, v), v: F.greatest(u, v)})


def both_ways(e: DataFrame, keys=SHEET, a="a", b="b") -> DataFrame:
    f = e.select(*keys, F.col("u").alias(a), F.col("v").alias(b))
    return f.unionByName(e.select(*keys, F.col("v").alias(a), F.col("u").alias(b)))


# --- construction -----------------------------------------------------------------------------------------------

def endpoint_map(ep: DataFrame, junctions: DataFrame, branches: DataFrame, keys=SHEET) -> DataFrame:
    """Vertex of every branch end: the bound symbol, else the first junction whose nearest end of the branch this is."""
    keys = list(keys)
    ends = branches.select(*keys, "branch_id", F.element_at("coords", 1).alias("s"), F.element_at("coords", -1).alias("t"))
    j = junctions.select(*keys, "junc_id", "cx", "cy", F.explode("branch_ids").alias("branch_id")).join(ends, [*keys, "branch_id"])
    ds = g.dist2(F.col("s.c"), F.col("s.r"), F.col("cx"), F.col("cy"))
    dt = g.dist2(F.col("t.c"), F.col("t.r"), F.col("cx"), F.col("cy"))
    j = j.withColumn("which_end", F.when(ds <= dt, "src").otherwise("dst"))
    first = j.groupBy(*keys, "branch_id", "which_end").agg(F.min("junc_id").alias("junc_id"))
    out = ep.select(*keys, "branch_id", "which_end", "bound_node_id").join(first, [*keys, "branch_id", "which_end"], "left")
    gid = F.when(F.col("bound_node_id").isNotNull(), F.concat(F.lit("sym_"), F.col("bound_node_id")))\
        .when(F.col("junc_id").isNotNull(), F.concat(F.lit("junc_"), F.col("junc_id")))
    return out.select(*keys, "branch_id", "which_end", gid.alias("gid"))


def build(branches: DataFrame, ends: DataFrame, gaps: DataFrame | None = None, keys=SHEET) -> DataFrame:
    """One edge per branch with both ends mapped, first branch per pair; short-gap pairs where no edge exists.

    Pairs are stored smaller id first; `route_u` and `route_v` keep the direction of the traced route.
    """
    keys = list(keys)
    end = lambda w, n: ends.filter(F.col("which_end") == w).select(*keys, "branch_id", F.col("gid").alias(n))
    e = branches.join(end("src", "route_u"), [*keys, "branch_id"]).join(end("dst", "route_v"), [*keys, "branch_id"])
    e = e.filter("route_u is not null and route_v is not null and route_u <> route_v")
    e = e.withColumns({"u": F.least("route_u", "route_v"), "v": F.greatest("route_u", "route_v")})
    row = F.struct("branch_id", "length_px", "branch_type", "coords", "route_u", "route_v")
    out = e.groupBy(*keys, "u", "v").agg(F.min_by(row, "branch_id").alias("r")).select(*keys, "u", "v", "r.*", F.lit(False).alias("short_gap"))
    if gaps is None:
        return out
    s = gaps.select(*keys, F.concat(F.lit("sym_"), F.col("a_id")).alias("a"), F.concat(F.lit("sym_"), F.col("b_id")).alias("b")).filter("a <> b")
    s = s.select(*keys, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().join(out.select(*keys, "u", "v"), [*keys, "u", "v"], "left_anti")
    return out.unionByName(s.withColumns({"branch_type": F.lit(-1), "short_gap": F.lit(True)}), allowMissingColumns=True)


def dangling(ends: DataFrame, keys=SHEET) -> DataFrame:
    """Branches per sheet left out of the graph because an end maps to nothing."""
    open_ = ends.groupBy(*keys, "branch_id").agg((F.count("gid") < 2).alias("open"))
    return open_.groupBy(*keys).agg(F.count_if("open").alias("n_dangling"))


# --- contraction by reachability --------------------------------------------------------------------------------

def eliminate(vertices: DataFrame, edges: DataFrame, labels, keys=SHEET, label="node_type", id="node_id") -> DataFrame:
    """Edges left when every vertex with one of the labels is replaced by edges between all its neighbours.

    Removing vertices one by one, in any order, joins exactly the survivors that touch one connected piece of removed
    vertices. So the pieces are found once, and each piece links the survivors around it.
    """
    keys = list(keys)
    gone = vertices.filter(F.col(label).isin(list(labels))).select(*keys, id)
    mark = lambda n, f: gone.select(*keys, F.col(id).alias(n), F.lit(1).alias(f))
    e = staged(edges.select(*keys, "u", "v").join(mark("u", "gu"), [*keys, "u"], "left").join(mark("v", "gv"), [*keys, "v"], "left"))
    inner = e.filter("gu = 1 and gv = 1").select(*keys, "u", "v")
    piece = components(gone, inner, keys, id)
    rim = e.filter("gu = 1 and gv is null").select(*keys, F.col("u").alias(id), F.col("v").alias("s"))\
        .unionByName(e.filter("gv = 1 and gu is null").select(*keys, F.col("v").alias(id), F.col("u").alias("s")))
    rim = staged(rim.join(piece, [*keys, id]).select(*keys, "comp", "s").distinct())
    a, b = rim.withColumnRenamed("s", "u"), rim.withColumnRenamed("s", "v")
    linked = a.join(b, [*keys, "comp"]).filter("u < v").select(*keys, "u", "v")
    kept = ordered(e.filter("gu is null and gv is null").select(*keys, "u", "v"))
    return kept.unionByName(linked).distinct()


# --- crossings of a ground-truth graph --------------------------------------------------------------------------

def crossing_pairs(crossings: DataFrame, edges: DataFrame, places: DataFrame, keys=SHEET, id="node_id") -> DataFrame:
    """Neighbour pairs at every crossing: `passes` for those that run through it, not for those it keeps apart.

    Two neighbours pass; of three the straightest pair; of more, the straightest of the three pairings of the first four.
    """
    return pairs_at(both_ways(edges, keys, "x", "n").distinct(), crossings, places, keys, id)


def pairs_at(near: DataFrame, crossings: DataFrame, places: DataFrame, keys=SHEET, id="node_id") -> DataFrame:
    """The same for given neighbours (x, n), each once."""
    keys = list(keys)
    c = crossings.select(*keys, F.col(id).alias("x"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    nb = near.select(*keys, "x", "n").join(c, [*keys, "x"])
    nb = nb.join(places.select(*keys, F.col(id).alias("n"), F.col("cx").alias("nx"), F.col("cy").alias("ny")), [*keys, "n"])
    # a crossing has a handful of neighbours: what meets in one point of a drawing
    around = nb.groupBy(*keys, "x", "px", "py").agg(F.sort_array(F.collect_list(F.struct("n", "nx", "ny"))).alias("s"))
    d = around.select(*keys, "x", "px", "py", "s", F.size("s").alias("k"))
    i = d.select("*", F.posexplode("s").alias("i", "p")).select("*", F.explode(F.expr("slice(transform(s, (q, j) -> named_struct('j', j, 'q', q)), i + 2, size(s))")).alias("o"))
    i = i.select(*keys, "x", "k", F.col("i"), F.col("o.j").alias("j"), F.col("p.n").alias("a"), F.col("o.q.n").alias("b"),
                 g.opposite_err(F.col("px"), F.col("py"), F.col("p.nx"), F.col("p.ny"), F.col("o.q.nx"), F.col("o.q.ny")).alias("err"))
    # of the first four, (0,j) goes together with the pair of the other two: option j
    four = F.when(F.col("i") == 0, F.col("j")).otherwise(6 - F.col("i") - F.col("j"))
    i = i.withColumn("option", F.when(F.col("k") >= 4, F.when(F.col("j") <= 3, four)).when(F.col("k") == 3, F.col("i") + F.col("j")).otherwise(1))
    total = i.filter("option is not null").groupBy(*keys, "x", "option").agg(F.round(F.sum("err"), 9).alias("total"))
    best = total.groupBy(*keys, "x").agg(F.min(F.struct("total", "option")).alias("m")).select(*keys, "x", F.col("m.option").alias("chosen"))
    out = i.join(best, [*keys, "x"])
    return out.select(*keys, F.col("x").alias("crossing"), "a", "b", F.coalesce(F.col("option") == F.col("chosen"), F.lit(False)).alias("passes"))


def _legs_on(passing: DataFrame, keys: list[str]) -> DataFrame:
    """For the leg from `frm` to a crossing `at`, the leg that goes on: from the crossing (nfrm) to its pair's other end (nat)."""
    one = lambda a, b: passing.select(*keys, F.col(a).alias("frm"), F.col("crossing").alias("at"), F.col("crossing").alias("nfrm"), F.col(b).alias("nat"))
    return one("a", "b").unionByName(one("b", "a"))


def _in_turn(near: DataFrame, on: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """Neighbours (x, n) with `r`, what a crossing finds there in its turn: the line through n is followed past all crossings of
    smaller number, since those are gone by then. `r` is null where such a line ends."""
    jumps = [staged(on.withColumn("top", F.col("at")))]
    while has_rows(jumps[-1]) and 2 ** len(jumps) <= most:
        j = jumps[-1]
        later = j.select(*keys, F.col("frm").alias("nfrm"), F.col("at").alias("nat"), F.col("nfrm").alias("f2"), F.col("nat").alias("a2"), F.col("top").alias("t2"))
        jumps.append(staged(j.join(later, [*keys, "nfrm", "nat"]).select(*keys, "frm", "at", F.col("f2").alias("nfrm"), F.col("a2").alias("nat"), F.greatest("top", "t2").alias("top"))))
    smaller = F.col("is_x") & (F.col("n") < F.col("x"))
    cur = near.filter(smaller).select(*keys, "x", "n", F.col("x").alias("frm"), F.col("n").alias("at"))
    for j in reversed(jumps):
        d, go = cur.join(j, [*keys, "frm", "at"], "left"), F.col("top") < F.col("x")
        cur = staged(d.select(*keys, "x", "n", F.when(go, F.col("nfrm")).otherwise(F.col("frm")).alias("frm"), F.when(go, F.col("nat")).otherwise(F.col("at")).alias("at")))
    ids = near.select(*keys, F.col("x").alias("at"), F.lit(True).alias("still")).distinct()
    ended = cur.join(ids, [*keys, "at"], "left").select(*keys, "x", "n", F.when(~(F.coalesce("still", F.lit(False)) & (F.col("at") < F.col("x"))), F.col("at")).alias("r"))
    return staged(near.filter(~smaller).select(*keys, "x", "n", F.col("n").alias("r")).unionByName(ended))


def _lines_through(on: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (u, v) of vertices joined by a line that runs through crossings of `gone` only, by doubling the stretch known of each leg."""
    on = on.join(gone.withColumnRenamed("x", "at"), [*keys, "at"], "left_semi")
    mark = lambda d, n: d.join(gone.select(*keys, F.col("x").alias(n), F.lit(True).alias("in_" + n)), [*keys, n], "left")
    far = staged(mark(mark(on, "frm"), "nat"))
    while True:
        # what still goes on: the leg it ends with is known to lead further
        further = far.select(*keys, F.col("frm").alias("nfrm"), F.col("at").alias("nat"), F.col("nfrm").alias("f2"), F.col("nat").alias("a2"), F.col("in_nat").alias("i2"))
        if not has_rows(far.filter("in_frm IS NULL AND in_nat").join(further, [*keys, "nfrm", "nat"], "left_semi")):
            ends = far.filter("in_frm IS NULL AND in_nat IS NULL AND frm <> nat")
            return ends.select(*keys, F.least("frm", "nat").alias("u"), F.greatest("frm", "nat").alias("v")).distinct()
        d, more = far.join(further, [*keys, "nfrm", "nat"], "left"), F.col("a2").isNotNull()
        far = staged(d.select(*keys, "frm", "at", F.when(more, F.col("f2")).otherwise(F.col("nfrm")).alias("nfrm"), F.when(more, F.col("a2")).otherwise(F.col("nat")).alias("nat"), "in_frm",
                              F.when(more, F.col("i2")).otherwise(F.col("in_nat")).alias("in_nat")))


def gt_crossings(vertices: DataFrame, edges: DataFrame, keys=SHEET, label="label", id="node_id") -> tuple[DataFrame, DataFrame]:
    """Contracts crossings in id order, joining only pairs that pass through. Returns (edges, pairs with `passes`).

    A crossing pairs the neighbours it has in its turn, when smaller crossings are gone and their lines lead further. All crossings
    are paired at once as they stand, each looks along those lines for its later neighbours, and pairs these again. Where both
    pairings agree for all crossings of a connected piece, or for all below some number, they are what one after the other
    would have given, and these go together. The smallest disagreeing crossing of a piece is right in the next round. So a run of any
    length takes one round with a logarithmic number of joins.
    """
    keys = list(keys)
    places = staged(vertices.select(*keys, id, "cx", "cy"))
    todo = staged(vertices.filter(F.col(label) == "crossing").select(*keys, id, "cx", "cy"))
    live, pairs = staged(ordered(edges.select(*keys, "u", "v")).distinct()), []
    most = todo.count()
    while True:
        ids = todo.select(*keys, F.col(id).alias("x"))
        flag = ids.select(*keys, F.col("x").alias("n"), F.lit(True).alias("is_x"))
        near = staged(both_ways(live, keys, "x", "n").join(ids, [*keys, "x"], "left_semi").join(flag, [*keys, "n"], "left").withColumn("is_x", F.coalesce("is_x", F.lit(False))).distinct())
        if not has_rows(near):
            break
        now = staged(pairs_at(near, todo, places, keys, id))
        on = staged(_legs_on(now.filter("passes"), keys))
        seen = _in_turn(near, on, most, keys)
        # a crossing without smaller ones beside it sees what is there
        open_ = staged(near.filter("is_x AND n < x").select(*keys, "x").distinct())
        changed = seen.join(open_, [*keys, "x"], "left_semi")
        again = staged(pairs_at(changed.filter("r IS NOT NULL").select(*keys, "x", F.col("r").alias("n")).distinct(), todo, places, keys, id))
        r = lambda n: changed.select(*keys, F.col("x").alias("crossing"), F.col("n").alias(n), F.col("r").alias("r" + n))
        kept = now.filter("passes").join(r("a"), [*keys, "crossing", "a"]).join(r("b"), [*keys, "crossing", "b"]).filter("ra IS NOT NULL AND rb IS NOT NULL")
        both = kept.select(*keys, "crossing", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), F.lit(1).alias("w"))\
            .unionByName(again.filter("passes").select(*keys, "crossing", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(-1).alias("w")))
        differs = both.groupBy(*keys, "crossing", "a", "b").agg(F.sum("w").alias("w")).filter("w <> 0").select(*keys, F.col("crossing").alias("x"))
        merged = changed.groupBy(*keys, "x").agg((F.count_distinct("r") < F.count("r")).alias("m"), F.max(F.col("r") == F.col("x")).alias("s")).filter("m OR s").select(*keys, "x")
        bad = staged(differs.unionByName(merged).distinct())
        gone = ids
        if has_rows(bad):
            piece = components(ids, near.filter("is_x").select(*keys, F.col("x").alias("u"), F.col("n").alias("v")), keys, "x")
            low = bad.join(piece, [*keys, "x"]).groupBy(*keys, "comp").agg(F.min("x").alias("low"))
            gone = staged(piece.join(low, [*keys, "comp"], "left").filter("low IS NULL OR x < low").select(*keys, "x"))
        got = now.join(open_.withColumnRenamed("x", "crossing"), [*keys, "crossing"], "left_anti").unionByName(again)
        pairs.append(got.join(gone.withColumnRenamed("x", "crossing"), [*keys, "crossing"], "left_semi"))
        rest = live.join(gone.withColumnRenamed("x", "u"), [*keys, "u"], "left_anti").join(gone.withColumnRenamed("x", "v"), [*keys, "v"], "left_anti")
        live = staged(rest.unionByName(_lines_through(on, gone, keys)).distinct())
        todo = staged(todo.join(gone.withColumnRenamed("x", id), [*keys, id], "left_anti"))
    if not pairs:
        none = live.select(*keys, F.col("u").alias("crossing"), F.col("u").alias("a"), F.col("v").alias("b"), F.lit(False).alias("passes")).filter("false")
        return live, none
    return live, functools.reduce(DataFrame.unionByName, pairs)


def gt_contracted(vertices: DataFrame, edges: DataFrame, keys=SHEET, label="label", id="node_id"):
    """Ground truth as symbol-to-symbol graph: backgrounds dropped, connectors and general vertices bridged, crossings split."""
    keys = list(keys)
    bg = vertices.filter(F.col(label) == "background").select(*keys, id)
    e = edges.select(*keys, "u", "v").join(bg.withColumnRenamed(id, "u"), [*keys, "u"], "left_anti").join(bg.withColumnRenamed(id, "v"), [*keys, "v"], "left_anti")
    v = vertices.filter(F.col(label) != "background")
    bridged = eliminate(v, e, ["connector", "general"], keys, label, id)
    left = v.filter(~F.col(label).isin("connector", "general"))
    contracted, pairs = gt_crossings(left, bridged, keys, label, id)
    return left.filter(F.col(label) != "crossing"), contracted, pairs


# --- veto, paths, flow ------------------------------------------------------------------------------------------

def same_piece(pairs: DataFrame, comp: DataFrame, name: str, keys=SHEET, id="node_id", a="a_id", b="b_id") -> DataFrame:
    """Pairs with a flag telling whether both ends lie in one component (absent vertices never do)."""
    ca = comp.select(*keys, F.col(id).alias(a), F.col("comp").alias("__ca"))
    cb = comp.select(*keys, F.col(id).alias(b), F.col("comp").alias("__cb"))
    d = pairs.join(ca, [*keys, a], "left").join(cb, [*keys, b], "left")
    return d.withColumn(name, F.coalesce(F.col("__ca") == F.col("__cb"), F.lit(False))).drop("__ca", "__cb")


def veto(pairs: DataFrame, raw: tuple[DataFrame, DataFrame], contracted: tuple[DataFrame, DataFrame], keys=SHEET, id="node_id") -> DataFrame:
    """Short-gap pairs with `vetoed`: joined in the raw graph but not once crossings let only straight runs through."""
    d = same_piece(pairs, components(*raw, keys, id), "in_raw", keys, id)
    d = same_piece(d, components(*contracted, keys, id), "in_contracted", keys, id)
    return d.withColumn("vetoed", F.col("in_raw") & ~F.col("in_contracted"))


def shortest_path(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None, keys=SHEET, pair="pair_id") -> DataFrame:
    """Fewest-hops path per (start, goal) pair, smallest ids first among equals. Without max_depth the search ends when nothing new is
    reached; with it, paths of more hops are NULL.

    Distances spread from each goal, once for all pairs that share it, as rows (goal, vertex) per level; a level only has to leave
    out the two before it. A goal stops when all its starts are met. Then the pairs walk back together, from the farthest level
    down, each to its smallest neighbour one level nearer.
    """
    keys = list(keys)
    on, hop = [*keys, pair], staged(both_ways(edges, keys, "at", "to").distinct())
    waiting = staged(pairs.select(*on, "start", "goal"))
    levels, hits = [staged(waiting.select(*keys, "goal", F.col("goal").alias("at")).distinct())], []
    for depth in itertools.count():
        met = levels[-1].select(*keys, "goal", F.col("at").alias("start"))
        hits.append(staged(waiting.join(met, [*keys, "goal", "start"]).select(*on, "goal", F.col("start").alias("at"))))
        waiting = staged(waiting.join(hits[-1].select(*on), on, "left_anti"))
        if depth == max_depth or not has_rows(waiting):
            break
        front = levels[-1].join(waiting.select(*keys, "goal").distinct(), [*keys, "goal"], "left_semi")
        nxt = front.join(hop, [*keys, "at"]).select(*keys, "goal", F.col("to").alias("at")).distinct()
        for old in levels[-2:]:
            nxt = nxt.join(old, [*keys, "goal", "at"], "left_anti")
        levels.append(staged(nxt))
        if not has_rows(levels[-1]):
            break
    steps, at = [hits[0].withColumn("left", F.lit(0))], None
    for left in range(len(hits) - 1, 0, -1):
        here = hits[left] if at is None else at.unionByName(hits[left])
        nearer = levels[left - 1].withColumnRenamed("at", "to")
        at = staged(here.join(hop, [*keys, "at"]).join(nearer, [*keys, "goal", "to"]).groupBy(*on, "goal").agg(F.min("to").alias("at")))
        steps += [hits[left].withColumn("left", F.lit(left)), at.withColumn("left", F.lit(left - 1))]
    walked = functools.reduce(DataFrame.unionByName, steps).groupBy(*on).agg(F.reverse(F.array_sort(F.collect_list(F.struct("left", "at"))))["at"].alias("path"))
    return pairs.join(walked, on, "left").withColumn("hops", F.size("path") - 1)


def culprits(paths: DataFrame, edges: DataFrame, crossings: DataFrame, keys=SHEET, pair="pair_id") -> DataFrame:
    """Crossings on a path entered and left by branches that are not one of their pass-through pairs."""
    keys = list(keys)
    steps = paths.filter("size(path) >= 3").select(*keys, pair, F.explode(F.expr(
        "transform(sequence(1, size(path) - 2), i -> named_struct('before', path[i - 1], 'x', path[i], 'after', path[i + 1]))")).alias("s")).select(*keys, pair, "s.*")
    br = edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("b"), "branch_id").unionByName(edges.select(*keys, F.col("v").alias("a"), F.col("u").alias("b"), "branch_id"))
    into = br.withColumnsRenamed({"a": "before", "b": "x", "branch_id": "bin"})
    out_ = br.withColumnsRenamed({"a": "x", "b": "after", "branch_id": "bout"})
    d = steps.join(crossings.select(*keys, F.col("node_id").alias("x"), "pass_pairs"), [*keys, "x"])
    d = d.join(into, [*keys, "before", "x"], "left").join(out_, [*keys, "x", "after"], "left")
    used = F.struct(F.least("bin", "bout").alias("a"), F.greatest("bin", "bout").alias("b"))
    declared = F.transform("pass_pairs", lambda p: F.struct(F.least(p["a"], p["b"]).alias("a"), F.greatest(p["a"], p["b"]).alias("b")))
    ok = F.coalesce(F.array_contains(declared, used), F.lit(False))
    return d.filter(~ok).select(*keys, pair, F.col("x").alias("crossing")).distinct()


def nearest_edge(arrows: DataFrame, places: DataFrame, edges: DataFrame, max_dist: float = 200.0, keys=SHEET, id="node_id", cell=256) -> DataFrame:
    """Closest edge (straight between vertex centres) within max_dist of each arrow (arrow_id, ax, ay)."""
    keys = list(keys)
    at = lambda n: places.select(*keys, F.col(id).alias(n), F.col("cx").alias(n + "x"), F.col("cy").alias(n + "y"))
    seg = edges.select(*keys, "u", "v").join(at("u"), [*keys, "u"]).join(at("v"), [*keys, "v"])
    m = F.lit(float(max_dist))
    box = [F.least("ux", "vx") - m, F.least("uy", "vy") - m, F.greatest("ux", "vx") + m, F.greatest("uy", "vy") + m]
    d2 = g.segment_dist2(F.col("ax"), F.col("ay"), F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
    hit = points_in_reach(seg, box, arrows, F.col("ax"), F.col("ay"), keys, d2 <= max_dist * max_dist, cell)
    best = hit.groupBy(*keys, "arrow_id").agg(F.min(F.struct(F.round(d2, 9).alias("d2"), "u", "v", "ux", "uy", "vx", "vy")).alias("b"))
    return best.select(*keys, "arrow_id", "b.*")


def flow(assigned: DataFrame, tips: DataFrame | None, keys=SHEET) -> DataFrame:
    """Direction per edge: the end nearer to the arrow tip is downstream, ties to u; the last arrow by id decides."""
    keys = list(keys)
    if tips is None:
        return assigned.groupBy(*keys, "u", "v").agg(n_rows().alias("arrows")).select(*keys, "u", "v", F.lit(True).alias("has_arrow"))
    d = assigned.join(tips.select(*keys, "arrow_id", "tip_x", "tip_y"), [*keys, "arrow_id"])
    du = g.dist2(F.col("tip_x"), F.col("tip_y"), F.col("ux"), F.col("uy"))
    dv = g.dist2(F.col("tip_x"), F.col("tip_y"), F.col("vx"), F.col("vy"))
    to_u = du <= dv
    text = F.concat(F.when(to_u, F.col("v")).otherwise(F.col("u")).cast("string"), F.lit(" -> "), F.when(to_u, F.col("u")).otherwise(F.col("v")).cast("string"))
    return d.groupBy(*keys, "u", "v").agg(F.max_by(text, "arrow_id").alias("flow_direction"))


# --- summaries --------------------------------------------------------------------------------------------------

def inventory(vertices: DataFrame, edges: DataFrame, label="label", edge_label="edge_label") -> DataFrame:
    v = vertices.groupBy(F.lit("node").alias("what"), F.col(label).alias("name")).agg(n_rows().alias("n"))
    return v.unionByName(edges.groupBy(F.lit("edge").alias("what"), F.coalesce(edge_label, F.lit("(none)")).alias("name")).agg(n_rows().alias("n")))


def sample_paths(vertices: DataFrame, edges: DataFrame, dropped, n: int = 3, keys=SHEET, label="label", id="node_id") -> DataFrame:
    """The first n symbol-to-symbol links in hash order of their start, directly or over one dropped vertex."""
    keys = list(keys)
    lab = lambda c: vertices.select(*keys, F.col(id).alias(c), F.col(label).alias(c + "_label"))
    hop = both_ways(edges, keys)
    drop = lambda c: F.col(c + "_label").isin(list(dropped))
    one = hop.join(lab("a"), [*keys, "a"]).join(lab("b"), [*keys, "b"]).filter(~drop("a"))
    direct = one.filter(~drop("b")).select(*keys, F.col("a").alias("src"), F.lit(None).cast("long").alias("via"), F.col("b").alias("dst"))
    two = one.filter(drop("b")).join(both_ways(edges, keys, "b", "c"), [*keys, "b"]).filter("c <> a").join(lab("c"), [*keys, "c"]).filter(~drop("c"))
    both = direct.unionByName(two.select(*keys, F.col("a").alias("src"), F.col("b").cast("long").alias("via"), F.col("c").alias("dst")))
    first = both.groupBy(*keys, "src").agg(F.min(F.struct(F.coalesce("via", F.lit(-1)).alias("k"), "dst", "via")).alias("p"))
    return first.orderBy(F.md5(F.concat_ws("_", *keys, "src")), *keys, "src").limit(n).select(*keys, "src", "p.via", "p.dst")


def traced_share(edges: DataFrame, keys=SHEET) -> DataFrame:
    """Edges drawn along a traced route against those drawn as a straight, inferred chord."""
    t = F.coalesce(F.size("path") >= 2, F.lit(False))
    return edges.groupBy(*keys).agg(n_rows().alias("n_edges"), F.count_if(t).alias("n_traced"), F.avg((~t).cast("double")).alias("inferred_share"))
