"""Duplicate suppression, node numbering and duplicate guards.

Greedy suppression keeps boxes from the most confident down and drops every later box too close to a kept one. Written as a
fold it needs a whole group in one task. It is computed here as a fixed point over the conflict graph instead: a box with no
better box in reach is kept, whatever a kept box reaches is dropped, repeat. Both give the same kept set for every input.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from sheetgraph.functions import geometry as g
from sheetgraph.operators.cells import GX, GY, at_cell, points_in_reach
from sheetgraph.operators.ranking import numbered
from sheetgraph.operators.stage import has_rows, staged

SHEET = ("sheet_id",)
CROWDED = 400  # boxes of one group in one cell from which pairs are not listed but cells are thinned first

LARGE = 100_000  # conflicts of one group from which it is settled in rounds and not walked by one task


def survivors(conflicts: DataFrame, nodes: DataFrame, ids: list[str], group: list[str] | None = None) -> DataFrame:
    """Nodes that stay when conflicts (w_* beats l_*) are settled from the best node down.

    `conflicts` has columns w_<id> and l_<id>; every winner precedes its losers in one total order. Where it also has that order as `l_rank`, and
    `group` names ids that never differ within a conflict, groups of up to LARGE conflicts are walked in order, many in one sorted
    partition, and only larger ones are settled in rounds.
    """
    if group is None:
        dropped = _beaten_in_rounds(conflicts, ids)
        return nodes if dropped is None else nodes.join(dropped, ids, "left_anti")
    live, at = staged(conflicts), ["w_" + k for k in group]
    crowds = staged(live.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select(*at))
    if not has_rows(crowds):
        return nodes.join(_beaten_in_order(live, ids, group), ids, "left_anti")
    dropped = _beaten_in_order(live.join(crowds, at, "left_anti"), ids, group)
    return nodes.join(dropped.unionByName(_beaten_in_rounds(live.join(crowds, at, "left_semi"), ids)), ids, "left_anti")


def _beaten_in_order(conflicts: DataFrame, ids: list[str], group: list[str]) -> DataFrame:
    """Beaten nodes of many small groups: conflicts in order of the loser, a walk that holds what is beaten in one group."""
    at, w, l = ["w_" + k for k in group], ["w_" + i for i in ids], ["l_" + i for i in ids]
    rows = conflicts.repartition(*at).sortWithinPartitions(*at, "l_rank", *l).select(*w, *l)
    schema = ", ".join(f"`{f.name[2:]}` {f.dataType.simpleString()}" for f in rows.schema if f.name.startswith("l_"))
    return staged(rows.mapInArrow(functools.partial(_walk, ids=ids, group=group), schema))


def _walk(batches, ids, group):
    """Each loser is beaten as soon as one of its winners is not; winners come before their losers, so theirs is decided."""
    import pyarrow as pa
    now, beaten = None, None
    for batch in batches:
        side = lambda p, names: zip(*[batch.column(p + i).to_pylist() for i in names])
        rows = []
        for n, (key, w, l) in enumerate(zip(side("w_", group), side("w_", ids), side("l_", ids))):
            if key != now:
                now, beaten = key, set()
            if l not in beaten and w not in beaten:
                beaten.add(l)
                rows.append(n)
        found = batch.select(["l_" + i for i in ids]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(found.columns, names=ids)


def _beaten_in_rounds(conflicts: DataFrame, ids: list[str]) -> DataFrame | None:
    """Beaten nodes, one round of joins for all nodes whose winners are settled; None without a conflict."""
    w, l = ["w_" + i for i in ids], ["l_" + i for i in ids]
    as_ids = lambda df, cols, p="": df.select(*[F.col(k).alias(p + i) for k, i in zip(cols, ids)])
    live, dropped = staged(conflicts.select(*w, *l)), None
    while has_rows(live):
        beaten = as_ids(live, l, "w_").distinct().withColumn("beaten", F.lit(1))
        marked = live.join(beaten, w, "left")
        gone = as_ids(marked.filter("beaten is null"), l).distinct()
        gone = staged(gone)
        dropped = gone if dropped is None else dropped.unionByName(gone)
        open_pairs = marked.filter("beaten is not null").drop("beaten")
        open_pairs = open_pairs.join(gone.withColumnsRenamed({i: "w_" + i for i in ids}), w, "left_anti")
        live = staged(open_pairs.join(gone.withColumnsRenamed({i: "l_" + i for i in ids}), l, "left_anti"))
    return dropped


def _ranked_boxes(d: DataFrame, keys, frac: float, group: Column) -> DataFrame:
    r2 = F.lit(frac * frac) * F.greatest(g.width() * g.height(), F.lit(1.0))
    return d.select(*keys, group.alias("grp"), "det_id", F.struct(-F.col("conf"), "det_id").alias("rank"),
                    g.cx().alias("px"), g.cy().alias("py"), r2.alias("r2"), F.sqrt(r2).alias("r"))


def _reach(p: str) -> list[Column]:
    x, y, r = F.col(p + "px"), F.col(p + "py"), F.col(p + "r")
    return [x - r, y - r, x + r, y + r]


def _beats() -> Column:
    near = g.dist2(F.col("w_px"), F.col("w_py"), F.col("l_px"), F.col("l_py")) < F.col("w_r2")
    return near & (F.col("w_rank") < F.col("l_rank"))


def _side(d: DataFrame, p: str, shared) -> DataFrame:
    return d.withColumnsRenamed({n: p + n for n in d.columns if n not in shared})


def _thin_crowds(reps: DataFrame, keys, crowded: int) -> tuple[DataFrame, DataFrame | None]:
    """Settle boxes of crowded groups cell by cell until no cell is crowded; linear work per round, no pairs.

    The cell side is the largest reach in the group, so anything that could beat a box lies in the 3x3 cells around it: the
    best box of such a neighbourhood is kept and everything it reaches is dropped.
    """
    shared = [*keys, "grp"]
    cell_keys = [*shared, GX, GY]
    crowds = reps.groupBy(*shared, F.floor(F.col("px") / 128), F.floor(F.col("py") / 128)).count()\
        .filter(F.col("count") > crowded).select(*shared).distinct()
    crowds = staged(crowds)
    if not has_rows(crowds):
        return reps, None
    sized = reps.join(crowds, shared, "left_semi")
    side = sized.groupBy(*shared).agg(F.ceil(F.greatest(F.max("r"), F.lit(1.0))).alias("side"))
    sized = sized.join(side, shared)
    live = staged(sized.withColumns({GX: F.floor(F.col("px") / F.col("side")), GY: F.floor(F.col("py") / F.col("side"))}))
    kept = None
    around = lambda d: d.withColumn(GX, F.explode(F.sequence(F.col(GX) - 1, F.col(GX) + 1)))\
        .withColumn(GY, F.explode(F.sequence(F.col(GY) - 1, F.col(GY) + 1)))
    while has_rows(live.groupBy(*cell_keys).count().filter(F.col("count") > crowded)):
        row = F.struct("rank", "det_id", "px", "py", "r2", "r")
        best = live.groupBy(*cell_keys).agg(F.min(row).alias("best"))
        rivals = around(best).groupBy(*cell_keys).agg(F.min("best.rank").alias("rival"))
        tops = staged(best.join(rivals, cell_keys).filter(F.col("best.rank") == F.col("rival")).select(*cell_keys, "best.*"))
        kept = tops.drop(GX, GY) if kept is None else kept.unionByName(tops.drop(GX, GY))
        reached = around(_side(tops, "w_", cell_keys)).withColumnsRenamed({k: "k_" + k for k in cell_keys})
        same = [F.col(k).eqNullSafe(F.col("k_" + k)) for k in cell_keys]
        hit = g.dist2(F.col("w_px"), F.col("w_py"), F.col("px"), F.col("py")) < F.col("w_r2")
        for s in same:
            hit = s & hit
        live = staged(live.join(reached, hit, "left_anti"))
    rest = live.drop("side", GX, GY)
    # what is left beside a kept box was tested against it already, so kept boxes leave the game
    return reps.join(crowds, shared, "left_anti").unionByName(rest.select(*reps.columns)), kept


def centroid(d: DataFrame, frac: float = 0.5, group: Column | None = None, keys=SHEET, crowded: int = CROWDED) -> DataFrame:
    """Kept boxes: per group, most confident first, later centres closer than frac*sqrt(w*h) of a kept box are dropped."""
    group = g.family() if group is None else group
    keys = list(keys)
    boxes = _ranked_boxes(d, keys, frac, group)
    # of boxes with the same centre only the best can stay, so copies are folded before anything is paired
    top = F.min(F.struct("rank", "det_id", "r2", "r")).alias("top")
    reps = boxes.groupBy(*keys, "grp", "px", "py").agg(top)\
        .select(*keys, "grp", "px", "py", "top.rank", "top.det_id", "top.r2", "top.r")
    reps = staged(reps)
    open_boxes, settled = _thin_crowds(reps, keys, crowded)
    shared = [*keys, "grp"]
    pairs = points_in_reach(_side(open_boxes, "w_", shared), _reach("w_"), _side(open_boxes, "l_", shared),
                            F.col("l_px"), F.col("l_py"), shared, _beats())
    pairs = pairs.select(*[F.col(k).alias(p + k) for k in keys for p in ("w_", "l_")], "w_det_id", "l_det_id", "l_rank")
    ids = [*keys, "det_id"]
    kept = survivors(pairs, open_boxes.select(*ids), ids, keys)
    if settled is not None:
        kept = kept.unionByName(settled.select(*ids))
    return d.join(kept, ids, "left_semi")


def annotate(d: DataFrame, kept: DataFrame, frac: float = 0.5, group: Column | None = None, keys=SHEET) -> DataFrame:
    """Kept boxes with `subtype_conflict` and the class names they suppressed under another class.

    A dropped box is charged to the best kept box that reaches it, which is the one that dropped it.
    """
    group = g.family() if group is None else group
    keys = list(keys)
    shared, ids = [*keys, "grp"], [*keys, "det_id"]
    k = _ranked_boxes(kept, keys, frac, group)
    extra = d.select(*ids, "cls_id")
    lost = _ranked_boxes(d.join(kept.select(*ids), ids, "left_anti"), keys, frac, group)
    hits = points_in_reach(_side(k, "w_", shared), _reach("w_"), _side(lost, "l_", shared), F.col("l_px"), F.col("l_py"),
                           shared, _beats())
    owner = hits.groupBy(*keys, "l_det_id").agg(F.min(F.struct("w_rank", "w_det_id")).alias("o"), F.first("l_rank").alias("l_rank"))
    owner = owner.select(*keys, "l_det_id", "l_rank", F.col("o.w_det_id").alias("det_id"))
    owner = owner.join(extra.withColumnsRenamed({"det_id": "l_det_id", "cls_id": "l_cls"}), [*keys, "l_det_id"])\
        .join(extra, ids).filter("l_cls <> cls_id")
    from sheetgraph.params import CLASS_NAMES, lookup
    named = owner.withColumn("lost_name", lookup(CLASS_NAMES, F.col("l_cls"), F.lit("unknown")))
    # names and their counts, not one entry per copy, so that a pile of copies stays one map entry
    per = named.groupBy(*ids, "lost_name").agg(F.count(F.lit(1)).alias("times"), F.min("l_rank").alias("first"))
    per = per.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("first", "lost_name", "times"))).alias("l"))\
        .select(*ids, F.expr("transform(l, x -> named_struct('cls_name', x.lost_name, 'times', x.times))").alias("suppressed_subtypes"))
    return kept.join(per, ids, "left").withColumn("subtype_conflict", F.col("suppressed_subtypes").isNotNull())


def node_set(kept: DataFrame, keys=SHEET, start: int = 0) -> DataFrame:
    """Typed nodes with a sequential id per sheet in order of group, confidence and box id."""
    fam = g.family()
    order = [F.col("grp"), F.desc("conf"), F.col("det_id")]
    d = kept.withColumn("grp", fam)
    bucket = F.struct("grp", F.floor(F.col("conf") * -1024).alias("c"))
    d = numbered(d, list(keys), bucket, order, "node_id")
    return d.withColumn("node_id", F.col("node_id") + start).withColumn("node_type", g.node_type()).drop("grp")


def duplicates(nodes: DataFrame, frac: float = 0.5, keys=SHEET, fail: bool = False) -> DataFrame:
    """Pairs of valves, or of instruments, closer than the reach of the earlier node. Expected empty after suppression."""
    scored = nodes.filter(F.col("node_type").isin("valve", "instrument"))
    r2 = F.lit(frac * frac) * F.greatest(g.width() * g.height(), F.lit(1.0))
    n = scored.select(*keys, "node_type", "node_id", g.cx().alias("px"), g.cy().alias("py"), r2.alias("r2"), F.sqrt(r2).alias("r"))
    shared = [*keys, "node_type"]
    near = g.dist2(F.col("a_px"), F.col("a_py"), F.col("b_px"), F.col("b_py")) < F.col("a_r2")
    out = points_in_reach(_side(n, "a_", shared), _reach("a_"), _side(n, "b_", shared), F.col("b_px"), F.col("b_py"), shared,
                          near & (F.col("a_node_id") < F.col("b_node_id")))
    out = out.select(*shared, "a_node_id", "b_node_id")
    if fail:
        out = out.filter(F.raise_error(F.concat(F.lit("duplicate nodes "), F.col("a_node_id"), F.lit(" and "), F.col("b_node_id"))).isNull())
    return out


def close_pairs(nodes: DataFrame, frac: float = 0.5, keys=SHEET) -> DataFrame:
    """Pairs of different classes closer than the larger of their two reaches, lower node id first."""
    r2 = F.lit(frac * frac) * F.greatest(g.width() * g.height(), F.lit(1.0))
    n = nodes.select(*keys, "node_id", "cls_id", "node_type", g.cx().alias("px"), g.cy().alias("py"), r2.alias("r2"), F.sqrt(r2).alias("r"))
    near = g.dist2(F.col("a_px"), F.col("a_py"), F.col("b_px"), F.col("b_py")) < F.col("a_r2")
    # found from the side with the larger reach; equal reaches are found from the lower id only
    first = (F.col("a_r2") > F.col("b_r2")) | ((F.col("a_r2") == F.col("b_r2")) & (F.col("a_node_id") < F.col("b_node_id")))
    out = points_in_reach(_side(n, "a_", keys), _reach("a_"), _side(n, "b_", keys), F.col("b_px"), F.col("b_py"), list(keys),
                          near & first & (F.col("a_cls_id") != F.col("b_cls_id")))
    swap = F.col("a_node_id") > F.col("b_node_id")
    pick = lambda n: [F.when(swap, F.col("b_" + n)).otherwise(F.col("a_" + n)).alias("a_" + n),
                      F.when(swap, F.col("a_" + n)).otherwise(F.col("b_" + n)).alias("b_" + n)]
    return out.select(*keys, *pick("node_id"), *pick("cls_id"), *pick("node_type"))


def close_class_counts(nodes: DataFrame, frac: float = 0.5, keys=SHEET) -> DataFrame:
    """Counts of close pairs as `close_pair_counts` has them, without listing the pairs of copies: boxes of one class, centre and reach are
    one spot with a number, and a pair of spots counts the product."""
    keys = list(keys)
    r2 = F.lit(frac * frac) * F.greatest(g.width() * g.height(), F.lit(1.0))
    at = nodes.select(*keys, "cls_id", "node_type", g.cx().alias("px"), g.cy().alias("py"), r2.alias("r2"), F.sqrt(r2).alias("r"))
    spots = staged(at.groupBy(*at.columns).agg(F.count(F.lit(1)).alias("times")))
    near = g.dist2(F.col("a_px"), F.col("a_py"), F.col("b_px"), F.col("b_py")) < F.col("a_r2")
    order = lambda p: F.struct(*[F.col(p + c) for c in ("r2", "px", "py", "cls_id", "node_type")])
    # found from the side with the larger reach, once where both are equal
    first = (F.col("a_r2") > F.col("b_r2")) | ((F.col("a_r2") == F.col("b_r2")) & (order("a_") < order("b_")))
    pairs = points_in_reach(_side(spots, "a_", keys), _reach("a_"), _side(spots, "b_", keys), F.col("b_px"), F.col("b_py"), keys, near & first & (F.col("a_cls_id") != F.col("b_cls_id")))
    return _counts(pairs.withColumn("times", F.col("a_times") * F.col("b_times")))


def close_pair_counts(pairs: DataFrame) -> DataFrame:
    """Counts per unordered class pair with subtotals per family and a grand total."""
    return _counts(pairs.withColumn("times", F.lit(1)))


def _counts(pairs: DataFrame) -> DataFrame:
    both = lambda t: (F.col("a_node_type") == t) & (F.col("b_node_type") == t)
    fam = F.when(both("instrument"), "instrument").when(both("valve"), "valve").otherwise("other")
    d = pairs.select(fam.alias("family"), F.least("a_cls_id", "b_cls_id").alias("cls_lo"), F.greatest("a_cls_id", "b_cls_id").alias("cls_hi"), "times")
    d = d.groupBy("family", "cls_lo", "cls_hi").agg(F.sum("times").alias("n"))
    return d.rollup("family", F.struct("cls_lo", "cls_hi").alias("pair")).agg(F.sum("n").alias("n"))\
        .select("family", "pair.cls_lo", "pair.cls_hi", "n")
