"""Overlap joins, one-to-one greedy matching and the triage built on it."""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheetgraph import params as P
from sheetgraph.functions import geometry as g
from sheetgraph.operators.cells import boxes_meeting, filter_points, points_in_reach, prefixed
from sheetgraph.operators.stage import has_rows, staged
from sheetgraph.operators.suppress import SHEET

LARGE = 100_000  # pairs and seats of one group from which it is settled in rounds and not walked by one task

def _box(p: str) -> list[Column]:
    return [F.col(p + n) for n in P.BOX]


def iou_join(left: DataFrame, right: DataFrame, thr: float = 0.0, keys=SHEET, lp="p_", rp="g_", how="iou") -> DataFrame:
    """Overlapping box pairs with `iou` (and `frac`, the share of the left box covered), at or above a threshold."""
    l, r = prefixed(left, lp, keys), prefixed(right, rp, keys)
    measure = g.iou(lp, rp) if how == "iou" else g.ios(lp, rp)
    share = g.inter_area(lp, rp) > 0
    # boxes that share area have a measure above 0; testing it all the same makes the join too long a method for the JVM to compile
    hit = share if thr <= 0 else share & (measure >= thr)
    out = boxes_meeting(l, _box(lp), r, _box(rp), list(keys), hit)
    return out.withColumn(how, measure).withColumn("frac", g.overlap_frac(lp, rp))


def drop_ignored(d: DataFrame, ignore: DataFrame, thr: float = 0.3, keys=SHEET, id="det_id") -> DataFrame:
    """Detections that do not overlap any ignore box by `thr` IoU."""
    hit = iou_join(d.select(*keys, id, *P.BOX), ignore.select(*keys, *P.BOX), thr, keys)
    return d.join(hit.select(*keys, F.col("p_" + id).alias(id)).distinct(), [*keys, id], "left_anti")


def places(rows: DataFrame, keys, id: str) -> DataFrame:
    """Rows with `rep`, the smallest id among those of the same box, `pos`, their place in id order from 1, and `size`, the number of them."""
    box = Window.partitionBy(*keys, *P.BOX)
    same = box.orderBy(id)
    cols = {"rep": F.first(id).over(same), "pos": F.row_number().over(same), "size": F.count(F.lit(1)).over(box)}
    return staged(rows.select(*keys, id, *P.BOX).withColumns(cols))


def one_to_one(pairs: DataFrame, keys, turn: list[Column], want: list[Column], a="a_id", b="b_id", seats: DataFrame | None = None,
               levels: list[float] | None = None, passed: Column | None = None) -> DataFrame:
    """Serial choice: every a, in order of `turn`, takes its most wanted b that is still free.

    With `seats` (see `places`) the b of the pairs are places with several seats: equal boxes are wanted equally by everybody and
    go in id order, so pairs are listed with the place only and an a gets the next seat. With `levels` there is one independent
    choice per level, in column `thr`, and a pair takes part in the first `passed` of them.

    Groups of `keys` up to LARGE pairs and seats are walked in order, many in one sorted partition; larger groups are settled in rounds
    over their pairs, so that no task holds one of them. Both give the serial choice.
    """
    keys, n = list(keys), F.lit(1) if passed is None else passed
    live = pairs.select(*keys, a, b, F.struct(*turn, F.col(a)).alias("turn"), F.struct(*want).alias("want"), n.cast("int").alias("passed"),
                        (F.lit(1) if seats is None else F.col("size")).cast("bigint").alias("size"))
    live = staged(live)
    odd = F.col(a).isNull() | F.col(b).isNull()
    load = live.groupBy(*keys).agg(F.sum(F.col("size") * F.col("passed")).alias("load"), F.max(odd).alias("odd"))
    crowds = staged(load.filter((F.col("load") > LARGE) | F.col("odd")).select(*keys))
    if not has_rows(crowds):
        return _walked(live, keys, a, b, seats, levels)
    done = _walked(live.join(crowds, keys, "left_anti"), keys, a, b, seats, levels)
    big, on = live.join(crowds, keys, "left_semi"), keys
    if levels is not None:
        each = F.array(*[F.lit(float(t)) for t in levels])
        big, on = big.withColumn("thr", F.explode(F.slice(each, F.lit(1), F.col("passed")))), [*keys, "thr"]
        seats = None if seats is None else seats.join(crowds, keys, "left_semi").withColumn("thr", F.explode(each))
    elif seats is not None:
        seats = seats.join(crowds, keys, "left_semi")
    return done.unionByName(_in_rounds(big, on, a, b, seats))


def _walked(live: DataFrame, keys, a: str, b: str, seats: DataFrame | None, levels: list[float] | None) -> DataFrame:
    """The serial choice of many small groups: pairs in order of group, turn and wish, a walk that holds what one group has taken."""
    rows = live.withColumns({"seat": F.lit(1).cast("bigint"), "__id": F.col(b)})
    if seats is not None:
        more = seats.filter("pos > 1").select(*keys, F.col("rep").alias(b), F.col("pos").cast("bigint").alias("seat"), F.col(b).alias("__id"))
        rows = rows.unionByName(live.filter("size > 1").join(more, [*keys, b]))
    rows = rows.select(*keys, a, b, "turn", "want", "passed", "seat", "__id").repartition(*keys).sortWithinPartitions(*keys, "turn", "want", "__id", "seat")
    ordered = rows.select(*keys, a, F.col(b).alias("__b"), "seat", "__id", "passed")
    many = 1 if levels is None else len(levels)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    out = staged(ordered.mapInArrow(functools.partial(_walk, keys=keys, a=a, many=many), ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, a, "__id"]], "level int"])))
    out = out.withColumnRenamed("__id", b)
    if levels is None:
        return out.select(*keys, a, b)
    return out.select(*keys, F.array(*[F.lit(float(t)) for t in levels])[F.col("level")].alias("thr"), a, b)


def _walk(batches, keys, a, many):
    """Pairs of sorted groups one by one; a pair whose sides are both free at a level is a match there."""
    import pyarrow as pa
    group, taken, served = None, None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in [*keys, a, "__b", "seat", "passed"]]
        rows, level = [], []  # matches: row of the batch, level
        for i, (*key, who, place, seat, passed) in enumerate(zip(*cols)):
            if key != group:
                group, taken, served = key, [set() for _ in range(many)], [set() for _ in range(many)]
            for t in range(passed):
                if who not in served[t] and (place, seat) not in taken[t]:
                    served[t].add(who)
                    taken[t].add((place, seat))
                    rows.append(i)
                    level.append(t)
        found = batch.select([*keys, a, "__id"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(level, pa.int32())], names=[*found.schema.names, "level"])


def _in_rounds(pairs: DataFrame, keys, a: str, b: str, seats: DataFrame | None) -> DataFrame:
    """The serial choice as rounds over the candidate pairs.

    A place gives seats, in turn, to all who want it most and come before anybody who
    has it on their list but wants another more. Who wants two places equally may change with the next seat, so they only
    get the first of a round, and nobody is seated after them. The earliest open a of any neighbourhood is always seated, so each round settles all
    independent neighbourhoods at once and the outcome equals taking turns one by one. Copies on one spot cost a row each.
    """
    ka, kb = [*keys, a], [*keys, b]
    live = pairs.select(*keys, a, b, "turn", "want", F.col(b).alias("next"))
    if seats is None:
        later, live = None, live.withColumns({"used": F.lit(0).cast("bigint"), "left": F.lit(1).cast("bigint")})
    else:
        size = seats.groupBy(*keys, F.col("rep").alias(b)).agg(F.count(F.lit(1)).alias("left"))
        live = live.join(size, kb).withColumn("used", F.lit(0).cast("bigint"))
        later = staged(seats.filter("pos > 1").select(*keys, F.col("rep").alias(b), F.col("pos").cast("bigint").alias("p"), F.col(b).alias("id")))
    live, done = staged(live.select(*keys, a, b, "turn", "want", "next", "used", "left")), []
    best = Window.partitionBy(*ka).orderBy("want", "next", b)
    while has_rows(live):
        d = live.withColumns({"place": F.row_number().over(best), "second": F.lead("want").over(best)})
        d = staged(d.withColumn("tied", F.coalesce((F.col("place") == 1) & (F.col("second") == F.col("want")), F.lit(False))).drop("second"))
        bound = d.filter("place > 1 OR tied").groupBy(*kb).agg(F.min("turn").alias("bound"))
        first = d.filter("place = 1").join(bound, kb, "left").filter(F.col("bound").isNull() | (F.col("turn") < F.col("bound")) | (F.col("tied") & (F.col("turn") == F.col("bound"))))
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*kb).orderBy("turn"))).filter("n <= left AND (n = 1 OR NOT tied)")
        final = staged(first.select(*keys, a, b, (F.col("used") + F.col("n")).alias("seat")))
        done.append(final)
        taken = final.groupBy(*kb).agg(F.max("seat").alias("to"))
        live = live.join(final.select(*ka), ka, "left_anti").join(taken, kb, "left")
        live = live.withColumns({"left": F.col("left") - F.coalesce(F.col("to") - F.col("used"), F.lit(0)), "moved": F.col("to").isNotNull(), "used": F.coalesce("to", "used")}).filter("left > 0").drop("to")
        if later is not None:
            # the next seat of places that gave some away
            live = live.withColumn("p", F.when(F.col("moved"), F.col("used") + 1)).join(later, [*kb, "p"], "left").withColumn("next", F.coalesce("id", "next"))
        live = staged(live.select(*keys, a, b, "turn", "want", "next", "used", "left"))
    if not done:
        return live.select(*keys, a, b)
    out = reduce(DataFrame.unionByName, done)
    if seats is None:
        return out.select(*keys, a, b)
    seat = seats.select(*keys, F.col("rep").alias("__rep"), F.col("pos").cast("bigint").alias("seat"), F.col(b).alias("__id"))
    return out.withColumnRenamed(b, "__rep").join(seat, [*keys, "__rep", "seat"]).select(*keys, a, F.col("__id").alias(b))


def greedy_iou(d: DataFrame, gt: DataFrame, thr=0.5, keys=SHEET, cls="cls") -> DataFrame:
    """Most confident first, each detection claims the best overlapping free ground truth of its class at IoU >= thr.

    `thr` may be a list; the result then has one independent matching per threshold in column `thr`.
    """
    many = sorted(thr) if isinstance(thr, (list, tuple)) else [float(thr)]
    on = [*keys, cls]
    seats = places(gt, on, "gt_id")
    pairs = iou_join(d.select(*on, "det_id", "conf", *P.BOX), seats.filter("pos = 1").select(*on, "gt_id", "size", *P.BOX), min(many), on)
    pairs = pairs.select(*on, F.col("p_det_id").alias("det_id"), F.col("p_conf").alias("conf"), F.col("g_gt_id").alias("gt_id"), F.col("g_size").alias("size"), "iou")
    # the thresholds rise, so a pair takes part in the first ones up to its own overlap
    passed = sum([(F.col("iou") >= float(t)).cast("int") for t in many], F.lit(0))
    return one_to_one(pairs, on, [-F.col("conf")], [-F.col("iou")], "det_id", "gt_id", seats, many, passed)


def center_candidates(d: DataFrame, gt: DataFrame, frac: float, keys, strict: bool, floor: str, seats: str | None = None) -> DataFrame:
    """Pairs of detection and ground truth whose centres are within frac*sqrt(w*h) of the ground-truth box.

    floor: "side" raises each side to 1 px, "area" raises the area to 1, "none" takes sizes as they are. seats: the side ("gt" or "det") whose
    column `size` the pairs keep.
    """
    w, h = F.abs(g.width()), F.abs(g.height())
    size = {"side": F.greatest(w, F.lit(1.0)) * F.greatest(h, F.lit(1.0)), "area": F.greatest(w * h, F.lit(1.0)), "none": w * h}[floor]
    r2 = F.lit(frac * frac) * size
    t = gt.select(*keys, "gt_id", g.cx().alias("gx"), g.cy().alias("gy"), r2.alias("r2"), F.sqrt(r2).alias("r"), *(["size"] if seats == "gt" else []))
    p = d.select(*keys, "det_id", "conf", g.cx().alias("px"), g.cy().alias("py"), *(["size"] if seats == "det" else []))
    d2 = g.dist2(F.col("gx"), F.col("gy"), F.col("px"), F.col("py"))
    near = (d2 < F.col("r2")) if strict else (d2 <= F.col("r2"))
    r = F.col("r") + 1e-6  # cells must cover points exactly on the circle
    out = points_in_reach(t, [F.col("gx") - r, F.col("gy") - r, F.col("gx") + r, F.col("gy") + r], p, F.col("px"), F.col("py"),
                          list(keys), near)
    return out.select(*keys, "det_id", "conf", "gt_id", d2.alias("d2"), *(["size"] if seats else []))


def greedy_center(d: DataFrame, gt: DataFrame, frac: float = 0.5, major: str = "pred", strict: bool = False,
                  floor: str = "none", keys=("sheet_id", "label")) -> DataFrame:
    """One-to-one nearest-centre matching. Predictions take turns by confidence, or ground truth by id (`major="gt"`)."""
    keys = list(keys)
    if major == "pred":
        seats = places(gt, keys, "gt_id")
        pairs = center_candidates(d, seats.filter("pos = 1"), frac, keys, strict, floor, "gt")
        return one_to_one(pairs, keys, [-F.col("conf")], [F.col("d2")], "det_id", "gt_id", seats)
    seats = places(d, keys, "det_id")
    pairs = center_candidates(seats.filter("pos = 1").withColumn("conf", F.lit(None).cast("double")), gt, frac, keys, strict, floor, "det")
    return one_to_one(pairs, keys, [], [F.col("d2")], "gt_id", "det_id", seats)


def hit_counts(d: DataFrame, gt: DataFrame, frac: float = 0.5, keys=("sheet_id", "label")) -> DataFrame:
    """Number of detections in reach of every ground truth, before any one-to-one choice.

    Ground truth and hits are added up together, without a sort or a join of either; a truth listed several times comes as often.
    """
    ids = [*keys, "gt_id"]
    rows = lambda df, times, hit: df.select(*ids, F.lit(times).cast("bigint").alias("times"), F.lit(hit).cast("bigint").alias("hits"))
    near = center_candidates(d, gt, frac, keys, True, "side").filter("gt_id is not null")
    n = rows(gt, 1, 0).unionByName(rows(near, 0, 1)).groupBy(*ids).agg(F.sum("times").alias("times"), F.sum("hits").alias("hits"))
    return n.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select(*ids, "hits")


def unmatched(d: DataFrame, gt: DataFrame, frac: float = 0.5, keys=SHEET) -> DataFrame:
    """Detections outside every scored class, or with no ground truth of their class in reach."""
    sup = d.withColumn("super", g.supercategory())
    scored = gt.withColumn("super", P.lookup(P.SCORED_LABELS, F.col("label"))).filter("super is not null")
    on = [*keys, "super"]
    near = center_candidates(sup.filter("super is not null"), scored, frac, on, True, "side").select(*on, "det_id").distinct()
    return sup.join(near, [*on, "det_id"], "left_anti")


def nearest(probes: DataFrame, nodes: DataFrame, radius: float, keys=SHEET, probe="probe_id", node="node_id") -> DataFrame:
    """Nearest node centre strictly within a radius of each probe point (x, y); NULL node when there is none."""
    p = probes.select(*keys, probe, F.col("x").alias("qx"), F.col("y").alias("qy"))
    n = nodes.select(*keys, node, g.cx().alias("nx"), g.cy().alias("ny"))
    r = F.lit(float(radius))
    d2 = g.dist2(F.col("qx"), F.col("qy"), F.col("nx"), F.col("ny"))
    reach = [F.col("qx") - r, F.col("qy") - r, F.col("qx") + r, F.col("qy") + r]
    hit = points_in_reach(p, reach, n, F.col("nx"), F.col("ny"), list(keys), d2 < radius * radius)
    best = hit.groupBy(*keys, probe).agg(F.min(F.struct(d2.alias("d2"), F.col(node).alias("n"))).alias("b"))
    best = best.select(*keys, probe, F.col("b.n").alias(node), F.col("b.d2").alias("d2"))
    return probes.join(best, [*keys, probe], "left").withColumn("found", F.when(F.col(node).isNotNull(), "FOUND").otherwise("NOT_FOUND"))


def triage(d: DataFrame, gt: DataFrame, matches: DataFrame, frac: float = 0.5, near_frac: float = 1.0,
           keys=("sheet_id", "label")) -> DataFrame:
    """Why an unmatched detection has no partner: it doubles a matched one, its partner was free, or nothing is near."""
    left = d.join(matches.select(*keys, "det_id"), [*keys, "det_id"], "left_anti")
    # of equal boxes the smallest id is the nearest
    spots = gt.groupBy(*keys, *P.BOX).agg(F.min("gt_id").alias("gt_id"))
    cand = center_candidates(left, spots, frac, keys, False, "area")
    taken = matches.select(*keys, "gt_id").withColumn("taken", F.lit(1))
    best = cand.groupBy(*keys, "det_id").agg(F.min(F.struct("d2", "gt_id")).alias("b"))
    best = best.select(*keys, "det_id", F.col("b.gt_id").alias("gt_id")).join(taken, [*keys, "gt_id"], "left")
    out = left.select(*keys, "det_id").join(best, [*keys, "det_id"], "left")
    return out.withColumn("verdict", F.when(F.col("gt_id").isNull(), "NO_NEARBY_GT").when(F.col("taken") == 1, "DUPLICATE")
                          .otherwise("WOULD_MATCH")).drop("taken")


def failure_buckets(d: DataFrame, gt: DataFrame, ignore: DataFrame, keys=SHEET) -> DataFrame:
    """TP, or why a valve or arrow was missed: A nothing near, B box too loose, C wrong class, D ambiguous valve-like class.

    A hit is any detection of the right class at IoU >= 0.5; otherwise the best overlap of any class decides. Ground truth
    overlapping an ignore box by half is left out.
    """
    scored = gt.filter(F.col("label").isin("valve", "arrow")).withColumn("super", P.lookup(P.SCORED_LABELS, F.col("label")))
    ids = [*keys, "gt_id"]
    # detections and ignore boxes meet the ground truth in one join
    cand = d.select(*keys, "det_id", "cls_id", g.supercategory().alias("super"), *P.BOX, F.lit(False).alias("skip"))
    cand = cand.unionByName(ignore.select(*keys, *P.BOX, F.lit(True).alias("skip")), allowMissingColumns=True)
    pairs = iou_join(cand, scored.select(*ids, "super", *P.BOX), 0.0, keys)
    best = pairs.groupBy(*keys, F.col("g_gt_id").alias("gt_id")).agg(
        F.max(F.when(F.col("p_super") == F.col("g_super"), F.col("iou"))).alias("own_iou"),
        F.max(F.when(~F.col("p_skip"), F.struct("iou", "p_det_id", "p_cls_id", "p_super"))).alias("b"),
        F.max(F.col("p_skip") & (F.col("iou") >= 0.5)).alias("skip"))
    out = scored.select(*ids, "label", "super").join(best, ids, "left").filter(~F.coalesce("skip", F.lit(False)))
    any_iou = F.coalesce(F.col("b.iou"), F.lit(0.0))
    bucket = (
        F.when(F.coalesce("own_iou", F.lit(0.0)) >= 0.5, "TP").when(any_iou < 0.1, "A").when(any_iou < 0.5, "B")
        .when((F.col("label") == "valve") & F.col("b.p_cls_id").isin(P.AMBIGUOUS_VALVE_CLASSES), "D").otherwise("C")
    )
    return out.select(*ids, "label", "super", bucket.alias("bucket"), any_iou.alias("best_iou"),
                      F.col("b.p_det_id").alias("best_det"), F.col("b.p_cls_id").alias("best_cls"))


def top_wrong(buckets: DataFrame, n: int = 8) -> DataFrame:
    """Most common predicted classes among wrong-class misses, per true label."""
    c = buckets.filter("bucket = 'C'").groupBy("label", "best_cls").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), "best_cls")  # at most one row per class
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def suppress_in_background(d: DataFrame, background: DataFrame, img_w: float, img_h: float, margin: float = 0.04,
                           keys=SHEET) -> DataFrame:
    """Drop detections centred in a background box; sheets without one drop what is centred in the border margin.

    The two kinds of sheet are told apart by a semi and an anti join on the distinct sheet keys of the backgrounds.
    """
    keys = list(keys)
    has_bg = background.select(*keys).distinct()
    x, y = g.cx(), g.cy()
    inside = (x >= img_w * margin) & (y >= img_h * margin) & (x <= img_w * (1 - margin)) & (y <= img_h * (1 - margin))
    plain = d.join(has_bg, keys, "left_anti").filter(inside)
    bg = prefixed(background.select(*keys, *P.BOX), "bg_", keys)
    hit = (x >= F.col("bg_x1")) & (x <= F.col("bg_x2")) & (y >= F.col("bg_y1")) & (y <= F.col("bg_y2"))
    boxed = filter_points(d.join(has_bg, keys, "left_semi"), x, y, bg, _box("bg_"), keys, hit)
    return plain.unionByName(boxed)
