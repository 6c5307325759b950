"""Distributed operators against plain sequential code on small random sheets."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetgraph.operators import contract, evaluate, graph, ink, match, metrics, ranking, suppress, tiling
from sheetgraph.operators.components import components


def random_boxes(rng, n, sheet=1, size=(10, 60), page=300):
    out = []
    for i in range(n):
        x, y, w, h = rng.randrange(page), rng.randrange(page), rng.randrange(*size), rng.randrange(*size)
        out.append((sheet, f"d{i:04d}", rng.choice([0, 1, 2, 25, 26, 23, 29]), round(rng.random(), 2), float(x), float(y), float(x + w), float(y + h)))
    return out


COLS = "sheet_id long, det_id string, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def fam(c):
    return "valve" if c <= 13 else "instrument" if c in (25, 26, 27, 28, 30) else str(c)


def walk_suppression(rows, frac=0.5):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        cx, cy = (r[4] + r[6]) / 2, (r[5] + r[7]) / 2
        if not any(k[0] == r[0] and fam(k[2]) == fam(r[2]) and math.hypot((k[4] + k[6]) / 2 - cx, (k[5] + k[7]) / 2 - cy) < frac * math.sqrt(max((k[6] - k[4]) * (k[7] - k[5]), 1)) for k in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


@pytest.mark.parametrize("crowded", [400, 3])
def test_suppression_equals_the_walk(spark, crowded):
    rng = random.Random(5)
    # one sheet holds most rows, many of them exact copies
    rows = random_boxes(rng, 150) + [(2, *r[1:]) for r in random_boxes(rng, 20)]
    rows += [(1, f"c{i:03d}", 0, 0.4 + i / 1000, 50.0, 50.0, 90.0, 90.0) for i in range(60)]
    d = spark.createDataFrame(rows, COLS)
    kept = suppress.centroid(d, crowded=crowded)
    assert {(r.sheet_id, r.det_id) for r in kept.select("sheet_id", "det_id").collect()} == walk_suppression(rows)
    if crowded == 400:
        nodes = suppress.node_set(kept)
        assert suppress.duplicates(nodes).isEmpty()
        ids = sorted(r.node_id for r in nodes.filter("sheet_id = 1").collect())
        assert ids == list(range(len(ids)))


def test_matching_takes_turns(spark):
    rng = random.Random(9)
    pairs = [(1, f"a{a}", f"b{b}", rng.randrange(5), rng.randrange(4)) for a in range(25) for b in range(15) if rng.random() < 0.4]
    turn = {}
    pairs = [(k, a, b, turn.setdefault(a, t), w) for k, a, b, t, w in pairs]
    got = {(r.a_id, r.b_id) for r in match.one_to_one(spark.createDataFrame(pairs, "sheet_id long, a_id string, b_id string, t int, w int"), ["sheet_id"], [F.col("t")], [F.col("w")]).collect()}
    used, want = set(), set()
    for a in sorted(turn, key=lambda a: (turn[a], a)):
        free = sorted((w, b) for _, x, b, _, w in pairs if x == a and b not in used)
        if free:
            used.add(free[0][1])
            want.add((a, free[0][1]))
    assert got == want and len({b for _, b in got}) == len(got)


def test_suppression_of_chains_takes_few_tables(spark, monkeypatch):
    """Chains in which every box waits for the one before are walked; a sheet above the limit goes in rounds, with the same boxes left."""
    rows = [(s, f"{s}-{i:03d}", 0, 1 - i / 1000, float(7 * i), 0.0, 7.0 * i + 20, 20.0) for s, n in ((1, 9), (2, 30), (3, 30)) for i in range(n)]
    d = spark.createDataFrame(rows, COLS)
    tables, write = [], suppress.staged
    monkeypatch.setattr(suppress, "staged", lambda df: tables.append(1) or write(df))
    kept = lambda: {(r.sheet_id, r.det_id) for r in suppress.centroid(d).select("sheet_id", "det_id").collect()}
    assert kept() == walk_suppression(rows) and len(tables) < 7
    monkeypatch.setattr(suppress, "LARGE", 8)  # the short chain is walked
    d = d.filter("sheet_id = 1 or (sheet_id = 2 and det_id < '2-012')")
    assert kept() == walk_suppression([r for r in rows if r[0] == 1 or (r[0] == 2 and r[1] < "2-012")])


def adjacency(edges):
    adj = {}
    for u, v in edges:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    return adj


def test_elimination_is_order_free(spark):
    rng = random.Random(3)
    n = 40
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(60)}
    gone = set(rng.sample(range(n), 18))
    adj = adjacency(edges)
    for x in rng.sample(sorted(gone), len(gone)):
        near = adj.pop(x, set())
        for a in near:
            adj[a].discard(x)
        for a, b in itertools.combinations(near, 2):
            adj[a].add(b), adj[b].add(a)
    want = {tuple(sorted((a, b))) for a in adj for b in adj[a]}
    v = spark.createDataFrame([(1, i, "connector" if i in gone else "valve") for i in range(n)], "sheet_id long, node_id long, node_type string")
    e = spark.createDataFrame([(1, u, w) for u, w in edges], "sheet_id long, u long, v long")
    assert {(r.u, r.v) for r in graph.eliminate(v, e, ["connector"]).collect()} == want


def test_components_of_long_paths(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    e = spark.createDataFrame([(1, a, b) for a, b in zip(ids[:40], ids[1:40])], "sheet_id long, u long, v long")
    v = spark.createDataFrame([(1, i) for i in range(60)], "sheet_id long, node_id long")
    got = {r.node_id: r.comp for r in components(v, e).collect()}
    assert all(got[i] == min(ids[:40]) for i in ids[:40]) and all(got[i] == i for i in ids[40:])


def test_gt_crossings_follow_id_order(spark):
    rng = random.Random(11)
    pos = {i: (rng.randrange(400), rng.randrange(400)) for i in range(24)}
    edges = {tuple(sorted(rng.sample(range(24), 2))) for _ in range(40)}
    cross = {2, 5, 6, 11, 12, 17}
    adj, apart = adjacency(edges), set()
    err = lambda c, a, b: abs((math.degrees(math.atan2(pos[b][1] - pos[c][1], pos[b][0] - pos[c][0]) - math.atan2(pos[a][1] - pos[c][1], pos[a][0] - pos[c][0])) % 360) - 180)
    for c in sorted(cross):
        near = sorted(adj.pop(c, set()))
        for a in near:
            adj[a].discard(c)
        if len(near) == 2:
            ok = [tuple(near)]
        elif len(near) == 3:
            ok = [min(itertools.combinations(near, 2), key=lambda p: round(err(c, *p), 9))]
        elif len(near) > 3:
            a, b, d, e = near[:4]
            ok = min([[(a, b), (d, e)], [(a, d), (b, e)], [(a, e), (b, d)]], key=lambda w: round(sum(err(c, *p) for p in w), 9))
        else:
            ok = []
        apart |= {(c, *p) for p in itertools.combinations(near, 2) if p not in ok}
        for a, b in ok:
            adj[a].add(b), adj[b].add(a)
    v = spark.createDataFrame([(1, i, "crossing" if i in cross else "valve", float(x), float(y)) for i, (x, y) in pos.items()], "sheet_id long, node_id long, label string, cx double, cy double")
    got, pairs = graph.gt_crossings(v, spark.createDataFrame([(1, *e) for e in edges], "sheet_id long, u long, v long"))
    assert {(r.u, r.v) for r in got.collect()} == {tuple(sorted((a, b))) for a in adj for b in adj[a]}
    assert {(r.crossing, r.a, r.b) for r in pairs.filter("not passes").collect()} == apart


def line(a, b, n=9):
    return [(int(a[1] + (b[1] - a[1]) * k / (n - 1)), int(a[0] + (b[0] - a[0]) * k / (n - 1))) for k in range(n)]


def test_contraction_joins_runs_not_taps(spark):
    # a header 0 - j10 - j11 - 1 with taps 2 and 3 hanging off either junction
    pos = {0: (0, 100), 10: (100, 100), 11: (200, 100), 1: (300, 100), 2: (100, 200), 3: (200, 200)}
    pairs = [(0, 10), (10, 11), (11, 1), (2, 10), (3, 11)]
    rows = [(1, i, u, v, [dict(r=r, c=c) for r, c in line(pos[u], pos[v])]) for i, (u, v) in enumerate(pairs)]
    e = spark.createDataFrame(rows, "sheet_id long, branch_id long, u long, v long, coords array<struct<r:long,c:long>>")
    v = spark.createDataFrame([(1, i, "connector" if i >= 10 else "valve") for i in pos], "sheet_id long, node_id long, node_type string")
    got = {(r.u, r.v): r for r in contract.connectors(v, e).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2), (0, 3), (1, 3)}  # taps 2 and 3 both reach the header ends but not each other
    assert got[(0, 1)].backbone is True and got[(0, 2)].backbone is False
    assert list(got[(0, 1)].parts) == [0, 1, 2] and len(got[(0, 1)].coords) == 25
    allpairs = {(r.u, r.v) for r in graph.eliminate(v, e, ["connector"]).collect()}
    assert allpairs == set(got) | {(2, 3)}


def walked(edges, gone, tol=28.0):
    """Connectors taken away one by one in id order; edges as {pair: (start, points or None, backbone)}."""
    live = dict(edges)

    def leaving(pair, x):
        start, pts, _ = live[pair]
        return pts if pts is None or start == x else pts[::-1]

    def unit(pts):
        if pts is None or len(pts) < 2:
            return None
        (r0, c0), (r1, c1) = pts[0], pts[min(5, len(pts) - 1)]
        size = math.hypot(r1 - r0, c1 - c0)
        return ((r1 - r0) / size, (c1 - c0) / size) if size >= 0.5 else None

    for x in sorted(gone):
        near = sorted(n for p in live if x in p for n in p if n != x)
        tap = {n: live[frozenset((x, n))][2] is False for n in near}
        head = {n: unit(leaving(frozenset((x, n)), x)) for n in near}
        main = [n for n in near if not tap[n] and head[n]]
        want = []
        if len(near) == 2:
            want = [(*near, not any(tap.values()))]
        elif len(near) > 2:
            runs, busy = [], set()
            for d, a, b in sorted((head[a][0] * head[b][0] + head[a][1] * head[b][1], a, b) for a, b in itertools.combinations(main, 2)):
                if d <= math.cos(math.radians(180 - tol)) and not busy & {a, b}:
                    runs.append((a, b))
                    busy |= {a, b}
            want = [(a, b, True) for a, b in runs] + [(n, end, False) for n in near if n not in busy and (tap[n] or head[n]) for run in runs for end in run]
            want += [(n, m, None) for n in near if not tap[n] and not head[n] for m in near if m != n]
            if not runs:
                want = [(a, b, None) for a, b in itertools.combinations(near, 2)]
        new = {}
        for a, b, flag in want:
            if frozenset((a, b)) not in live and frozenset((a, b)) not in new:
                one, two = leaving(frozenset((x, a)), a), leaving(frozenset((x, b)), x)
                new[frozenset((a, b))] = (a, None if one is None or two is None else one + (two[1:] if one[-1] == two[0] else two), flag)
        live = {p: e for p, e in {**live, **new}.items() if x not in p}
    return live


def test_rounds_equal_the_walk_in_id_order(spark):
    rng = random.Random(21)
    pos = {i: (rng.randrange(300), rng.randrange(300)) for i in range(30)}
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)})
    gone, given = [i for i in range(30) if i % 3], {}
    for u, v in pairs:
        start = rng.choice([u, v])
        given[frozenset((u, v))] = (start, None if rng.random() < 0.15 else line(pos[start], pos[u + v - start], rng.choice([2, 4, 9])), rng.choice([None, None, False]))
    # a run of connectors numbered at random between two valves, and one that hangs off a connector of smaller number
    for run in (rng.sample(range(1000, 1040), 15), list(range(1040, 1046))):
        ends = [0] + run + [3] if run[0] < 1040 else [1] + run + [6]
        gone += run
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            given[frozenset((a, b))] = (a, line((k, 0), (k + 1, 7), 3), None)
    want = {tuple(sorted(p)): e for p, e in walked(given, gone).items()}
    rows = [(1, i, *sorted(p), s, sum(p) - s, pts and [dict(r=r, c=c) for r, c in pts], flag) for i, (p, (s, pts, flag)) in enumerate(given.items())]
    e = spark.createDataFrame(rows, "sheet_id long, branch_id long, u long, v long, route_u long, route_v long, coords array<struct<r:long,c:long>>, backbone boolean")
    v = spark.createDataFrame([(1, i, "connector" if i in gone else "valve") for i in {x for p in given for x in p}], "sheet_id long, node_id long, node_type string")
    got = {(r.u, r.v): (r.route_u, r.coords and [tuple(c) for c in r.coords], r.backbone) for r in contract.connectors(v, e).collect()}
    assert got == want


def test_long_runs_take_few_rounds(spark, monkeypatch):
    n, calls = 400, []
    monkeypatch.setattr(contract.Round, "settled", lambda *a, f=contract.Round.settled: calls.append(1) or f(*a))
    e = spark.createDataFrame([(1, i, f"junc_{i}", f"junc_{i + 1}", [dict(r=0, c=i), dict(r=0, c=i + 1)]) for i in range(1, n)] + [(1, 0, "sym_0", "junc_1", [dict(r=0, c=0), dict(r=0, c=1)]), (1, n, f"junc_{n}", "sym_9", [dict(r=0, c=n), dict(r=0, c=n + 1)])],
                              "sheet_id long, branch_id long, u string, v string, coords array<struct<r:long,c:long>>")
    v = spark.createDataFrame([(1, f"junc_{i}", "connector") for i in range(1, n + 1)] + [(1, "sym_0", "valve"), (1, "sym_9", "valve")], "sheet_id long, node_id string, node_type string")
    r, = contract.connectors(v, e).collect()
    assert (r.u, r.v, r.backbone, len(r.coords), sorted(r.parts)) == ("sym_0", "sym_9", True, n + 2, list(range(n + 1))) and len(calls) < 30
    assert [c.c for c in r.coords] in (list(range(n + 2)), list(range(n + 1, -1, -1)))


def test_crossings_make_no_way_through_two(spark):
    """An edge made at one crossing has no branch, so it ends at the next; the smaller crossing provides a shared edge."""
    v = spark.createDataFrame([(1, i, "valve", None) for i in (0, 1, 2)] + [(1, 8, "crossing", [dict(a=0, b=1)]), (1, 9, "crossing", [dict(a=1, b=2), dict(a=3, b=4)]), (1, 10, "crossing", [dict(a=5, b=6)])],
                              "sheet_id long, node_id long, node_type string, pass_pairs array<struct<a:long,b:long>>")
    e = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 8, 9), (1, 2, 1, 9), (1, 3, 0, 9), (1, 4, 2, 9), (1, 5, 0, 10), (1, 6, 2, 10)], "sheet_id long, branch_id long, u long, v long")
    assert {(r.u, r.v) for r in contract.crossings(v, e).collect()} == {(0, 2)}


def test_crossing_passes_declared_branches_only(spark):
    v = spark.createDataFrame([(1, i, "valve", None) for i in (0, 1, 2, 3)] + [(1, 9, "crossing", [dict(a=0, b=1), dict(a=2, b=3)])],
                              "sheet_id long, node_id long, node_type string, pass_pairs array<struct<a:long,b:long>>")
    e = spark.createDataFrame([(1, i, i, 9) for i in range(4)], "sheet_id long, branch_id long, u long, v long")
    assert {(r.u, r.v) for r in contract.crossings(v, e).collect()} == {(0, 1), (2, 3)}


def test_average_precision_by_hand(spark):
    rows = [(0, "a", 0.9, 1), (0, "b", 0.8, 0), (0, "c", 0.7, 1), (0, "d", 0.7, 0), (0, "e", 0.5, 1), (1, "a", 0.9, 1), (1, "b", 0.8, 1),
            (3, "a", 0.9, 1), (3, "b", 0.8, 0), (3, "d", 0.7, 1), (3, "c", 0.7, 0), (3, "e", 0.5, 1)]
    gt = spark.createDataFrame([(0, 4), (1, 2), (2, 3), (3, 4)], "cls int, n_gt long")
    got = {r.cls: r.ap for r in metrics.ap(spark.createDataFrame(rows, "cls int, det_id string, conf double, tp int"), gt, tie=("det_id",)).collect()}
    assert got[1] == 1.0 and got[2] == 0.0  # a perfect predictor; no detections
    assert got[0] == pytest.approx((1.0 + 2 / 3 + 3 / 5) / 4)
    assert got[3] == pytest.approx((1.0 + 3 / 5 + 3 / 5) / 4)  # of equal confidences the smaller id counts first, true or not


def test_average_precision_of_many_ties_equals_the_walk(spark):
    rng = random.Random(17)
    rows = [(c, f"d{i:04d}", rng.choice([0.3, 0.5, 0.5, 0.5, 0.9]) if c else 0.5, int(rng.random() < 0.4)) for c in (0, 1) for i in range(700)]
    rng.shuffle(rows)
    gt = spark.createDataFrame([(0, 400), (1, 500)], "cls int, n_gt long")
    got = {r.cls: r.ap for r in metrics.ap(spark.createDataFrame(rows, "cls int, det_id string, conf double, tp int"), gt, tie=("det_id",)).collect()}
    for c, n in ((0, 400), (1, 500)):
        tp, precision = 0, []
        for k, r in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1])), 1):
            tp += r[3]
            precision.append((r[3], tp / k))
        area, best = 0.0, 0.0
        for hit, p in reversed(precision):
            best = max(best, p)
            area += hit * best
        assert got[c] == pytest.approx(area / n)


def test_quantiles_both_rules(spark):
    rng = random.Random(2)
    vals = [round(rng.gauss(0, 50), 1) for _ in range(201)] + [7.0] * 50
    d = spark.createDataFrame([(1, v) for v in vals], "k int, x double")
    q = ranking.quantiles(d, ["k"], F.col("x"), {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert [q.a, q.b, q.c] == pytest.approx(list(np.percentile(vals, [10, 50, 90])))
    n = ranking.quantiles(d, ["k"], F.col("x"), {"a": 0.25}, "nearest").first()
    assert n.a == sorted(vals)[round(0.25 * (len(vals) - 1))]


def test_tiles_cover_small_and_large_pages(spark):
    im = spark.createDataFrame([(1, 500, 700), (2, 1300, 640)], "sheet_id long, width int, height int")
    t = {(r.sheet_id, r.tile_no): (r.wx1, r.wy1) for r in tiling.grid(im).collect()}
    assert t == {(1, 0): (0, 0), (1, 1): (0, 60), (2, 0): (0, 0), (2, 1): (512, 0), (2, 2): (660, 0)}


def test_reclassification_needs_a_gap_and_can_be_switched_off(spark):
    from sheetgraph.operators import junctions
    arms = {0: (100, 40), 1: (100, 160), 2: (40, 100), 3: (160, 100)}
    b = [(1, i, 2, [dict(r=r, c=c) for r, c in line((100 + (x - 100) // 20, 100 + (y - 100) // 20), (x, y), 30)]) for i, (x, y) in arms.items()]
    br = spark.createDataFrame(b, "sheet_id long, branch_id long, branch_type int, coords array<struct<r:long,c:long>>")
    at = spark.createDataFrame([(1, 7, i, "src") for i in arms], "sheet_id long, cluster long, branch_id long, which_end string")
    centre = spark.createDataFrame([(1, 7, 100.0, 100.0)], "sheet_id long, cluster long, cx double, cy double")
    dots = spark.createDataFrame([(1, x, 100) for x in range(40, 161)], "sheet_id long, x long, y long")  # only the level pipe is inked
    r = junctions.reclassify_4way(at, centre, br, dots, 200, 200).collect()
    assert len(r) == 1 and [tuple(p) for p in r[0].pass_pairs] == [(0, 1), (2, 3)]
    assert junctions.reclassify_4way(at, centre, br, dots, 200, 200, gap_fraction=4.0).isEmpty()


@pytest.mark.parametrize("tp,fp,fn,p,r,f", [(23, 22, 8, 0.511, 0.742, 0.605), (9, 13, 1, 0.409, 0.900, 0.563), (16, 15, 6, 0.516, 0.727, 0.604)])
def test_published_sheet_ratios(spark, tp, fp, fn, p, r, f):
    row = evaluate.prf(spark.createDataFrame([(tp, fp, fn)], "tp long, fp long, fn long")).first()
    assert (round(row.precision, 3), round(row.recall, 3), round(row.f1, 3)) == (p, r, f)


def test_disc_offsets():
    assert ink.touching_offsets(3)[0] == 7 and max(ink.touching_offsets(3)) == 7


def test_path_of_any_length(spark):
    from sheetgraph.operators.graph import shortest_path
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(25)], "sheet_id int, u bigint, v bigint")
    pairs = spark.createDataFrame([(1, 0, 0, 25), (1, 1, 0, 99)], "sheet_id int, pair_id int, start bigint, goal bigint")
    assert {r.pair_id: r.hops for r in shortest_path(edges, pairs).collect()} == {0: 25, 1: None}


def test_ground_truth_runs_over_adjacent_crossings(spark):
    from types import SimpleNamespace
    from checks.graphs import gt_graph
    # valve 1 - crossings 2, 3, 4 - valve 5 in a row, each crossing cut at a right angle by a line between two more valves
    at = {i: (100.0 * i, 0.0, "crossing" if i in (2, 3, 4) else "valve") for i in range(1, 6)}
    at |= {10 * c + k: (100.0 * c, y, "valve") for c in (2, 3, 4) for k, y in ((0, -80.0), (1, 80.0))}
    edges = [(i, i + 1) for i in range(1, 5)] + [(c, 10 * c + k) for c in (2, 3, 4) for k in (0, 1)]
    # sheet 2: the same with an odd numbering, a general vertex within the line and a background vertex beside it
    other = {1: 9, 2: 4, 3: 2, 4: 3, 5: 1}
    v = [(1, i, l, x, y) for i, (x, y, l) in at.items()] + [(2, other.get(i, i), l, x, y) for i, (x, y, l) in at.items()] + [(2, 50, "general", 250.0, 0.0), (2, 51, "background", 250.0, 9.0)]
    e = [(1, a, b) for a, b in edges] + [(2, *sorted((other.get(a, a), other.get(b, b)))) for a, b in edges if (a, b) != (2, 3)] + [(2, 4, 50), (2, 2, 50), (2, 9, 51), (2, 1, 51)]
    views = SimpleNamespace(gt_vertex=spark.createDataFrame(v, "sheet_id long, node_id long, label string, cx double, cy double"), gt_edge=spark.createDataFrame(e, "sheet_id long, u long, v long"))
    gv, got, apart = gt_graph(views)
    assert {(r.sheet_id, r.u, r.v) for r in got.collect()} == {(1, 1, 5), (1, 20, 21), (1, 30, 31), (1, 40, 41), (2, 1, 9), (2, 20, 21), (2, 30, 31), (2, 40, 41)}
    assert gv.filter("sheet_id = 1").count() == 8
    assert not apart.filter("a = 20 and b = 21 or a = 1 and b = 5").head(1)


def contracted_in_turn(pos, edges, cross):
    """Crossings one by one in id order: edges left and pairs kept apart."""
    adj, apart = adjacency(edges), set()
    err = lambda c, a, b: abs((math.degrees(math.atan2(pos[b][1] - pos[c][1], pos[b][0] - pos[c][0]) - math.atan2(pos[a][1] - pos[c][1], pos[a][0] - pos[c][0])) % 360) - 180)
    for c in sorted(cross):
        near = sorted(adj.pop(c, set()))
        for a in near:
            adj[a].discard(c)
        ways = [[p] for p in itertools.combinations(near, 2)] if len(near) < 4 else [[(near[0], near[i]), tuple(near[j] for j in (1, 2, 3) if j != i)] for i in (1, 2, 3)]
        ok = min(ways, key=lambda w: round(sum(err(c, *p) for p in w), 9), default=[])
        apart |= {(c, *p) for p in itertools.combinations(near, 2) if p not in ok}
        for a, b in ok:
            adj[a].add(b), adj[b].add(a)
    return {tuple(sorted((a, b))) for a in adj for b in adj[a]}, apart


def both_contractions(spark, sheets):
    """Distributed and plain results of {sheet: (pos, edges, cross)}."""
    v = spark.createDataFrame([(s, i, "crossing" if i in cross else "valve", float(x), float(y)) for s, (pos, _, cross) in sheets.items() for i, (x, y) in pos.items()], "sheet_id long, node_id long, label string, cx double, cy double")
    e = spark.createDataFrame([(s, *x) for s, (_, edges, _) in sheets.items() for x in edges], "sheet_id long, u long, v long")
    live, pairs = graph.gt_crossings(v, e)
    want = {s: contracted_in_turn(*x) for s, x in sheets.items()}
    got = {(r.sheet_id, r.u, r.v) for r in live.collect()}, {(r.sheet_id, r.crossing, r.a, r.b) for r in pairs.filter("not passes").collect()}
    return got, ({(s, *x) for s, (left, _) in want.items() for x in left}, {(s, *x) for s, (_, apart) in want.items() for x in apart})


def test_crossings_that_depend_on_each_other(spark):
    """Dense sheets, where lines merge, end and turn back, and grids of adjacent crossings numbered at random."""
    rng, sheets = random.Random(4), {}
    for s in range(30):
        n = rng.choice([6, 9, 14])
        pos = {i: (rng.randrange(50), rng.randrange(50)) for i in range(n)}
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(int(n * rng.choice([1, 1.4, 1.8])))}
        sheets[s] = pos, edges, set(rng.sample(range(n), int(n * rng.choice([0.4, 0.8]))))
    for s in range(30, 36):
        ids = rng.sample(range(200), 81)
        at = {(x, y): ids[9 * y + x] for x in range(9) for y in range(9)}
        edges = {tuple(sorted((at[p], at[q]))) for p in at for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in at}
        pos = {i: (10 * x + rng.random() * (s % 3), 10 * y + rng.random() * (s % 3)) for (x, y), i in at.items()}
        sheets[s] = pos, edges, {at[p] for p in at if 0 < p[0] < 8 and 0 < p[1] < 8}
    got, want = both_contractions(spark, sheets)
    assert got == want


def test_long_run_of_crossings_takes_few_tables(spark, monkeypatch):
    n, tables = 1000, []
    monkeypatch.setattr(graph, "staged", lambda df, f=graph.staged: tables.append(1) or f(df))
    pos = {i: (i, 0) for i in range(n + 2)} | {10_000 + i: (i, 1) for i in range(1, n + 1)} | {20_000 + i: (i, -1) for i in range(1, n + 1)}
    edges = {(i, i + 1) for i in range(n + 1)} | {(i, k + i) for i in range(1, n + 1) for k in (10_000, 20_000)}
    got, want = both_contractions(spark, {1: (pos, edges, set(range(1, n + 1)))})
    assert got == want and (1, 0, n + 1) in got[0] and len(tables) < 60


@pytest.mark.parametrize("major", ["pred", "gt"])
def test_matching_of_copies_takes_turns(spark, major):
    """Many equal boxes on both sides, places wanted equally, and boxes that only some can reach."""
    rng = random.Random(6)
    spots = [(rng.choice([100, 104, 108, 112]), rng.choice([100, 104])) for _ in range(9)]
    det = [(1, "v", f"d{i:03d}", rng.randrange(5) / 5, *(float(c) for x, y in [rng.choice(spots)] for c in (x, y, x + 8, y + 8))) for i in range(60)]
    gt = [(1, "v", f"g{i:03d}", *(float(c) for x, y, w in [(*rng.choice(spots), rng.choice([8, 16]))] for c in (x, y, x + w, y + w))) for i in range(45)]
    d = spark.createDataFrame(det, "sheet_id long, label string, det_id string, conf double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame(gt, "sheet_id long, label string, gt_id string, x1 double, y1 double, x2 double, y2 double")
    far = lambda p, q: ((p[-4] + p[-2]) / 2 - (q[-4] + q[-2]) / 2) ** 2 + ((p[-3] + p[-1]) / 2 - (q[-3] + q[-1]) / 2) ** 2
    reach = lambda p, q: far(p, q) <= 0.25 * (q[-2] - q[-4]) * (q[-1] - q[-3])
    want, used = set(), set()
    takers = sorted(det, key=lambda p: (-p[3], p[2])) if major == "pred" else sorted(gt, key=lambda q: q[2])
    for t in takers:
        pick = lambda p, q: (far(p, q), q[2] if major == "pred" else p[2])
        free = [pick(t, q) for q in gt if reach(t, q) and q[2] not in used] if major == "pred" else [pick(p, t) for p in det if reach(p, t) and p[2] not in used]
        if free:
            used.add(min(free)[1])
            want.add((t[2], min(free)[1]) if major == "pred" else (min(free)[1], t[2]))
    assert {(r.det_id, r.gt_id) for r in match.greedy_center(d, g, major=major).collect()} == want and len(want) > 30


def test_small_groups_are_walked_and_large_ones_settled_in_rounds(spark, monkeypatch):
    """A chain in which everybody waits for the one before takes a few tables, not some per link; both ways give the same at every threshold."""
    n = 12
    d = spark.range(2 * n).selectExpr("id % 2 AS sheet_id", "0 AS cls", "lpad(id, 4, '0') AS det_id", "1 - id / 1000D AS conf", "id * 4D AS x1", "0D AS y1", "id * 4D + 20 AS x2", "20D AS y2")
    g = spark.range(2 * n).selectExpr("id % 2 AS sheet_id", "0 AS cls", "lpad(id, 4, '0') AS gt_id", "id * 4D - 5 AS x1", "0D AS y1", "id * 4D + 15 AS x2", "20D AS y2").unionByName(
        spark.range(20).selectExpr("0L AS sheet_id", "0 AS cls", "concat('c', id) AS gt_id", "19D AS x1", "0D AS y1", "39D AS x2", "20D AS y2"))
    tables, write = [], match.staged
    monkeypatch.setattr(match, "staged", lambda df: tables.append(1) or write(df))
    got = lambda: sorted((r.sheet_id, r.thr, r.det_id, r.gt_id) for r in match.greedy_iou(d, g, [0.5, 0.3, 0.1]).collect())
    walked = got()
    assert len(tables) < 6 and len(walked) > 3 * n
    monkeypatch.setattr(match, "LARGE", 100)  # the sheet with the copies is settled in rounds
    assert got() == walked and len(tables) > 12


def test_best_from_here_walks_once(spark):
    """Right for equal and missing values, and no frame that ends at the last row, which is added up anew for every row."""
    rows = [(k, i // 3, i, None if i % 4 == 0 else float(i * 7919 % 101)) for k in (1, 2) for i in range(30)]
    d = ranking.best_from_here(spark.createDataFrame(rows, "k int, b int, i int, v double"), ["k"], F.col("b"), [F.asc("i")], F.col("v"), "best")
    for r in d.collect():
        assert r.best == max(v for k, _, i, v in rows if k == r.k and i >= r.i and v is not None)
    assert "unboundedfollowing" not in d._jdf.queryExecution().optimizedPlan().toString().lower()


def test_ten_thousand_copies_on_one_spot(spark):
    d = spark.range(10_000).selectExpr("1L AS sheet_id", "0 AS cls", "id AS det_id", "(id * 7919 % 10000) / 10000D AS conf", "10D AS x1", "10D AS y1", "30D AS x2", "30D AS y2")
    g = spark.range(6_000).selectExpr("1L AS sheet_id", "0 AS cls", "id AS gt_id", "11D AS x1", "10D AS y1", "31D AS x2", "30D AS y2")
    m = match.greedy_iou(d, g)
    assert m.join(d, "det_id").agg(F.count(F.lit(1)), F.countDistinct("gt_id"), F.min("conf")).first() == (6000, 6000, 0.4)
    assert m.join(d, "det_id").filter(F.round((1 - F.col("conf")) * 10_000) - 1 != F.col("gt_id")).isEmpty()


def test_close_classes_of_a_pile_are_counted(spark):
    """A pile of 10,000 boxes of two classes, and counts that equal those of listed pairs on random boxes."""
    pile = spark.range(10_000).selectExpr("1L AS sheet_id", "id AS node_id", "CAST(id % 2 AS INT) AS cls_id", "'valve' AS node_type", "0D AS x1", "0D AS y1", "20D AS x2", "20D AS y2")
    assert {(r.family, r.cls_lo, r.n) for r in suppress.close_class_counts(pile).collect()} == {("valve", 0, 25_000_000), ("valve", None, 25_000_000), (None, None, 25_000_000)}
    rng = random.Random(8)
    rows = [(1, i, rng.choice([0, 1, 25]), rng.choice(["valve", "instrument"]), *(float(c) for c in (x, y, x + w, y + w))) for i in range(120) for x, y, w in [(rng.randrange(12), rng.randrange(12), rng.choice([6, 10]))]]
    d = spark.createDataFrame(rows, "sheet_id long, node_id long, cls_id int, node_type string, x1 double, y1 double, x2 double, y2 double")
    show = lambda c: sorted(map(str, c.collect()))
    assert show(suppress.close_class_counts(d)) == show(suppress.close_pair_counts(suppress.close_pairs(d)))


def test_clusters_of_runs_equal_clusters_of_pixels(spark):
    rng = random.Random(12)
    px = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | {(x, y) for x in range(5, 30) for y in range(80, 84)} | {(40, 81), (200, 5)}
    reach, left, want = ink.touching_offsets(3), set(px), set()
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x, y = p = todo.pop()
            group.add(p)
            near = {q for q in left if abs(q[0] - x) <= reach.get(abs(q[1] - y), -1)}
            left -= near
            todo += near
        want.add(frozenset(group))
    got = {}
    for r in ink.cluster(spark.createDataFrame([(1, *p) for p in px], "sheet_id long, x long, y long")).collect():
        got.setdefault(r.cluster, set()).add((r.x, r.y))
    assert {frozenset(g) for g in got.values()} == want and all(c == min(y * 2**32 + x for x, y in g) for c, g in got.items())


@pytest.mark.parametrize("mask", [True, False])
def test_corridor_equals_plain_code(spark, mask):
    rng = random.Random(11)
    W, H = 900, 600
    nodes = []
    for i in range(14):
        x, y, w, h = rng.randint(0, 800), rng.randint(0, 500), rng.randint(8, 60), rng.randint(8, 60)
        nodes.append((1, i, "flow_arrow" if i % 5 == 4 else "valve", float(x), float(y), float(x + w), float(y + h), x - 3, y - 3, x + w + 3, y + h + 3))
    # a straight line over more than two words of bins, and a pile of equal boxes on it
    nodes += [(1, 20, "valve", 20.0, 550.0, 40.0, 570.0, 17, 547, 43, 573), (1, 21, "valve", 420.0, 550.0, 440.0, 570.0, 417, 547, 443, 573)]
    nodes += [(1, 30 + i, "valve", 200.0, 552.0, 220.0, 568.0, 197, 549, 223, 571) for i in range(5)]
    ink_rows = {(rng.randint(0, W - 1), rng.randint(0, H - 1)) for _ in range(6000)} | {(x, 560) for x in range(20, 440)}
    cols = ["sheet_id", "node_id", "node_type", "x1", "y1", "x2", "y2", "dx1", "dy1", "dx2", "dy2"]
    n = spark.createDataFrame(nodes, cols)
    px = spark.createDataFrame([(1, x, y) for x, y in ink_rows] + [(1, 25, 560)], ["sheet_id", "x", "y"])
    pairs = ink.gap_pairs(n, 400.0)
    got = {(r.a_id, r.b_id): r for r in ink.corridor(pairs, px, n, W, H, mask_third=mask).collect()}
    by_id = {r[1]: r for r in nodes}
    want = {}
    for p in pairs.collect():
        a, b = by_id[p.a_id], by_id[p.b_id]
        gap = lambda lo, hi: max(0, a[lo] - b[hi], b[lo] - a[hi])
        m = 10 if gap(3, 5) == 0 and gap(4, 6) == 0 else 2
        rx1, ry1, rx2, ry2 = max(0, min(a[3], b[3]) - m), max(0, min(a[4], b[4]) - m), min(W, max(a[5], b[5]) + m), min(H, max(a[6], b[6]) + m)
        ca, cb = ((a[3] + a[5]) / 2, (a[4] + a[6]) / 2), ((b[3] + b[5]) / 2, (b[4] + b[6]) / 2)
        dx, dy = cb[0] - ca[0], cb[1] - ca[1]
        size = math.sqrt(dx * dx + dy * dy)
        ux, uy = (dx / size, dy / size) if size >= 1 else (1.0, 0.0)
        third = [r[7:11] if mask else r[3:7] for r in nodes if r[2] != "flow_arrow" and r[1] not in (a[1], b[1])]
        seen = []
        for x, y in ink_rows:
            if not (rx1 <= x < rx2 and ry1 <= y < ry2) or any(q[3] <= x < q[5] and q[4] <= y < q[6] for q in (a, b)):
                continue
            inside = any(t[0] <= x < t[2] and t[1] <= y < t[3] for t in third)
            if not (mask and inside):
                ox, oy = x - ca[0], y - ca[1]
                seen.append((ox * ux + oy * uy, abs(oy * ux - ox * uy), inside))
        if not seen:
            continue
        core = [s for s in seen if s[1] <= 10]
        lo, hi = (min(s[0] for s in core), max(s[0] for s in core)) if core else (None, None)
        bins = {math.floor((s[0] - lo) / 2) for s in core}
        wider = sum(1 for s in seen if core and 10 < s[1] <= 30 and lo <= s[0] <= hi)
        want[p.a_id, p.b_id] = (len(seen), len(core), len(bins), wider, sum(s[2] for s in core) / len(core) if core else None)
    assert {k: (r.n_ink, r.n_corr, r.bins, r.n_wider, r.third_share) for k, r in got.items()} == want
    assert len(want) > 60 and max(w[2] for w in want.values()) > 128
