"""Registered queries on small tables, where they must do the whole job, beyond what their SQL covers."""

import collections
from types import SimpleNamespace

import pytest


@pytest.fixture
def run(spark, monkeypatch):
    """Rows of a registered query over given views: name=(schema, rows)."""
    def of(name, **views):
        import __spark_entry__ as e
        frames = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in views.items()}
        monkeypatch.setattr("checks.views.Views", lambda s, d: SimpleNamespace(_s=s, **frames))
        return e.queries()[name](spark, "").collect()
    return of


BOX = "x1 double, y1 double, x2 double, y2 double"
DET = "sheet_id long, det_id string, cls_id int, conf double, " + BOX
GT = "sheet_id long, gt_id string, label string, " + BOX


def test_paths_of_all_starts_and_any_length(run):
    # 3 - 100 - 101 - ... - 117 - 12 is 19 hops; a chain 200 ... 212 has starts of every residue
    edges = [(3, 100), *[(i, i + 1) for i in range(100, 117)], (12, 117), *[(i, i + 1) for i in range(200, 212)], (110, 500), (110, 501)]
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)

    def path(s, t):
        before, todo = {s: None}, [s]
        for x in todo:
            for y in sorted(near[x]):
                if y not in before:
                    before[y] = x
                    todo.append(y)
        out = [t] if t in before else None
        while out and before[out[0]] is not None:
            out.insert(0, before[out[0]])
        return out

    want = {u: path(u, u + 9) for u, _ in edges}
    got = {r.pair_id: r.hops for r in run("g21_shortest_path", edge=("sheet_id long, u long, v long", [(1, *e) for e in edges]))}
    assert got == {u: p and len(p) - 1 for u, p in want.items()} and got[3] == 19 and got[101] == 9 and got[203] == 9 and got[204] is None
    # at crossing 110 the first and third branch meet, which do not pass through
    ids = {(109, 110): 1, (110, 500): 2, (110, 111): 3, (110, 501): 4}
    branch = [(1, *e, ids.get(e, 10 + i), 1) for i, e in enumerate(edges)]
    vertex = [(1, n, "crossing" if n == 110 else "valve", 0.0, 0.0, 1.0, 1.0) for n in sorted(near)]
    bad = run("g21_path_culprits", edge=("sheet_id long, u long, v long", [(1, *e) for e in edges]), branch=("sheet_id long, u long, v long, branch_id long, branch_type int", branch),
              vertex=("sheet_id long, node_id long, node_type string, " + BOX, vertex))
    assert {(r.pair_id, r.crossing) for r in bad} == {(u, 110) for u, p in want.items() if p and {109, 110, 111} <= set(p)} and 3 in {r.pair_id for r in bad}


def test_triage_sees_detections_of_low_confidence(run):
    at = lambda x, w=10.0: (x, 0.0, x + w, 10.0)
    gt = [(1, "a", "valve", *at(0.0)), (1, "b", "valve", *at(100.0)), (1, "c", "arrow", *at(200.0)), (1, "d", "valve", *at(300.0)), (1, "e", "valve", *at(400.0)), (1, "f", "valve", *at(500.0))]
    det = [(1, "pa", 0, 0.3, *at(0.0)), (1, "pb", 0, 0.2, *at(106.0)), (1, "pc", 0, 0.02, *at(200.0)), (1, "pd", 14, 0.1, *at(300.0)), (1, "pf", 0, 0.9, *at(500.0))]
    views = dict(det=(DET, det), gt=(GT, gt), ignore_box=("sheet_id long, ig_id string, " + BOX, [(1, "i", *at(900.0))]))
    assert {r.gt_id: r.bucket for r in run("j15_failure_buckets", **views)} == {"a": "TP", "b": "B", "c": "C", "d": "D", "e": "A", "f": "TP"}
    assert [(r.label, r.best_cls, r.n) for r in run("j16_wrong_class_top", **views)] == [("arrow", 0, 1)]
    assert {r.metric: (r.n, r.mean) for r in run("m11_offset_stats", **views)} == {"dx": (1, 0.6), "dy": (1, 0.0), "area_ratio": (1, 1.0)}
    assert {(r.gt_id, r.bucket) for r in run("t10_varied_examples", **views)} == {("a", "TP"), ("b", "B"), ("c", "C"), ("d", "D"), ("e", "A"), ("f", "TP")}


def test_tiles_and_images_with_boxes_of_any_label(run):
    # sheets of one tile each; sheet n holds n boxes, of all labels in turn
    labels = ["valve", "instrumentation", "arrow"]
    views = dict(image=("sheet_id long, width int, height int, split string", [(s, 640, 640, "train") for s in range(40)]),
                 gt=(GT, [(s, f"{s}-{k}", labels[k % 3], 10.0 * k, 0.0, 10.0 * k + 5, 5.0) for s in range(4) for k in range(s)]))
    empty = {r.sheet_id for r in run("t3_negative_tiles", image=views["image"], gt=(GT, [(99, "z", "arrow", 0.0, 0.0, 1.0, 1.0)]))}
    valves = (GT, [(s, f"{s}", "valve", 0.0, 0.0, 5.0, 5.0) for s in sorted(empty)[1:]])
    assert len(empty) > 2 and {r.sheet_id for r in run("t3_negative_tiles", image=views["image"], gt=valves)} == {min(empty)}
    boxes = {r.metric: (r.n, r.min, r.median, r.max) for r in run("m8_image_stats", **views)}["boxes"]
    assert boxes == (40, 0.0, 0.0, 3.0)


def test_every_read_is_scored(run):
    # 20 nodes, so each residue of 17 occurs; node 19 has no read, node 18 a wrong one
    lines = [(1, n, k, float(k), t, 0.9) for n in range(19) for k, t in enumerate(["PT", "1401" if n == 18 else f"{1400 + n}"])]
    views = dict(ocr_line=("sheet_id long, node_id long, line_no int, y_center double, txt string, conf double", lines),
                 gt_tag=("sheet_id long, node_id long, function string, loop string, label_status string", [(1, n, "PT", f"{1400 + n}", "ok") for n in range(20)]))
    row = {r.label_status: r for r in run("x5_exact_match", **views)}["ok"]
    assert (row.n, row.exact, row.unmatched, row.accuracy) == (20, 18, 1, 0.9)
    row = run("x4_character_errors", **views)[0]
    assert (row.edits, row.chars) == (2 + 7, 20 * 7)
