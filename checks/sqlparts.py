"""SQL fragments shared by the oracles, and oracle views for intermediate results."""

from __future__ import annotations

from checks.views import H, W, register

VALVE = "cls_id<=13"
INSTR = "cls_id IN (25,26,27,28,30)"
TYPE = f"CASE WHEN {VALVE} THEN 'valve' WHEN {INSTR} THEN 'instrument' WHEN cls_id=23 THEN 'flow_arrow' WHEN cls_id IN (29,31) THEN 'tag_rect' ELSE 'unknown_fitting' END"
FAM = f"CASE WHEN {VALVE} THEN 'valve' WHEN {INSTR} THEN 'instrument' ELSE CAST(cls_id AS VARCHAR) END"
SUPER = f"CASE WHEN {VALVE} THEN 0 WHEN cls_id=23 THEN 1 WHEN {INSTR} THEN 2 END"
GSUPER = "CASE label WHEN 'valve' THEN 0 WHEN 'arrow' THEN 1 WHEN 'instrumentation' THEN 2 END"


def inter(a, b):
    w = f"(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))"
    h = f"(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))"
    return f"(CASE WHEN {w}>0 AND {h}>0 THEN {w}*{h} ELSE 0 END)"


def box_area(a, floor="1e-9"):
    return f"greatest(({a}.x2-{a}.x1)*({a}.y2-{a}.y1),{floor})"


def iou(a, b):
    i = inter(a, b)
    return f"({i}/({box_area(a)}+{box_area(b)}-{i}))"


def d2(a, b):
    return f"(pow(({a}.x1+{a}.x2)/2-({b}.x1+{b}.x2)/2,2)+pow(({a}.y1+{a}.y2)/2-({b}.y1+{b}.y2)/2,2))"


def nms(src: str, grp: str) -> dict[str, str]:
    """Greedy suppression as a recursive walk over ranks, one state per group."""
    return {
        "nms_rank": f"SELECT *, (x1+x2)/2 AS px, (y1+y2)/2 AS py, 0.25*greatest((x2-x1)*(y2-y1),1) AS r2, row_number() OVER (PARTITION BY sheet_id, grp ORDER BY conf DESC, det_id) AS rn FROM (SELECT *, {grp} AS grp FROM {src}) q",
        "nms_walk": """SELECT sheet_id, grp, rn, det_id, true AS keep, [{'x':px,'y':py,'r':r2,'id':det_id,'c':cls_id}] AS kept, CAST(NULL AS VARCHAR) AS owner FROM nms_rank WHERE rn=1
UNION ALL SELECT sheet_id, grp, rn, det_id, len(hit)=0, CASE WHEN len(hit)=0 THEN list_append(kept, {'x':px,'y':py,'r':r2,'id':det_id,'c':cls_id}) ELSE kept END, CASE WHEN len(hit)>0 THEN hit[1].id END
FROM (SELECT r.*, n.kept AS kept, list_filter(n.kept, lambda k: (k.x-r.px)*(k.x-r.px)+(k.y-r.py)*(k.y-r.py)<k.r) AS hit
  FROM nms_walk n JOIN nms_rank r ON r.sheet_id=n.sheet_id AND r.grp=n.grp AND r.rn=n.rn+1) q""",
    }


def serial(cand: str, turn: str, want: str, a: str, b: str, keys: str = "sheet_id, label") -> dict[str, str]:
    """Turn-taking matching as a recursive walk: `cand` has keys, a, b and the sort columns."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"s.{k}=t.{k}" for k in ks)
    return {
        "s_turn": f"SELECT {keys}, {a}, list({b} ORDER BY {want}, {b}) AS wish, row_number() OVER (PARTITION BY {keys} ORDER BY {turn}, {a}) AS rn FROM {cand} GROUP BY {keys}, {a}{', '+turn.replace(' DESC','') if turn!='0' else ''}",
        "s_walk": f"""SELECT {keys}, rn, {a}, wish[1] AS {b}, [wish[1]] AS used FROM s_turn WHERE rn=1
UNION ALL SELECT {keys}, rn, {a}, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
 SELECT {', '.join('t.'+k for k in ks)}, t.rn, t.{a}, s.used AS used, list_filter(t.wish, lambda w: NOT list_contains(s.used, w))[1] AS pick FROM s_walk s JOIN s_turn t ON {same} AND t.rn=s.rn+1) q""",
        "s_match": f"SELECT {keys}, {a}, {b} FROM s_walk WHERE {b} IS NOT NULL",
    }


# kept boxes after family suppression of everything, and the numbered node set
for _n, _b in nms("det", FAM).items():
    register(_n, "", _b)
register("kept", "", "SELECT d.* FROM det d JOIN nms_walk n ON n.det_id=d.det_id AND n.sheet_id=d.sheet_id WHERE n.keep")
register("node", "", f"SELECT *, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY {FAM}, conf DESC, det_id)-1 AS BIGINT) AS node_id, {TYPE} AS node_type FROM kept")
