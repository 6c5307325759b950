"""Tunable defaults and the class taxonomy.

Everything under "fixed values" has to equal the published settings for results to match; the values are stated plainly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# --- fixed values: class taxonomy -------------------------------------------------------------------------------
CLASS_NAMES = {
    0: "Symbol_1", 1: "Symbol_2", 2: "Symbol_3", 3: "Symbol_4", 4: "Symbol_5", 5: "angle_valve",
    6: "valve_handwheel", 7: "check_valve", 8: "Symbol_9", 9: "Symbol_10", 10: "Symbol_11", 11: "Symbol_12",
    12: "Symbol_13", 13: "control_valve_diaphragm", 14: "Symbol_15", 15: "Symbol_16", 16: "Symbol_17",
    17: "Symbol_18", 18: "Symbol_19", 19: "reducer", 20: "Symbol_21", 21: "strainer", 22: "heat_exchanger",
    23: "flow_arrow", 24: "Symbol_25", 25: "instrument_bubble", 26: "instrument_bubble_RO10",
    27: "instrument_bubble_SDL", 28: "instrument_bubble_DDL", 29: "tag_rectangle_simple", 30: "Symbol_31",
    31: "tag_rectangle_multiline",
}
VALVE_CLASSES = list(range(14))
ARROW_CLASSES = [23]
INSTRUMENT_CLASSES = [25, 26, 27, 28, 30]
TAG_RECT_CLASSES = [29, 31]
AMBIGUOUS_VALVE_CLASSES = [14, 15, 16, 17, 18, 24]
SUPERCATEGORIES = {0: "valve", 1: "arrow", 2: "instrument"}
SCORED_LABELS = {"valve": 0, "arrow": 1, "instrumentation": 2}
IGNORED_LABELS = ["tank", "pump", "general", "inlet/outlet"]
NODE_TO_LABEL = {"valve": "valve", "instrument": "instrumentation"}
EDGE_TYPE_NAMES = {-1: "short_gap", 0: "direct", 1: "tip_to_junction", 2: "junction_to_junction", 3: "cycle"}
TRACED_EDGE_TYPES = ["direct", "tip_to_junction", "junction_to_junction"]
READ_OK = ["ok", "ok_placeholder", "single_line_split", "single_line_unsplit"]
CONFIDENT = ["ok", "ok_placeholder"]
PORT_LIMITS = {"valve": (0, 4), "instrument": (0, 4), "unknown_fitting": (0, 6), "off_page": (0, 2), "vessel": (0, 15)}
AP_THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
# --- end of fixed values ----------------------------------------------------------------------------------------

BOX = ["x1", "y1", "x2", "y2"]


@dataclass(frozen=True)
class SheetParams:
    """Drawing-to-graph settings."""

    roi_border_margin_frac: float = 0.04
    nms_centroid_frac: float = 0.5
    erase_dilation_px: int = 3
    vessel_erase_dilation_px: int = 12
    min_branch_len_px: float = 15.0
    endpoint_bind_extra_px: int = 5
    off_page_border_px: int = 30
    junction_radius_px: float = 10.0
    cluster_radius_px: int = 3
    collinear_angle_tol: float = 30.0
    min_crossing_gap: float = 5.0
    max_crossing_gap: float = 110.0
    min_gap_px: int = 4
    overpass_radius_px: float = 15.0
    elbow_angle_min: float = 20.0
    gap_fraction: float = 0.5
    probe_len: int = 12
    mask_all_nodes: bool = True
    mask_all_nodes_fallback: bool = False
    short_gap_max_px: float = 50.0
    short_gap_interpose_tol_px: float = 20.0
    corridor_half_width_px: float = 10.0
    corridor_continuity_frac: float = 0.5
    corridor_perp_reject_ratio: float = 3.0
    touch_margin_px: int = 10
    stub_angle_tol_deg: float = 55.0
    contraction_collinear_tol_deg: float = 28.0
    arrow_max_dist_px: float = 200.0


@dataclass(frozen=True)
class TagParams:
    """Tag reading settings."""

    crop_padding_px: int = 6
    function_regex: str = r"^[A-Z]{1,5}$"
    loop_regex: str = r"^\d{2,6}[A-Z]{0,2}$"
    placeholder_regex: str = r"^X{2,6}$"
    single_line_regex: str = r"^([A-Z]{1,5})[\s\-]?(\d{2,6}[A-Z]{0,2}|X{2,6})$"


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """A small fixed mapping as one CASE expression."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(default)
