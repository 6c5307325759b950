"""String expressions: identifiers, tag parsing and display, question patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sheetgraph import params as P

# --- fixed values: patterns and word lists ------------------------------------------------------------------------
ID_PATTERN = r"\b(?:sym|junc)_\d+\b"
WORD_PATTERN = r"[A-Za-z][A-Za-z0-9_]*"
QUOTED_PATTERN = r"""['"]([^'"]+)['"]"""
NODE_TYPE_WORDS = {
    "valve": "valve", "valves": "valve", "instrument": "instrument", "instruments": "instrument", "vessel": "vessel",
    "vessels": "vessel", "flow_arrow": "flow_arrow", "flow_arrows": "flow_arrow", "off_page": "off_page",
    "off-page": "off_page", "unknown_fitting": "unknown_fitting", "unknown_fittings": "unknown_fitting",
}
NODE_TYPES = ["valve", "instrument", "unknown_fitting", "flow_arrow", "off_page", "vessel"]
JUDGEMENT_PATTERN = (
    r"(?i)\bwell[- ]instrumented\b|\bwell[- ]designed\b|\bgood design\b|\bpoorly (?:instrumented|designed)\b|"
    r"\bmost (?:important|critical)\b|\b(?:over|under)[- ]instrumented\b|\bbest practice\b|"
    r"\b(?:is|are|does|do)\b.{0,60}\b(?:safe|adequate|sufficient|efficient|reliable|robust|risky|"
    r"well[- ]designed|well[- ]instrumented|good design|properly (?:designed|instrumented))\b"
)
VERDICT_PATTERN = (
    r"(?i)\b(?:modest|adequate|inadequate|sufficient|insufficient|excellent|poor|poorly|"
    r"well[- ]instrumented|well[- ]designed|under[- ]instrumented|over[- ]instrumented|"
    r"robust|fragile|reliable|unreliable|efficient|inefficient|optimal|suboptimal|"
    r"safe|unsafe|risky|critical|(?:most|least) important|strong design|weak design)\b"
)
TRAVERSAL_PATTERN = (
    r"(?i)\btrace\b|\bshortest path\b|\bpath\b|\broute\b|\bdownstream of\b|\bupstream of\b|"
    r"\bwould stop flowing\b|\bwere closed\b|\bwere shut\b"
)
PLACEHOLDER_CLASS = r"^Symbol_\d+$"
# --- end of fixed values ----------------------------------------------------------------------------------------


def ids_in(text: Column) -> Column:
    """All vertex ids mentioned in a text."""
    return F.regexp_extract_all(text, F.lit(ID_PATTERN), F.lit(0))


def id_order(node_id: Column) -> list[Column]:
    """Sort keys that put sym_9 before sym_10; ids without a number go first within their prefix."""
    numbered = node_id.rlike(r"_\d+$")
    prefix = F.when(node_id.contains("_"), F.regexp_replace(node_id, r"_[^_]*$", "")).otherwise("")
    return [prefix, F.when(numbered, F.regexp_extract(node_id, r"_(\d+)$", 1).cast("bigint")).otherwise(F.lit(-1))]


def tag_summary(function: Column, loop: Column) -> Column:
    ok = (F.length(function) > 0) & (F.length(loop) > 0)
    return F.when(ok, F.concat_ws("-", function, loop))


def tag_display(function: Column, loop: Column, raw: Column, status: Column) -> Column:
    """What the drawing shows next to an instrument: the tag if read with confidence, else a question mark."""
    full = F.trim(F.concat(F.coalesce(function, F.lit("")), F.lit(" "), F.coalesce(loop, F.lit(""))))
    return (
        F.when(status.isin(P.CONFIDENT), full)
        .when(F.length(F.coalesce(raw, F.lit(""))) > 0, F.concat(F.lit("? "), raw)).otherwise("? (unread)")
    )


def normalised_tag(function: Column, loop: Column) -> Column:
    """Upper-cased 'F N', empty when either part is missing."""
    return F.coalesce(F.upper(F.trim(F.concat(function, F.lit(" "), loop))), F.lit(""))
