"""Mechanical checks of answered questions against the lookups made for them.

turns(turn_id, sheet_id, question, answer); calls(turn_id, seq, name, args map<string,string>, result json text). All checks
work on rows and joins by turn, so a turn with very many calls is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheetgraph.functions.geometry import n_rows
from sheetgraph import params as P
from sheetgraph.functions import text
from sheetgraph.operators import lookup
from sheetgraph.operators.suppress import SHEET

LISTING = "instrument_tags array<struct<function:string,loop_number:string,raw_text:string>>, off_page_connectors array<string>"
QUERYING = ["find_nodes", "count_nodes"]


def _ids(d: DataFrame, col) -> DataFrame:
    return d.select("turn_id", F.explode(text.ids_in(col)).alias("id"))


def uncited_ids(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """Ids an answer states that came neither from its question nor from any call of the turn."""
    args = F.array_join(F.map_values("args"), " ")
    known = _ids(turns, F.col("question")).unionByName(_ids(calls, F.concat_ws(" ", args, "result")))
    return _ids(turns, F.col("answer")).distinct().join(known, ["turn_id", "id"], "left_anti")


def listed_values(calls: DataFrame) -> DataFrame:
    """Every text a tag listing of the turn returned."""
    d = calls.filter("name = 'list_systems_or_lines'").select("turn_id", F.from_json("result", LISTING).alias("l"))
    parts = F.flatten(F.transform("l.instrument_tags", lambda t: F.array(t["function"], t["loop_number"], t["raw_text"])))
    both = F.concat(F.coalesce(parts, F.array().cast("array<string>")), F.coalesce("l.off_page_connectors", F.array().cast("array<string>")))
    return d.select("turn_id", F.explode(both).alias("listed")).filter("length(listed) > 0").distinct()


def ungrounded_queries(calls: DataFrame) -> DataFrame:
    """Tag arguments that no listing of the turn contains; order within the turn does not matter."""
    q = calls.filter(F.col("name").isin(QUERYING)).select("turn_id", "seq", "name", F.explode("args").alias("arg", "value"))
    listed = listed_values(calls)
    fn = q.filter("arg = 'tag_function'").join(listed.withColumnRenamed("listed", "value"), ["turn_id", "value"], "left_anti")
    part = q.filter("arg = 'tag_contains'").alias("q").join(listed.alias("l"), (F.col("q.turn_id") == F.col("l.turn_id")) & F.contains(F.lower("l.listed"), F.lower("q.value")), "left_anti")
    return fn.unionByName(part)


def expected_filters(turns: DataFrame, nodes: DataFrame, keys=SHEET) -> DataFrame:
    """Filters a question plainly sets; an axis with no or several candidates stays NULL."""
    keys = list(keys)
    words = turns.select("turn_id", *keys, F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit(text.WORD_PATTERN), F.lit(0)))).alias("word"))
    types = words.select("turn_id", F.lit("node_type").alias("axis"), P.lookup(text.NODE_TYPE_WORDS, F.lower("word")).alias("value")).filter("value is not null")
    vocab = nodes.select(*keys, F.explode(F.array(F.struct(F.lit("cls_name").alias("axis"), F.col("cls_name").alias("word")),
                                                  F.struct(F.lit("tag_function").alias("axis"), F.col("tag_function").alias("word")))).alias("w")).select(*keys, "w.*")
    vocab = vocab.filter("length(word) > 0").distinct()
    named = words.join(vocab, [*keys, "word"]).select("turn_id", "axis", F.col("word").alias("value"))
    one = types.unionByName(named).groupBy("turn_id", "axis").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo = hi")
    wide = one.groupBy("turn_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("lo"))).alias("exp_" + a) for a in ("node_type", "cls_name", "tag_function")])
    quoted = F.regexp_extract_all("question", F.lit(text.QUOTED_PATTERN), F.lit(1))
    q = turns.select("turn_id", *keys, F.when(F.size(quoted) == 1, quoted[0]).alias("exp_tag_contains"))
    return q.join(wide, ["turn_id"], "left")


def incomplete_filters(filters: DataFrame, calls: DataFrame) -> DataFrame:
    """Turns whose question names a class but no single query combined it with the other filters the question sets."""
    f = filters.filter("exp_cls_name is not null")
    c = calls.filter(F.col("name").isin(QUERYING)).select("turn_id", *[F.try_element_at("args", F.lit(a)).alias(a) for a in ("cls_name", "tag_function", "tag_contains")])
    d = f.join(c, "turn_id")
    ok = (F.col("cls_name") == F.col("exp_cls_name")) & (F.col("exp_tag_function").isNull() | (F.col("tag_function") == F.col("exp_tag_function")))\
        & (F.col("exp_tag_contains").isNull() | F.contains(F.lower(F.coalesce("tag_contains", F.lit(""))), F.lower("exp_tag_contains")))
    return f.join(d.filter(ok).select("turn_id").distinct(), ["turn_id"], "left_anti")


def intent(turns: DataFrame) -> DataFrame:
    """traversal and judgement questions are declined before any lookup; the rest are lookups."""
    q = F.col("question")
    return turns.withColumn("intent", F.when(q.rlike(text.TRAVERSAL_PATTERN), "traversal").when(q.rlike(text.JUDGEMENT_PATTERN), "judgement").otherwise("lookup"))


def verdicts_given(turns: DataFrame) -> DataFrame:
    """Judgement questions answered with a verdict word."""
    d = turns.filter(F.col("question").rlike(text.JUDGEMENT_PATTERN))
    return d.select("turn_id", F.regexp_extract("answer", text.VERDICT_PATTERN, 0).alias("word")).filter("length(word) > 0")


def violations(turns: DataFrame, calls: DataFrame, nodes: DataFrame, keys=SHEET) -> DataFrame:
    """All findings as rows (turn_id, kind, detail)."""
    row = lambda d, k, v: d.select("turn_id", F.lit(k).alias("kind"), v.alias("detail"))
    return (
        row(uncited_ids(turns, calls), "uncited_id", F.col("id"))
        .unionByName(row(ungrounded_queries(calls), "ungrounded_query", F.concat("name", F.lit("("), "arg", F.lit("="), "value", F.lit(")"))))
        .unionByName(row(incomplete_filters(expected_filters(turns, nodes, keys), calls), "incomplete_filter", F.col("exp_cls_name")))
        .unionByName(row(verdicts_given(turns), "verdict", F.lower("word")))
    )


def grounding(turns: DataFrame, calls: DataFrame, nodes: DataFrame, keys=SHEET) -> DataFrame:
    """Verdict per turn with the number of findings of each kind."""
    v = violations(turns, calls, nodes, keys)
    n = v.groupBy("turn_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("uncited_id", "ungrounded_query", "incomplete_filter", "verdict")])
    d = turns.select("turn_id").join(n, ["turn_id"], "left").fillna(0)
    return d.withColumn("ok", (F.col("uncited_id") + F.col("ungrounded_query") + F.col("incomplete_filter") + F.col("verdict") == 0).cast("int"))


def refusal_facts(turns: DataFrame, nodes: DataFrame, edges: DataFrame, keys=SHEET) -> DataFrame:
    """Facts handed over with a refusal: direct neighbours of the ids a traversal question names; the type breakdown for a
    judgement, with all tags if it is about instruments."""
    keys = list(keys)
    t = intent(turns)
    ids = t.filter("intent = 'traversal'").select("turn_id", *keys, F.explode(F.array_distinct(text.ids_in(F.col("question")))).alias("id"))
    near = lookup.get_neighbors(nodes, edges, ids, keys)
    near = near.select("turn_id", F.lit("neighbour").alias("fact"), "id", F.coalesce("neighbor_id", "error").alias("detail"), F.col("provenance").alias("note"))
    j = t.filter("intent = 'judgement'").select("turn_id", *keys, F.contains(F.lower("question"), F.lit("instrument")).alias("about"))
    per = nodes.groupBy(*keys, "node_type").agg(n_rows().alias("n"))
    counts = j.join(per, keys).select("turn_id", F.lit("count").alias("fact"), F.col("node_type").alias("id"), F.col("n").cast("string").alias("detail"), F.lit(None).cast("string").alias("note"))
    tags = j.filter("about").join(lookup.list_tags(nodes, keys).filter("kind = 'instrument_tag'"), keys)
    tags = tags.select("turn_id", F.lit("tag").alias("fact"), "id", F.col("raw_text").alias("detail"), F.col("tag_function").alias("note"))
    return near.unionByName(counts).unionByName(tags)


def score(questions: DataFrame, calls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pass or fail per question (turn_id, kind, tool, match map of arguments, expected text).

    The last call of the tool whose arguments include the match decides; refusals pass when the grounding is clean.
    """
    q = questions.alias("q")
    hit = q.filter("kind <> 'refusal_required'").join(calls.alias("c"), (F.col("q.turn_id") == F.col("c.turn_id")) & (F.col("q.tool") == F.col("c.name")))
    want = F.map_entries("q.match")
    same = F.forall(want, lambda e: F.coalesce(F.try_element_at("c.args", e["key"]) == e["value"], F.lit(False)))
    last = hit.filter(same).groupBy(F.col("q.turn_id").alias("turn_id")).agg(F.max_by("c.result", "c.seq").alias("actual"))
    d = questions.join(last, ["turn_id"], "left").join(verdicts.select("turn_id", "ok"), ["turn_id"], "left")
    good = F.when(F.col("ok") == 0, False).when(F.col("kind") == "refusal_required", True).otherwise(F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))
    return d.withColumn("passed", F.coalesce(good, F.lit(False)).cast("int"))


def report(scored: DataFrame, calls: DataFrame) -> DataFrame:
    """Pass totals overall, by kind and by every tool a turn used, with the gates (refusals and not_found 100%, all 90%)."""
    used = calls.select("turn_id", F.col("name").alias("used")).distinct()
    tot = lambda d, by, name: d.groupBy(*by).agg(n_rows().alias("n"), F.sum("passed").alias("n_passed")).select(F.lit(name).alias("axis"), (F.col(by[0]) if by else F.lit("all")).alias("value"), "n", "n_passed")
    out = tot(scored, [], "overall").unionByName(tot(scored, ["kind"], "kind")).unionByName(tot(scored.join(used, "turn_id"), ["used"], "tool"))
    share = F.col("n_passed") / F.col("n")
    gate = F.when(F.col("axis") == "overall", share >= 0.9).when((F.col("axis") == "kind") & F.col("value").isin("not_found", "refusal_required"), share == 1)
    return out.withColumn("gate", gate.cast("int"))
