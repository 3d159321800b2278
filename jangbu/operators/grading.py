"""Recorded answers graded against evaluation items: content, form, abstention, final status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jangbu.functions import answers as A
from jangbu.functions.arrow import vectorised
from jangbu.operators.scoring import abstention, match_list, match_short, set_score

#: Answer types whose score is all or nothing, so that a status can be told from it.
BINARY = ("list", "value", "abstention")


def grade_value(gold: str | None, accepted: str | None, answer: str | None, absent: bool, abstained: bool) -> tuple[float, str]:
    """Score and reason of a single value.

    Items about what is absent go through their own gates first: of a field that
    the table marks absent the answer must say that the document does not state
    it, of a gold that says "none" that there is none; not finding out, and
    concluding more than is written, are wrong.
    """
    same = lambda x, y: bool(x) and bool(y) and A.scored(x).replace(" ", "") == A.scored(y).replace(" ", "")
    exact = same(answer, gold) or same(answer, accepted)
    none_said = A.absence(gold) == "confirmed"
    if absent or none_said:
        if abstained or not (answer or "").strip():
            return 0.0, "absence_rejected"
        kind = A.field_absence(answer) if absent else A.absence(answer)
        if kind == "not_verified":
            return 0.0, "absence_not_verified"
        if kind == "inferred":
            return 0.0, "absence_overreach"
        if exact or kind in ("stated", "confirmed"):
            return 1.0, "absence_exact" if exact else "absence_stated"
        return 0.0, "absence_unclear"
    for g in (gold, accepted):
        ok, why = match_short(g, answer)
        if ok:
            return 1.0, why
    return (1.0, "exact") if exact or same(A.without_ending(A.scored(answer)), gold) else (0.0, match_short(gold, answer)[1])


def grade_checkpoints(points: list[str], answer: str | None) -> tuple[float | None, list[str], list[str]]:
    """Share of a summary's checkpoints an answer covers, which it covers and misses; a stretch of the answer covers one point, the longest first."""
    want = [p for p in points if A.scored(p)]
    if not want:
        return None, [], []
    text, hit = f" {A.scored(answer)} ", set()
    for i in sorted(range(len(want)), key=lambda i: -len(want[i])):
        p = A.scored(want[i])
        at = text.find(p)
        if at >= 0:
            hit.add(i)
            text = text[:at] + " " * len(p) + text[at + len(p) :]
    return len(hit) / len(want), [want[i] for i in sorted(hit)], [w for i, w in enumerate(want) if i not in hit]


@vectorised("struct<score:double,why:string>", nulls=True)
def value_graded(parts: list[str | None]) -> tuple:
    gold, accepted, answer, absent, abstained = parts
    return grade_value(gold, accepted, answer, absent == "true", abstained == "true")


@vectorised("struct<score:double,covered:array<string>,missing:array<string>>", nulls=True)
def summary_graded(points: list[str] | None, answer: str | None) -> tuple:
    return grade_checkpoints(points or [], answer)


@vectorised("struct<matched:int,missing:int,extra:int>", nulls=True)
def lists_matched(gold: list[str] | None, answer: list[str] | None) -> tuple:
    return match_list([x for x in gold or [] if x], [x for x in answer or [] if x])


def absent_target(evidence: str = "evidence", document: str = "document_id") -> Column:
    """Whether an item asks for a field its table evidence marks absent throughout, in the item's own document."""
    table = F.filter(F.col(evidence), lambda e: e["kind"] == "table")
    doc = F.upper(F.trim(document))
    fits = lambda e: (F.coalesce(e["status"], F.lit("")) == "field_absent") & e["field"].isNotNull() & (F.coalesce(F.upper(F.trim(e["location"]["document"])), F.lit("?")) == F.coalesce(doc, F.upper(F.trim(e["location"]["document"])), F.lit("?!")))
    return F.coalesce((F.size(table) > 0) & F.forall(table, fits), F.lit(False))


def violations(answer_type: Column, abstained: Column, items: Column, selected: Column, answer: Column) -> Column:
    """What is wrong with a response's form: no statement on abstention, a list that is none, a comparison that is no table, a selection without ids."""
    said = (
        F.when(abstained.isNull(), "no_abstained"),
        F.when((answer_type == "list") & items.isNull(), "list_not_array"),
        F.when((answer_type == "comparison") & ~F.coalesce(answer, F.lit("")).contains("|"), "comparison_not_table"),
        F.when((answer_type == "document_set") & selected.isNull(), "selection_not_array"),
    )
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def final_status(kind: Column, score: Column, problems: Column) -> Column:
    """Form and content put together; partial scores have no border to pass, so they stay pending."""
    binary, bad = kind.isin(*BINARY), F.size(problems) > 0
    return F.when(kind == "system_failure", "FAIL-system").when(bad & binary & (score < 1), "FAIL-format+content").when(bad, "FAIL-format").when(binary & (score >= 1), "PASS").when(binary, "FAIL-content").otherwise("PENDING_THRESHOLD")


def score_items(items: DataFrame, responses: DataFrame) -> DataFrame:
    """``item_key, answer_type, task_type, field_tag, kind, score, why, problems, abstention, final_status`` of every item.

    ``responses`` (``item_key, answer, items, selected_document_ids, abstained,
    failure``) are joined to the items; an item without one stays and scores 0.
    A failed run is a system failure and is not graded, an unanswerable item by
    its abstention, any other by its answer type.
    """
    r = responses.select("item_key", "answer", F.col("items").alias("got_items"), "selected_document_ids", "abstained", "failure", F.lit(True).alias("_r"))
    j = items.join(r, "item_key", "left")
    at, did = F.col("answer_type"), F.coalesce("abstained", F.lit(False))
    gold_items = F.split(F.coalesce("answer_raw", F.lit("")), r"\s*[,;\n]\s*")
    value = value_graded(F.array("answer_raw", "answer_normalized", "answer", absent_target().cast("string"), did.cast("string")))
    # every function sees only the rows of its type
    j = j.withColumns({
        "v": F.when(at == "value", value),
        "s": summary_graded(F.when(at == "summary", gold_items), F.when(at == "summary", F.col("answer"))),
        "l": lists_matched(F.when(at == "list", gold_items), F.when(at == "list", F.col("got_items"))),
        "kind": F.when(F.col("failure").isNotNull() & (F.trim("failure") != ""), "system_failure").when(at == "unanswerable", "abstention").otherwise(at),
        "abstention": abstention(at == "unanswerable", did, F.lit(False), F.coalesce(F.col("field_tag") == "critical", F.lit(False))),
    })
    gold_docs = F.when(F.col("document_id").isNotNull() & (F.trim("document_id") != ""), F.array(F.upper(F.trim("document_id")))).otherwise(F.array().cast("array<string>"))
    kind = F.col("kind")
    score = (
        F.when(kind == "system_failure", 0.0).when(F.col("_r").isNull(), 0.0).when(kind == "abstention", (F.col("abstention") == "ok").cast("double"))
        .when(kind == "document_set", set_score(gold_docs, F.transform("selected_document_ids", lambda x: F.upper(F.trim(x))))).when(kind == "value", F.col("v.score")).when(kind == "summary", F.coalesce("s.score", F.lit(0.0)))
        .when(kind == "list", ((F.col("l.missing") == 0) & (F.col("l.extra") == 0)).cast("double")).otherwise(0.0)
    )
    problems = violations(at, F.col("abstained"), F.col("got_items"), F.col("selected_document_ids"), F.col("answer"))
    scored = j.select("item_key", "answer_type", "task_type", "field_tag", "answer_source", "kind", F.round(score, 6).alias("score"), F.col("v.why").alias("why"), problems.alias("problems"), "abstention", "failure")
    return scored.withColumn("final_status", final_status(F.col("kind"), F.col("score"), F.col("problems")))


def selection_kinds(rows: DataFrame) -> DataFrame:
    """``rows`` (``gold, got`` arrays of ids, ``gold_org, got_org`` arrays of their organisations) with ``selection``: correct, no_selection, over_selection, same_org_confusion or unrelated_doc; null without gold."""
    gold, got = F.array_distinct("gold"), F.array_distinct(F.coalesce("got", F.array().cast("array<string>")))
    hit = F.arrays_overlap(gold, got)
    kind = (
        F.when(F.coalesce(F.size(gold), F.lit(0)) <= 0, F.lit(None).cast("string")).when(hit & (F.size(F.array_except(got, gold)) == 0), "correct").when(F.size(got) == 0, "no_selection").when(hit, "over_selection")
        .when(F.coalesce(F.arrays_overlap("gold_org", "got_org"), F.lit(False)), "same_org_confusion").otherwise("unrelated_doc")
    )
    return rows.withColumn("selection", kind)


# Judges: a stub that looks for the text, a table of recorded verdicts, a cache.


def stub_verdict(claim: str, context: str) -> Column:
    """The stub's verdict: every word of the claim stands in the context, as scored."""
    words = F.filter(F.split(A.scored_text(F.col(claim)), " "), lambda w: w != "")
    text = F.split(A.scored_text(F.col(context)), " ")
    return F.size(F.array_except(words, text)) == 0


def cache_key(*inputs: Column) -> Column:
    """The key of a request: the digest of all it depends on, in order; null inputs keep their place."""
    return F.sha2(F.to_json(F.struct(*(c.cast("string").alias(f"k{i}") for i, c in enumerate(inputs))), {"ignoreNullFields": "false"}), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (with ``cache_key``) and what the cache (``cache_key, value``) holds for them: ``value`` and ``hit``; of repeated entries the greatest value counts."""
    held = cache.where("cache_key is not null").groupBy("cache_key").agg(F.max("value").alias("value"))
    return requests.join(held, "cache_key", "left").withColumn("hit", F.col("value").isNotNull())


def judged(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Requests with the recorded verdict of their key, as read from the reply; without one ``how`` is ``not_judged``."""
    v = verdicts.groupBy("cache_key").agg(F.max("reply").alias("reply"))
    r = requests.join(v, "cache_key", "left").withColumn("v", A.judged_reply("reply"))
    return r.select(*requests.columns, F.col("v.passed").alias("passed"), F.col("v.score").alias("judge_score"), F.coalesce("v.how", F.lit("not_judged")).alias("how"))
