"""From a question to its answer over tables: selections with deadlines, lookups, comparisons, searches, recorded plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jangbu.functions.columns import display
from jangbu.operators import selection
from jangbu.plans.parse import parse

#: What a recorded plan may do, its ways of answering, and the most tools one question may use.
ACTIONS = ("selection", "table_lookup", "comparison", "vector_search", "clarify")
MOST_TOOLS = 3
#: Routes that use no search, so that retrieval is not measured on them.
NO_SEARCH = ("select", "compare", "extract", "help", "greeting", "clarify")
#: Documents shown of an answer that may hold more.
SHOWN = 5


# Projections


def field_evidence(status: Column, normalised: Column, raw: Column) -> Column:
    """How a cell is put in an answer: its value, both values of a conflict, or what its status says; never the text of a cell without value."""
    value = display(normalised, raw)
    return (
        F.when(status == "value_present", F.coalesce(value, F.lit("(빈 값)")))
        .when(status == "conflict", F.concat(F.lit("문서 안에서 서로 다름: "), F.coalesce(F.trim(raw), F.lit(""))))
        .when(status == "field_absent", "문서에 기재 없음")
        .when(status == "external_reference", "별도 문서 참조")
        .when(status == "not_disclosed", "비공개")
        .otherwise("확인 필요")
    )


def deadline_state(deadline: Column, reference: Column) -> Column:
    """``open`` at or after the reference time, ``expired`` before it, ``unknown`` without a deadline; the clock is never asked."""
    return F.when(deadline.isNull(), "unknown").when(deadline >= reference, "open").otherwise("expired")


def deadline_evidence(records: DataFrame, reference: str, deadline: str = "deadline") -> DataFrame:
    """``records`` with ``state`` and ``wording`` of their deadline against the reference time."""
    ref = F.lit(reference).cast("timestamp_ntz")
    s = deadline_state(F.col(deadline), ref)
    days = F.datediff(F.col(deadline).cast("date"), ref.cast("date"))
    wording = F.when(s == "unknown", "마감일 미상, 확인 필요").when(s == "expired", F.concat(F.lit("마감 "), F.date_format(deadline, "yyyy-MM-dd HH:mm"))).otherwise(F.concat(F.lit("D-"), days.cast("string"), F.lit(" ("), F.date_format(deadline, "yyyy-MM-dd HH:mm"), F.lit(")")))
    return records.withColumns({"state": s, "wording": wording})


def keep_open(selected: DataFrame, deadlines: DataFrame, reference: str, applies: bool = True) -> tuple[DataFrame, DataFrame]:
    """Selected documents whose deadline (``document_id, deadline``) has not passed or is unknown, and the unknown ones as notes; all of them and no notes where the filter does not apply to the task."""
    if not applies:
        return selected, selected.select("document_id").limit(0)
    j = selected.join(deadlines.groupBy("document_id").agg(F.max("deadline").alias("deadline")), "document_id", "left")
    ok = F.col("deadline") >= F.lit(reference).cast("timestamp_ntz")
    return j.where(F.coalesce(ok, F.lit(True))).drop("deadline"), j.where(ok.isNull()).select("document_id")


def context_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks that may stand in an answer's context: retrievable, of a retrievable document, no degraded table, with text."""
    ok = F.coalesce(F.col("retrieval_eligible"), F.lit(False)) & ~F.coalesce(F.col("table_degraded"), F.lit(False)) & (F.trim(F.coalesce(F.col("text"), F.lit(""))) != "")
    return chunks.where(ok).join(documents, "document_id", "left_semi")


#: Columns of an index's records by the chunk columns they are taken from; those that must not be null.
CHUNK_COLUMNS = {"chunk_id": "chunk_id", "document_id": "document_id", "section": "section_path", "label": "location_label", "kind": "block_type", "line": "md_line_start", "line_end": "md_line_end", "content": "text"}
REQUIRED = ("chunk_id", "document_id", "content")


def mapped_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks under the names an index uses, and one row with how many lack each required column."""
    out = chunks.select(*(F.col(old).alias(new) for new, old in CHUNK_COLUMNS.items()))
    return out, out.agg(*(F.count_if(F.col(c).isNull()).alias(f"n_without_{c}") for c in REQUIRED))


#: The keys of a response as it is handed out.
RESPONSE_KEYS = ("id", "answer", "structured_answer", "contexts", "retrieved", "reranked", "citations", "selected_document_ids", "abstained", "route", "failure", "latency_ms")


def as_responses(answers: DataFrame) -> DataFrame:
    """Answers under exactly the twelve keys of a response, in order; a key the answers do not have is null."""
    return answers.select(*(F.col(k) if k in answers.columns else F.lit(None).cast("string").alias(k) for k in RESPONSE_KEYS))


def searched(rows: DataFrame, route: str = "route") -> DataFrame:
    """Rows whose route used the search; others are no case for retrieval metrics."""
    return rows.where(~F.coalesce(F.lower(F.trim(route)), F.lit("")).isin(*NO_SEARCH))


def response_problems() -> Column:
    """Messages on a response (``id, answer, abstained, n_evidence``): id missing or of a wrong form, no statement on abstention, an answer without text or evidence, personal data."""
    pii = r"[0-9]{6}-[1-4][0-9]{6}|01[016789]-?[0-9]{3,4}-?[0-9]{4}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    answered = ~F.coalesce(F.col("abstained"), F.lit(False))
    said = (
        F.when(F.col("id").isNull(), "no_id"),
        F.when(F.col("id").isNotNull() & ~F.col("id").rlike(r"^(SEL|EXT|QA)-\d{2}-\d{4,}$"), "bad_id"),
        F.when(F.col("abstained").isNull(), "no_abstained"),
        F.when(answered & (F.trim(F.coalesce("answer", F.lit(""))) == ""), "no_answer"),
        F.when(answered & (F.col("n_evidence") == 0), "no_evidence"),
        F.when(F.coalesce("answer", F.lit("")).rlike(pii), "personal_data"),
    )
    return F.filter(F.array(*said), lambda x: x.isNotNull())


# Selections


def answer_selection(question: str, rows: DataFrame, documents: DataFrame, deadlines: DataFrame | None = None, reference: str = "2024-06-01") -> DataFrame:
    """``document_id, verdict, cells, note`` of a question in words: parsed, all conditions evaluated over all documents in scope, then the deadline.

    Nothing is cut in between.  ``cells`` puts every field asked for as evidence;
    ``note`` marks unknown deadlines.  A question that was not understood whole
    selects nothing.
    """
    p = parse(question)
    empty = rows.select("document_id", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("cells"), F.lit(None).cast("string").alias("note")).limit(0)
    if not p.executable:
        return empty
    chosen = selection.verdicts(rows, p.conditions, documents)
    notes = None
    if deadlines is not None:
        chosen, notes = keep_open(chosen, deadlines, reference)
    fields = list(dict.fromkeys(c.field for c in p.conditions))
    shown = selection.current_cells(rows.where(F.col("field_name").isin(*fields))).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field_name", field_evidence(F.col("status"), F.col("answer_normalized"), F.col("answer_raw"))))), "; ").alias("cells"))
    out = chosen.join(shown, "document_id", "left")
    if notes is None:
        return out.select("document_id", "verdict", "cells", F.lit(None).cast("string").alias("note"))
    return out.join(notes.withColumn("note", F.lit("마감일 미상")), "document_id", "left").select("document_id", "verdict", "cells", "note")


def observation(selected: DataFrame, key: list[str], shown: int = SHOWN) -> DataFrame:
    """Per ``key``: counts of the verdicts, the outcome, and the first ``shown`` confirmed ids; the result itself is never cut."""
    c, u = F.count_if(F.col("verdict") == "confirmed"), F.count_if(F.col("verdict") == "undetermined")
    n = selected.groupBy(*key).agg(c.alias("n_confirmed"), u.alias("n_undetermined"))
    w = Window.partitionBy(*key).orderBy("document_id")
    first = selected.where("verdict = 'confirmed'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("document_id")), ",").alias("shown"))
    outcome = F.when((F.col("n_confirmed") > 0) & (F.col("n_undetermined") == 0), "matched").when(F.col("n_confirmed") > 0, "partial").when(F.col("n_undetermined") > 0, "undetermined_only").otherwise("empty")
    return n.join(first, key, "left").select(*key, "n_confirmed", "n_undetermined", outcome.alias("outcome"), F.coalesce("shown", F.lit("")).alias("shown"), (F.col("n_confirmed") > shown).alias("more"))


def limited(selected: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` documents by id, after everything was evaluated, and one row with the whole number of them."""
    total = selected.agg(F.count("*").alias("total"))
    return (selected if most is None else selected.orderBy("document_id").limit(most)), total


# Lookups and comparisons


def look_up(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``asked`` (``document_id, field_name`` and more) with ``status, shown`` of the current cell; ``missing`` without one."""
    cells = selection.current_cells(rows).select("document_id", "field_name", "status", field_evidence(F.col("status"), F.col("answer_normalized"), F.col("answer_raw")).alias("shown"))
    return asked.join(cells, ["document_id", "field_name"], "left").withColumns({"status": F.coalesce("status", F.lit("missing")), "shown": F.coalesce("shown", F.lit("추출표에 없음"))})


def compared(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """Comparisons (``question_id, document_ids``): targets in scope, and why one cannot run: fewer than two documents, or one that is unknown or out of scope."""
    e = asked.select("question_id", F.explode_outer(F.array_distinct(F.coalesce("document_ids", F.array().cast("array<string>")))).alias("document_id"))
    known = documents.select("document_id").distinct().withColumn("_k", F.lit(True))
    j = e.join(known, "document_id", "left").groupBy("question_id").agg(F.count("document_id").alias("n_asked"), F.count("_k").alias("n_in_scope"))
    return j.withColumn("blocked", F.when(F.col("n_asked") < 2, "too_few").when(F.col("n_in_scope") < F.col("n_asked"), "out_of_scope"))


# Recorded plans


def signature(plan: str = "approved_plan") -> Column:
    """What a plan comes to, whatever the order of its lists and the blanks of its query: equal plans have equal signatures."""
    p = F.col(plan)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))), ",")
    text = F.regexp_replace(F.trim(F.coalesce(p["search_query"], F.lit(""))), r"\s+", " ")
    return F.sha2(F.concat_ws("|", F.coalesce(p["action"], F.lit("")), F.coalesce(p["answer_mode"], F.lit("")), F.coalesce(p["document_scope"], F.lit("")), joined(p["document_ids"]), joined(p["requested_fields"]), text), 256)


PLAN = "action string, answer_mode string, document_scope string, document_ids array<string>, requested_fields array<string>, search_query string"


def decision_problems(text: Column) -> Column:
    """What is wrong with a decision as JSON: not readable, an unknown action, a missing scope or mode, named documents without ids, a search without a query; nothing is executed in part."""
    p = F.from_json(text, PLAN)
    said = (
        F.when(text.isNull() | p.isNull() | ~F.coalesce(F.trim(text).startswith("{"), F.lit(False)), "unreadable"),
        F.when(p["action"].isNull(), "no_action").when(~p["action"].isin(*ACTIONS), "unknown_action"),
        F.when(p["document_scope"].isNull(), "no_scope"),
        F.when(p["answer_mode"].isNull(), "no_mode"),
        F.when((p["document_scope"] == "specific_documents") & (F.coalesce(F.size(F.filter(p["document_ids"], lambda x: x.isNotNull())), F.lit(0)) <= 0), "no_documents"),
        F.when((p["action"] == "vector_search") & (F.trim(F.coalesce(p["search_query"], F.lit(""))) == ""), "no_query"),
    )
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def verification_problems(text: Column) -> Column:
    """What is wrong with a verification as JSON (``approved, issues``): unreadable, no verdict, an approval with issues, a refusal without any."""
    v = F.from_json(text, "approved boolean, issues array<string>")
    n = F.coalesce(F.size(v["issues"]), F.lit(0))
    said = (F.when(text.isNull() | v.isNull() | ~F.coalesce(F.trim(text).startswith("{"), F.lit(False)), "unreadable"), F.when(v["approved"].isNull(), "no_verdict"), F.when(v["approved"] & (n > 0), "approved_with_issues"), F.when(~v["approved"] & (n <= 0), "refused_without_issue"))
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def loops(decisions: DataFrame, key: str, order: list[str], signature_column: str, final: Column) -> DataFrame:
    """Per ``key`` the outcome of a bounded loop over its decisions in order: ``repeated`` if a call came twice, ``answered`` at a final decision, ``exhausted`` after ``MOST_TOOLS``, else ``open``; with the number of tools used."""
    w = Window.partitionBy(key).orderBy(*order)
    first = Window.partitionBy(key, signature_column).orderBy(*order)
    d = decisions.withColumns({"step": F.row_number().over(w), "again": F.row_number().over(first) > 1, "final": F.coalesce(final, F.lit(False))}).where(F.col("step") <= MOST_TOOLS + 1)
    g = d.groupBy(key).agg(F.min(F.when(F.col("again"), F.col("step"))).alias("repeat_at"), F.min(F.when(F.col("final"), F.col("step"))).alias("final_at"), F.max("step").alias("steps"))
    stop = F.least(F.coalesce("repeat_at", F.lit(99)), F.coalesce("final_at", F.lit(99)))
    outcome = F.when((F.col("repeat_at") == stop) & (stop <= MOST_TOOLS), "repeated").when((F.col("final_at") == stop) & (stop <= MOST_TOOLS + 1), "answered").when(F.col("steps") > MOST_TOOLS, "exhausted").otherwise("open")
    return g.select(key, outcome.alias("outcome"), F.least(F.coalesce(F.nullif(stop, F.lit(99)) - 1, F.col("steps")), F.lit(MOST_TOOLS)).alias("tools"))


def assigned(pools: DataFrame, order: list[str], candidate: str = "document_id") -> DataFrame:
    """``pool, document_id``: every pool of ``order`` takes its first candidate that no pool before it took.

    A pool needs at most as many candidates as there are pools, so only so many of
    each reach the driver.
    """
    w = Window.partitionBy("pool").orderBy(candidate)
    few = pools.where(F.col("pool").isin(*order)).select("pool", candidate).distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= len(order)).collect()  # at most len(order) squared
    by: dict[str, list[str]] = {}
    for r in sorted(few, key=lambda r: r.k):
        by.setdefault(r.pool, []).append(r[candidate])
    used: set[str] = set()
    out = []
    for pool in order:
        pick = next((c for c in by.get(pool, []) if c not in used), None)
        used |= {pick} - {None}
        out.append((pool, pick))
    return pools.sparkSession.createDataFrame(out, f"pool string, {candidate} string")


def fast_path(parsed: Column, leftover: Column, named_documents: Column) -> Column:
    """Why a question is not answered by rule alone, null if it is: not a selection, not understood whole, alternatives, wording nothing was made of, or a document named beside the conditions."""
    return F.when(~parsed["selection"], "no_selection").when(parsed["alternative"], "alternative").when(~parsed["executable"], "not_understood").when(named_documents > 0, "names_documents").when(F.length(leftover) > 0, "leftover")


# Prompts, batches


def grounded_prompt(question: Column, sources: Column) -> Column:
    """A question with its evidence (``ARRAY<STRUCT<source, text>>``) numbered from 1, as it is put to a model."""
    numbered = F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(s["source"], F.lit("")), F.lit("\n"), F.coalesce(s["text"], F.lit(""))))
    return F.concat(F.lit("질문: "), question, F.lit("\n\n"), F.array_join(numbered, "\n\n"))


def batches(rows: DataFrame, key: str, size: int = 100) -> DataFrame:
    """``key, batch, place``: rows in batches of at most ``size`` for a service that takes so many at once.

    Rows are dealt to hash buckets of about ``size`` and cut within them, so that
    no task sees all rows.
    """
    n = max(1, rows.count() // size)
    b = rows.select(key, F.pmod(F.xxhash64(key), F.lit(n)).alias("bucket"))
    r = F.row_number().over(Window.partitionBy("bucket").orderBy(key)) - 1
    return b.withColumn("r", r).select(key, F.concat_ws("-", "bucket", F.floor(F.col("r") / size)).alias("batch"), (F.col("r") % size).cast("int").alias("place"))

