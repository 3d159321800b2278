"""Contracts of evaluation items: every violation as a row, never a silent repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jangbu.functions.amounts import graded_amount_udf
from jangbu.functions.answers import scored_text
from jangbu.operators.locate import covering

# What members of an item may hold, and what each kind of evidence must have.
TASKS = ("selection", "extraction", "qa", "comparison")
ANSWERS = ("value", "list", "summary", "comparison", "document_set", "unanswerable")
OF_TASK = {"selection": ("document_set",), "extraction": ("value", "list"), "qa": ("value", "list", "summary", "unanswerable", "comparison"), "comparison": ("comparison",)}
KINDS = ("chunk", "table", "identity")
VALUE_LENGTH, POINT_LENGTH = 120, 40


def _held(said: tuple[Column, ...]) -> Column:
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def schema_problems() -> Column:
    """C1 of an item: members missing, values outside their set, an answer type its task does not have."""
    c = F.col
    fits = F.lit(False)
    for task, answers in OF_TASK.items():
        fits = fits | ((c("task_type") == task) & c("answer_type").isin(*answers))
    return _held((
        F.when(c("id").isNull(), "no_id"), F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "no_question"), F.when(~F.coalesce(c("task_type").isin(*TASKS), F.lit(False)), "task_type"), F.when(~F.coalesce(c("answer_type").isin(*ANSWERS), F.lit(False)), "answer_type"),
        F.when(c("task_type").isin(*TASKS) & c("answer_type").isin(*ANSWERS) & ~fits, "combination"), F.when((c("answer_type") != "unanswerable") & c("answer_raw").isNull(), "no_answer"), F.when(~F.coalesce(c("field_tag").isin("critical", "major", "minor"), F.lit(True)), "field_tag"),
    ))


def consistency_problems() -> Column:
    """S6, S7, S10, S14 of an item: no source of the answer, a fact without evidence, an answer of another shape than its type, a clarifying answer beside a factual type."""
    c = F.col
    n = F.coalesce(F.size("evidence"), F.lit(0))
    text = F.coalesce("answer_raw", F.lit(""))
    points = F.split(text, r"\s*[,;\n]\s*")
    clarifying = text.rlike(r"어느\s*(사업|공고|문서)|사업명을|무엇을\s*찾으시는|정확히\s*어떤")
    return _held((
        F.when(c("answer_source").isNull(), "S6"), F.when((c("answer_type") != "unanswerable") & (n <= 0) & c("location").isNull() & (text != ""), "S7"), F.when((c("answer_type") == "value") & (text.contains("\n") | (F.length(text) > VALUE_LENGTH)), "S10_value"),
        F.when((c("answer_type") == "list") & F.exists(points, lambda p: F.length(p) > VALUE_LENGTH), "S10_list"), F.when((c("answer_type") == "summary") & ((text == "") | F.exists(points, lambda p: F.length(p) > POINT_LENGTH)), "S10_summary"), F.when(clarifying & (c("answer_type") != "unanswerable"), "S14"),
    ))


def scope_problems(items: DataFrame, every: DataFrame, eligible: DataFrame) -> DataFrame:
    """``item_key, problem`` of S1 to S4: gold documents the registry does not hold or that are out of scope, selections without a time, evidence of other documents than the gold's, comparisons of fewer than two documents."""
    gold = items.select("item_key", "task_type", "answer_type", "created_at", F.upper(F.trim("document_id")).alias("doc"), F.array_distinct(F.filter(F.transform(F.coalesce("evidence.location.document", F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))).alias("docs"))
    gold = gold.withColumn("doc", F.nullif("doc", F.lit("")))
    known = lambda df, name: df.select(F.upper(F.trim("document_id")).alias("doc")).where("doc is not null").distinct().withColumn(name, F.lit(True))
    j = gold.join(known(every, "_e"), "doc", "left").join(known(eligible, "_s"), "doc", "left")
    c = F.col
    said = _held((
        F.when(c("doc").isNotNull() & c("_e").isNull(), "S1_unknown"), F.when((c("task_type") == "selection") & c("_e").isNotNull() & c("_s").isNull(), "S1_out_of_scope"), F.when((c("task_type") == "selection") & c("created_at").isNull(), "S2"),
        F.when(c("doc").isNotNull() & F.exists("docs", lambda x: x != c("doc")), "S3"), F.when((c("answer_type") == "comparison") & (F.size("docs") < 2), "S4"),
    ))
    return j.select("item_key", F.explode(said).alias("problem"))


def _evidence(items: DataFrame) -> DataFrame:
    """``item_key, i, kind, field, status, value, document_id, section, ref_no, line`` of every piece of evidence."""
    e = items.select("item_key", F.posexplode("evidence").alias("i", "x")).where("x is not null")
    return e.select("item_key", "i", "x.kind", "x.field", "x.status", "x.value", F.col("x.location.document").alias("document_id"), F.col("x.location.section").alias("section"), F.col("x.location.ref_no").alias("ref_no"), F.col("x.location.line").alias("line"))


def missing_evidence(items: DataFrame, cells: DataFrame, identity_fields: list[str], chunks: DataFrame) -> DataFrame:
    """``item_key, i, problem`` of S11: evidence of an unknown kind, without what its kind needs, that names a cell or a field there is not, states another status than the cell, or stands on a line no chunk covers.

    Lines meet chunks in buckets, so that a document of very many lines and chunks
    is no single group of pairs.
    """
    e = _evidence(items)
    cell = cells.select("document_id", F.col("field_name").alias("field"), F.col("status").alias("_cell"))
    lines = e.where("kind = 'chunk' and line is not null").select("item_key", "i", "document_id", "line")
    c = chunks.where("document_id is not null").select("document_id", "md_line_start", "md_line_end")
    covered = covering(lines, c, "document_id", "line", "md_line_start", "md_line_end").select("item_key", "i").distinct().withColumn("_covered", F.lit(True))
    j = e.join(cell, ["document_id", "field"], "left").join(covered, ["item_key", "i"], "left")
    k = F.coalesce("kind", F.lit("?"))
    need = (k == "table") & (F.col("document_id").isNull() | F.col("field").isNull() | F.col("status").isNull()) | (k == "identity") & (F.col("document_id").isNull() | F.col("field").isNull()) | (k == "chunk") & (F.col("document_id").isNull() | F.col("line").isNull())
    problem = (
        F.when(~k.isin(*KINDS), "unknown_kind").when(need, "incomplete").when((k == "table") & F.col("_cell").isNull(), "no_cell").when((k == "table") & (F.col("_cell") != F.col("status")), "other_status").when((k == "identity") & ~F.col("field").isin(*identity_fields), "no_identity_field")
        .when((k == "chunk") & F.col("_covered").isNull(), "no_chunk")
    )
    return j.select("item_key", F.col("i").cast("long").alias("i"), problem.alias("problem")).where("problem is not null")


def unretrievable(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """``item_key`` of S12: items whose evidence is chunks alone, all known ones of which no search can return."""
    e = _evidence(items).join(chunks.groupBy("document_id", F.col("location_label").alias("ref_no")).agg(F.bool_or("retrieval_eligible").alias("ok")), ["document_id", "ref_no"], "left")
    g = e.groupBy("item_key").agg(F.count_if(F.col("kind") != "chunk").alias("others"), F.count("ok").alias("known"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("any_ok"))
    return g.where("others = 0 and known > 0 and not any_ok").select("item_key")


def irrelevant(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """``item_key`` of S13, for review: items with a number of three digits or more in their answer that is in none of their evidence's chunks that are known."""
    number = F.transform(F.regexp_extract_all(F.coalesce("answer_raw", F.lit("")), F.lit(r"([0-9][0-9,]{2,})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    i = items.select("item_key", number.alias("numbers")).where("size(numbers) > 0")
    text = chunks.select("document_id", F.col("location_label").alias("ref_no"), F.replace(F.coalesce("text", F.lit("")), F.lit(","), F.lit("")).alias("text"))
    e = _evidence(items).where("kind = 'chunk'").select("item_key", "document_id", "ref_no").distinct().join(text, ["document_id", "ref_no"]).join(i, "item_key")
    g = e.groupBy("item_key").agg(F.bool_or(F.exists("numbers", lambda x: F.contains(F.col("text"), x))).alias("found"))
    return g.where("not found").select("item_key")


def incompatible(items: DataFrame, cells: DataFrame) -> DataFrame:
    """``item_key, i`` of S15: single values taken from the table whose amount differs from the cell's, or, without amounts, of which neither is part of the other."""
    e = _evidence(items).where("kind = 'table' and status = 'value_present'").select("item_key", "i", "document_id", "field")
    v = items.where("answer_type = 'value' and answer_source = 'table' and answer_raw is not null").select("item_key", "answer_raw")
    j = e.join(v, "item_key").join(cells.select("document_id", F.col("field_name").alias("field"), F.coalesce("answer_raw", F.lit("")).alias("cell")), ["document_id", "field"])
    j = j.withColumns({"ga": graded_amount_udf("answer_raw"), "ca": graded_amount_udf("cell"), "g": scored_text("answer_raw"), "c": scored_text("cell")})
    apart = F.when(F.col("ga").isNotNull() | F.col("ca").isNotNull(), ~F.col("ga").eqNullSafe(F.col("ca"))).otherwise(~(F.contains("g", "c") | F.contains("c", "g")))
    return j.where(apart).select("item_key", F.col("i").cast("long").alias("i"))


def leaked(items: DataFrame, texts: DataFrame, text_id: str, text: str, least: int = 12) -> DataFrame:
    """``item_key, text_id`` where an item's question or answer of ``least`` characters or more stands in a tracked text, blanks aside; met on rare n-grams, not row against row."""
    from jangbu.functions.columns import expression_key
    from jangbu.operators.resolve import contained

    said = items.select("item_key", F.explode(F.array_distinct(F.array("question", "answer_raw"))).alias("s")).select("item_key", expression_key(F.col("s")).alias("key")).where(F.length("key") >= least)
    t = texts.select(text_id, expression_key(F.col(text)).alias("_k"))
    return contained(t, said, text_id, "_k").join(said, "key").select("item_key", text_id).distinct()


def shared_with_practice(final: DataFrame, practice: DataFrame) -> DataFrame:
    """``item_key, shares`` of final items that share their id, question or document with a practice item."""
    both = None
    for name in ("id", "question", "document_id"):
        other = practice.where(F.col(name).isNotNull() & (F.trim(name) != "")).select(name).distinct()
        hit = final.join(other, name, "left_semi").select("item_key", F.lit(name).alias("shares"))
        both = hit if both is None else both.unionByName(hit)
    return both


def built_items(conditions: dict[str, tuple[str, str]], cells: DataFrame, scope: DataFrame, statuses: dict[str, tuple[str, ...]]) -> DataFrame:
    """``id, document_id, field_name, status``: a selection item per named condition, with every gold document in scope and the cell it rests on; one pass over the cells."""
    held = F.filter(F.array(*(F.when((F.col("field_name") == f) & F.col("status").isin(*statuses[op]), F.lit(name)) for name, (f, op) in conditions.items())), lambda x: x.isNotNull())
    return cells.join(scope, "document_id", "left_semi").select(F.explode(held).alias("id"), "document_id", "field_name", "status")


def provenance_problems(rows: DataFrame, axes: list[str], keys: list[str]) -> DataFrame:
    """Per ``keys``: axes with a missing value (``no_...``), axes only said to be unknown (``unknown_...``), and whether a run could be made again: all known, one value each."""
    agg = []
    for a in axes:
        agg += [F.count_if(F.col(a).isNull()).alias(f"m_{a}"), F.count_if(F.upper(F.trim(a)) == "UNKNOWN").alias(f"u_{a}"), F.countDistinct(a).alias(f"d_{a}")]
    g = rows.groupBy(*keys).agg(*agg)
    said = _held(tuple(F.when(F.col(f"m_{a}") > 0, f"no_{a}").when(F.col(f"u_{a}") > 0, f"unknown_{a}") for a in axes))
    again = F.size(said) == 0
    for a in axes:
        again = again & (F.col(f"d_{a}") == 1)
    return g.select(*keys, said.alias("problems"), again.alias("reproducible"))


def contract_report(parts: dict[str, DataFrame | None], review: tuple[str, ...] = (), final: bool = False) -> DataFrame:
    """``name, n, state`` of every contract: PASS, FAIL or, for those only people decide, REVIEW; one whose asset is missing (None) is SKIP, in the final mode FAIL."""
    out = None
    for name, df in parts.items():
        if df is None:
            continue
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    spark = next(df for df in parts.values() if df is not None).sparkSession
    gone = spark.createDataFrame([(k, None) for k, v in parts.items() if v is None], "name string, n long")
    state = F.when(F.col("n").isNull(), "FAIL" if final else "SKIP").when(F.col("n") == 0, "PASS").when(F.col("name").isin(*review), "REVIEW").otherwise("FAIL")
    return out.unionByName(gone).select("name", "n", state.alias("state"))


def replaced(base: DataFrame, by: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``base`` in its own rows with ``value`` replaced where ``by`` names the key, and the keys of ``by`` that ``base`` does not have: an error the caller must not pass over."""
    d = by.groupBy(key).agg(F.max(value).alias("_new"))
    return base.join(d, key, "left").withColumn("replaced", F.col("_new").isNotNull()).withColumn(value, F.coalesce("_new", value)).drop("_new"), d.join(base.select(key).distinct(), key, "left_anti").select(key)


def subset(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows in the order their keys are asked for (``pos``, key); a key that is not there comes out with nulls."""
    return wanted.join(rows, key, "left")


def chosen(preferred: DataFrame, fallback: DataFrame, key: str, value: str, ok: Column) -> DataFrame:
    """Per key the preferred row's value where it passed (``ok``), else the fallback's, and which it was; keys of either side."""
    p = preferred.where(ok).groupBy(key).agg(F.min(value).alias("_p"))
    f = fallback.groupBy(key).agg(F.min(value).alias("_f"))
    return p.join(f, key, "full_outer").select(key, F.coalesce("_p", "_f").alias(value), F.when(F.col("_p").isNotNull(), "preferred").otherwise("fallback").alias("source"))
