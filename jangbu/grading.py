"""Queries that grade recorded answers and report on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jangbu.functions import columns as C
from jangbu.functions.answers import listed
from jangbu.operators import grading, reports, scoring, selection
from jangbu.registry import registered
from jangbu.runtime import table
from jangbu.tender import _CELLS

_RESPONSES = f"""with {_CELLS}, responses as (
  select i.item_key, coalesce(c.answer_raw, i.answer_raw) as answer, list_distinct(list_filter(list_transform(coalesce(i.evidence, []), lambda e: e.location.document), lambda x: x is not null)) as selected,
    case when c.status is not null then c.status in ('field_absent', 'not_disclosed') end as abstained, case when c.status = 'extraction_failed' then c.status end as failure, i.answer_type, i.field_tag, i.task_type, i.answer_source, i.document_id
  from evaluation_items i left join cur c on c.document_id = i.location.document and c.field_name = i.evidence[1].field)"""
_GOLD = "case when document_id is null or trim(document_id) = '' then [] else [upper(trim(document_id))] end"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_items")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers to the items: what the field table says of the field and document an item's first evidence is about, its evidence's documents as those selected."""
    cells = selection.current_cells(table(spark, d, "extraction_rows")).select(F.col("document_id").alias("doc"), F.col("field_name").alias("field"), "status", F.col("answer_raw").alias("cell"), F.col("answer_normalized").alias("norm"))
    i = _items(spark, d).select("item_key", "answer_raw", F.col("location.document").alias("doc"), F.get("evidence", F.lit(0))["field"].alias("field"), F.array_distinct(F.filter(F.coalesce("evidence.location.document", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("selected_document_ids"))
    j = i.join(cells, ["doc", "field"], "left")
    answer = F.coalesce("cell", "answer_raw")
    return j.select("item_key", answer.alias("answer"), listed("norm", answer).alias("items"), "selected_document_ids", F.col("status").isin("field_absent", "not_disclosed").alias("abstained"), F.when(F.col("status") == "extraction_failed", F.col("status")).alias("failure"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return grading.score_items(_items(spark, d), responses(spark, d))


@registered()
def g09_item_scores(spark, d):
    return _scored(spark, d).select("item_key", "kind", "score", "abstention", "final_status", F.array_join("problems", ",").alias("problems"))


@registered()
def g02_value_scores(spark, d):
    return _scored(spark, d).where("kind = 'value'").select("item_key", "score", "why")


@registered()
def g04_checkpoint_coverage(spark, d):
    e = _items(spark, d).where("answer_type = 'summary'").join(responses(spark, d).select("item_key", "answer"), "item_key")
    s = e.select("item_key", grading.summary_graded(F.split(F.coalesce("answer_raw", F.lit("")), r"\s*[,;\n]\s*"), F.col("answer")).alias("s"))
    return s.select("item_key", F.round("s.score", 6).alias("score"), F.array_join("s.covered", "|").alias("covered"), F.array_join("s.missing", "|").alias("missing"))


@registered(_RESPONSES + """ select item_key, concat_ws(',', case when abstained is null then 'no_abstained' end, case when answer_type = 'comparison' and not contains(coalesce(answer, ''), '|') then 'comparison_not_table' end) as problems from responses""")
def g07_response_forms(spark, d):
    j = _items(spark, d).select("item_key", "answer_type").join(responses(spark, d), "item_key")
    return j.select("item_key", F.array_join(grading.violations(F.col("answer_type"), F.col("abstained"), F.col("items"), F.col("selected_document_ids"), F.col("answer")), ",").alias("problems"))


@registered(_RESPONSES + f""", s as (select *, {_GOLD} as gold, list_transform(selected, lambda x: upper(trim(x))) as got from responses)
  select item_key, case when failure is not null then 'FAIL-system' when abstained is null then case when answer_type = 'unanswerable' and coalesce(abstained, false) = false then 'FAIL-format+content' else 'FAIL-format' end
    when answer_type = 'unanswerable' then case when abstained then 'PASS' else 'FAIL-content' end else 'PENDING_THRESHOLD' end as final_status,
    round(case when failure is not null then 0 when answer_type = 'unanswerable' then case when coalesce(abstained, false) then 1 else 0 end when len(gold) = 0 then case when len(got) = 0 then 1 else 0 end
      else 0.7 * len(list_intersect(gold, got)) / len(gold) + 0.3 * len(list_intersect(gold, got)) / greatest(len(list_distinct(got)), 1) end, 6)::double as score
  from s where answer_type in ('unanswerable', 'document_set')""")
def g08_final_status(spark, d):
    """Selections and unanswerable items; values, lists and summaries are graded by ``g09_item_scores``."""
    return _scored(spark, d).where("answer_type in ('unanswerable', 'document_set')").select("item_key", "final_status", "score")


def _selected(spark: SparkSession, d: str) -> DataFrame:
    org = table(spark, d, "identity_records").where("document_id is not null and buyer_org is not null").groupBy("document_id").agg(F.min(C.expression_key(F.col("buyer_org"))).alias("org"))
    i = _items(spark, d).select("item_key", F.when(F.col("document_id").isNotNull() & (F.trim("document_id") != ""), F.array("document_id")).otherwise(F.array().cast("array<string>")).alias("gold"))
    j = i.join(responses(spark, d).select("item_key", F.col("selected_document_ids").alias("got")), "item_key")
    of = j.select("item_key", F.explode(F.concat(F.transform("gold", lambda x: F.struct(F.lit(True).alias("g"), x.alias("document_id"))), F.transform("got", lambda x: F.struct(F.lit(False).alias("g"), x.alias("document_id"))))).alias("x")).select("item_key", "x.g", "x.document_id").join(org, "document_id")
    orgs = of.groupBy("item_key").agg(F.collect_set(F.when(F.col("g"), F.col("org"))).alias("gold_org"), F.collect_set(F.when(~F.col("g"), F.col("org"))).alias("got_org"))
    return grading.selection_kinds(j.join(orgs, "item_key", "left"))


_KINDS = _RESPONSES + r""", o as (select document_id, min(lower(regexp_replace(buyer_org, '[^0-9A-Za-z가-힣]', '', 'g'))) as org from identity_records where document_id is not null and buyer_org is not null group by 1),
  p as (select item_key, case when document_id is null or trim(document_id) = '' then [] else [document_id] end as gold, selected as got from responses),
  q as (select p.item_key, any_value(gold) as gold, any_value(got) as got, coalesce(list(distinct a.org) filter (where a.org is not null), []) as gold_org, coalesce(list(distinct b.org) filter (where b.org is not null), []) as got_org
    from p left join o a on list_contains(p.gold, a.document_id) left join o b on list_contains(p.got, b.document_id) group by 1),
  k as (select item_key, case when len(gold) = 0 then null when list_has_any(gold, got) and len(list_filter(got, lambda x: not list_contains(gold, x))) = 0 then 'correct' when len(got) = 0 then 'no_selection' when list_has_any(gold, got) then 'over_selection'
    when list_has_any(gold_org, got_org) then 'same_org_confusion' else 'unrelated_doc' end as selection from q)"""


@registered(_KINDS + " select * from k")
def g10_document_selection(spark, d):
    return _selected(spark, d).select("item_key", "selection")


@registered(_KINDS + " select selection as error_kind, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from k where selection is not null group by 1")
def a13_selection_errors(spark, d):
    s = _selected(spark, d).where("selection is not null")
    n = s.groupBy(F.col("selection").alias("error_kind")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all_"))), F.lit(True)).select("error_kind", "n", F.round(F.col("n") / F.col("all_"), 6).alias("share"))


@registered()
def g11_stub_verdicts(spark, d):
    """The stub judge on every item: does the recorded answer hold the words of the gold."""
    j = _items(spark, d).select("item_key", "answer_raw").join(responses(spark, d).select("item_key", "answer"), "item_key")
    return j.select("item_key", grading.stub_verdict("answer_raw", "answer").alias("supported"))


_KEY = "sha2({0}, 256)"


@registered("""with v as (select question as k, min(approved_plan.answer_mode) as reply from approved_memory where question is not null group by 1) select i.item_key, v.reply is not null as hit, v.reply as value from evaluation_items i left join v on i.question = v.k""")
def k08_cached_requests(spark, d):
    """Requests looked up in a cache of replies by the digest of what they depend on."""
    key = lambda c: grading.cache_key(F.lit("judge-1"), F.lit("prompt-2"), F.col(c))
    cache = table(spark, d, "approved_memory").where("question is not null").groupBy("question").agg(F.min("approved_plan.answer_mode").alias("value")).select(key("question").alias("cache_key"), "value")
    return grading.cached(_items(spark, d).select("item_key", key("question").alias("cache_key")), cache).select("item_key", "hit", "value")


@registered()
def g11_recorded_verdicts(spark, d):
    """Raters' labels as recorded verdicts of documents, read like a judge's reply."""
    verdicts = table(spark, d, "abuse_labels").select(F.col("doc_id").cast("string").alias("cache_key"), F.to_json(F.struct((F.col("abusive") == 1).alias("verdict"), F.col("abusive").cast("double").alias("score"))).alias("reply"))
    requests = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("cache_key"))
    return grading.judged(requests, verdicts).select("doc_id", "passed", "judge_score", "how")


_SETS = _RESPONSES + f""", s as (select item_key, task_type, answer_source, answer_type, failure, abstained, {_GOLD} as gold, list_transform(selected, lambda x: upper(trim(x))) as got from responses),
  t as (select *, round(case when failure is not null then 0 when len(gold) = 0 then case when len(got) = 0 then 1 else 0 end else 0.7 * len(list_intersect(gold, got)) / len(gold) + 0.3 * len(list_intersect(gold, got)) / greatest(len(list_distinct(got)), 1) end, 6)::double as score from s)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """All items graded as selections: gold document against the selected ones."""
    j = _items(spark, d).select("item_key", "task_type", "answer_source", F.when(F.col("document_id").isNotNull() & (F.trim("document_id") != ""), F.array(F.upper(F.trim("document_id")))).otherwise(F.array().cast("array<string>")).alias("gold"))
    r = j.join(responses(spark, d), "item_key")
    score = F.when(F.col("failure").isNotNull(), 0.0).otherwise(scoring.set_score(F.col("gold"), F.transform("selected_document_ids", lambda x: F.upper(F.trim(x)))))
    return r.withColumn("score", F.round(score, 6)).withColumn("final_status", F.when(F.col("failure").isNotNull(), "FAIL-system").when(F.col("abstained").isNull(), "FAIL-format").otherwise("PENDING_THRESHOLD"))


@registered(_SETS + """, c as (select task_type as axis, round(avg(score), 4) as m from t group by 1), w as (select * from (values ('selection', 0.5), ('extraction', 0.3), ('qa', 0.2), ('comparison', 0.4)) v(axis, weight))
  select round(sum(m * weight) / nullif(sum(weight), 0), 4)::double as integrated, count(*) as n_groups from c join w using (axis)""")
def a04_integrated_score(spark, d):
    w = spark.createDataFrame([("selection", 0.5), ("extraction", 0.3), ("qa", 0.2), ("comparison", 0.4)], "axis string, weight double")
    return reports.integrated(reports.cells(_sets(spark, d), "task_type", "score"), w)


@registered(_SETS + """, f as (select case when failure is not null then 'FAIL-system' when abstained is null then 'FAIL-format' else 'PENDING_THRESHOLD' end as final_status from t)
  select final_status, count(*) as n, (select round(count(*) filter (where final_status like 'FAIL-format%') / count(*), 4) from f)::double as format_failure_rate from f group by 1""")
def a06_format_report(spark, d):
    return reports.format_report(_sets(spark, d))


@registered(_SETS + """ select count(*) as n_items, count(*) filter (where failure is not null) as system_zero, count(*) filter (where failure is null and score = 0) as content_zero, round(count(*) filter (where failure is not null) / count(*), 6)::double as system_rate from t""")
def a07_failure_split(spark, d):
    return reports.zero_split(_sets(spark, d))


@registered(_SETS + f""", e as (select avg(case when c.status = x.status then 1.0 else 0.0 end) as v from (select unnest(evidence) as x from evaluation_items) u join cur c on c.document_id = u.x.location.document and c.field_name = u.x.field)
  select round((select avg(score) from t), 6)::double as selection_score, round((select v from e), 6)::double as extraction_accuracy, round(count(*) filter (where answer_source = 'table') / count(*), 6)::double as table_ratio,
  (round((select avg(score) from t), 6) - round((select v from e), 6)) > 0.15 and count(*) filter (where answer_source = 'table') > 0 as flagged from t""")
def a14_circularity_flag(spark, d):
    score = _sets(spark, d).agg(F.round(F.avg("score"), 6).alias("value"))
    cells = selection.current_cells(table(spark, d, "extraction_rows")).select("document_id", "field_name", F.col("status").alias("s"))
    e = _items(spark, d).select(F.explode("evidence").alias("x")).select(F.col("x.location.document").alias("document_id"), F.col("x.field").alias("field_name"), "x.status").join(cells, ["document_id", "field_name"])
    accuracy = e.agg(F.round(F.avg(F.coalesce(F.col("s") == F.col("status"), F.lit(False)).cast("double")), 6).alias("value"))
    return reports.circularity(score, accuracy, _items(spark, d))


@registered(_SETS + """ select task_type, count(*) as n, round(avg(score), 4)::double as score, round(avg(score), 4)::double as deterministic, null::double as provisional_stub, null::double as judged, null::double as final from t group by 1""")
def a34_score_breakdown(spark, d):
    """A report whose scores are all rule-based under a judge that is not ready: nothing final."""
    return reports.score_breakdown(_sets(spark, d).withColumn("kind", F.lit("document_set")), "stub", False)


@registered()
def a08_full_report(spark, d):
    """Every item graded by its type: cells of the report by task, severity and source."""
    s = _scored(spark, d)
    return reports.cells(s, "task_type", "score").withColumn("by", F.lit("task_type")).unionByName(reports.cells(s, "field_tag", "score").withColumn("by", F.lit("field_tag"))).unionByName(reports.cells(s, "answer_source", "score").withColumn("by", F.lit("answer_source")))


@registered(_SETS + """, r as (select item_key, abstained, failure, case when regexp_matches(question, '비교|차이|각각') then 'compare' when regexp_matches(question, '모두|목록|어떤 사업|찾아') then 'select' when regexp_matches(question, '예산|기간|기한|배점|제출|마감') then 'extract' when question is not null then 'qa' end as route, len(selected) as n_selected
    from responses join evaluation_items using (item_key)),
  x as (select 'route' as axis, coalesce(route, 'None') as value from r union all select 'abstained', coalesce(cast(abstained as varchar), 'None') from r union all select 'failure', coalesce(failure, 'None') from r)
  select axis, value, count(*)::double as amount from x group by 1, 2 union all select 'total', 'rows', count(*)::double from r union all select 'total', 'n_selected', sum(n_selected)::double from r""")
def a28_run_summary(spark, d):
    from jangbu.plans.router import route

    r = responses(spark, d).join(_items(spark, d).select("item_key", "question"), "item_key").withColumns({"route": route(F.col("question")), "n_selected": F.size("selected_document_ids")})
    return reports.run_summary(r, ["route", "abstained", "failure"], ["n_selected"])


@registered("""select document_id, sum(case when block_type = 'table' then length(text) else 0 end)::bigint + sum(case when block_type <> 'table' or block_type is null then coalesce(length(text), 0) else 0 end)::bigint - 0 as chars, count(*) as requests from (select document_id, block_type, coalesce(text, '') as text from chunks) group by 1""")
def a30_usage_merged(spark, d):
    """Usage of two clients (tables, other text) merged per document."""
    c = table(spark, d, "chunks")
    use = lambda df: df.select("document_id", F.length("text").alias("chars"), F.lit(1).alias("requests"))
    is_table = F.coalesce(F.col("block_type") == "table", F.lit(False))
    return reports.merge_usage(use(c.where(is_table)).unionByName(use(c.where(~is_table))), "document_id", ["chars", "requests"])


@registered("""with n as (select 1 as place, 'data' as layer, (select count(*) from data_manifest where load_rate < 0.5) as n_failed union all select 2, 'contract', (select count(*) from (select chunking_version from index_tags group by 1 having count(*) > 1))
    union all select 3, 'audit', (select count(*) from extraction_rows where status is null or field_name is null) + (select count(*) from documents where n_chars < 0) + (select count(*) from registry where document_id is null and output_filename is null) union all select 4, 'subset', (select count(*) from evaluation_items where id is null) union all select 5, 'final', null)
  select place, layer, n_failed, case when coalesce(max(case when n_failed is null or n_failed > 0 then 1 end) over (order by place rows between unbounded preceding and 1 preceding), 0) = 1 or n_failed is null then 'skipped' when n_failed > 0 then 'FAIL' else 'pass' end as state from n""")
def a33_layers(spark, d):
    n = lambda df, layer: df.agg(F.count("*").alias("n_failed")).select(F.lit(layer).alias("layer"), "n_failed")
    t = lambda name: table(spark, d, name)
    parts = [
        n(t("data_manifest").where("load_rate < 0.5"), "data"), n(reports.duplicates(t("index_tags"), ["chunking_version"]), "contract"), n(t("extraction_rows").where("status is null or field_name is null"), "audit"), n(t("documents").where("n_chars < 0"), "audit"),
        n(t("registry").where("document_id is null and output_filename is null"), "audit"), n(t("evaluation_items").where("id is null"), "subset"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return reports.layers(out, ["data", "contract", "audit", "subset", "final"])


@registered(_SETS + """, o as (select item_key, score, len(got) as n_selected from t where task_type <> 'qa'), n as (select item_key, case when answer_source = 'table' then 1.0 else score end as score, case when answer_source = 'table' then 1 else len(got) end as n_selected from t where task_type <> 'selection'),
  j as (select o.item_key as ok, n.item_key as nk, o.score as os, n.score as ns, o.n_selected as oc, n.n_selected as nc from o full outer join n using (item_key))
  select count(*) filter (where ok is not null and nk is not null) as n_both, count(*) filter (where ok is not null and nk is not null and os is distinct from ns) as n_differing, count(*) filter (where nk is null) as n_dropped, count(*) filter (where ok is null) as n_added,
  round(avg(ns - os) filter (where ok is not null and nk is not null), 6)::double as mean_change, round(100 * (1 - sum(nc) filter (where ok is not null and nk is not null) / nullif(sum(oc) filter (where ok is not null and nk is not null), 0)), 4)::double as n_selected_reduction from j""")
def a37_experiment(spark, d):
    """Two runs compared: one without questions and answers, one without selections and with the table's own items rescored."""
    t = _sets(spark, d).withColumn("n_selected", F.size("selected_document_ids").cast("double"))
    own = F.col("answer_source") == "table"
    new = t.where("task_type <> 'selection'").withColumns({"score": F.when(own, 1.0).otherwise(F.col("score")), "n_selected": F.when(own, 1.0).otherwise(F.col("n_selected"))})
    return reports.experiment_diff(t.where("task_type <> 'qa'"), new, "item_key", ["n_selected"])


_AXES = """l as (select row_number() over (order by chunking_version) as k, * from index_tags),
  u as (select k, axis, value from (select k, cast(chunk_size as varchar) as chunk_size, cast(chunk_overlap as varchar) as chunk_overlap, embedding_model, preprocess_version, corpus_version, registry_version, extraction_version from l) unpivot include nulls (value for axis in (chunk_size, chunk_overlap, embedding_model, preprocess_version, corpus_version, registry_version, extraction_version))),
  x as (select a.k as experiment, list_sort(list(a.axis) filter (where a.value is distinct from b.value)) as axes from u a join u b on a.k + 1 = b.k and a.axis = b.axis group by 1),
  m as (select l.k, avg(length(c.text)) as mean_length, count(c.chunk_key)::double as n_chunks from l left join chunks c using (chunking_version) group by 1)"""


@registered(f"""with {_AXES}, mm as (select a.k as experiment, b.mean_length > a.mean_length as up, b.n_chunks < a.n_chunks as down from m a join m b on a.k + 1 = b.k)
  select x.experiment, coalesce(axes, []) = ['extraction_version'] as only_scorer_changed, case when up then 1 else 0 end::bigint as n_rose, case when down then 1 else 0 end::bigint as n_protected_fell, case when coalesce(axes, []) = ['extraction_version'] and up then 'REJECT' else 'OK' end as verdict from x left join mm using (experiment)""")
def a19_contamination(spark, d):
    """Neighbouring index versions as experiments, the extraction's version standing for the scorer's."""
    from pyspark.sql.window import Window

    tags = table(spark, d, "index_tags").withColumn("k", F.row_number().over(Window.orderBy("chunking_version")).cast("long"))  # fixed: 5 rows
    names = ["chunk_size", "chunk_overlap", "embedding_model", "preprocess_version", "corpus_version", "registry_version", "extraction_version"]
    u = tags.select("k", *(F.col(n).cast("string").alias(n) for n in names)).unpivot(["k"], names, "axis", "value")
    last = tags.agg(F.max("k").alias("last"))
    before, after = u.select(F.col("k").alias("experiment"), "axis", "value"), u.select((F.col("k") - 1).alias("experiment"), "axis", "value").where("experiment > 0")
    axes = reports.changed_axes(before.join(F.broadcast(last), F.col("experiment") < F.col("last")).drop("last"), after, ["experiment"])
    m = tags.select("k", "chunking_version").join(table(spark, d, "chunks").groupBy("chunking_version").agg(F.avg(F.length("text")).alias("mean_length"), F.count("chunk_key").cast("double").alias("n_chunks")), "chunking_version", "left").unpivot(["k"], ["mean_length", "n_chunks"], "metric", "value")
    pairs = m.select(F.col("k").alias("experiment"), "metric", F.col("value").alias("old")).join(m.select((F.col("k") - 1).alias("experiment"), "metric", F.col("value").alias("new")), ["experiment", "metric"])
    return reports.contamination(axes, pairs, ["experiment"], ["mean_length"], ["n_chunks"], scorer="extraction_version")


@registered(_SETS + """, v as (select answer_source, avg(score) filter (where task_type = 'selection') as selection_score, avg(score) as task_score, avg(score) filter (where task_type = 'extraction') as extract_score, avg(case when abstained then 1.0 else 0.0 end) as faithfulness, avg(case when failure is null then 1.0 else 0.0 end) as extraction_accuracy from t group by 1),
  f as (select answer_source, list_filter([case when extraction_accuracy < 0.9 and selection_score < 0.7 then 'extraction_table' end, case when extraction_accuracy >= 0.9 and selection_score < 0.7 then 'condition_query' end, case when extraction_accuracy < 0.9 and selection_score >= 0.7 then 'circularity' end,
    case when coalesce(faithfulness >= 0.8, true) and coalesce(extraction_accuracy >= 0.9, true) and coalesce(selection_score >= 0.7, true) and task_score < 0.6 then 'corpus_or_items_moved' end], lambda x: x is not null) as fired from v)
  select answer_source, case when len(fired) = 0 then 'unclear' else array_to_string(fired, ',') end as findings from f""")
def a21_diagnosis_rules(spark, d):
    """The rules over what was measured per source of the gold; retrieval and document selection were not measured."""
    t = _sets(spark, d)
    of = lambda task: F.avg(F.when(F.col("task_type") == task, F.col("score")))
    v = t.groupBy("answer_source").agg(of("selection").alias("selection_score"), F.avg("score").alias("task_score"), of("extraction").alias("extract_score"), F.avg(F.coalesce("abstained", F.lit(False)).cast("double")).alias("faithfulness"), F.avg(F.col("failure").isNull().cast("double")).alias("extraction_accuracy"))
    v = v.withColumns({"retrieval_recall": F.lit(None).cast("double"), "doc_selection_accuracy": F.lit(None).cast("double"), "score_dropped": F.col("task_score") < 0.6})
    return reports.diagnose(v).select("answer_source", F.array_join("findings", ",").alias("findings"))


@registered("""with q as (select vec_id as query_id, label, embedding::double[] as e from embeddings where vec_id % 50 = 0), s as (select q.query_id, v.vec_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 6) as similarity from q join embeddings v on q.query_id <> v.vec_id),
  r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s), ranked as (select * from r where rank <= 20), g as (select q.query_id, v.vec_id from q join embeddings v on q.label = v.label and q.query_id <> v.vec_id), st as (select * from (values ('retrieval', 5), ('retrieval', 10), ('retrieval', 20), ('context', 5)) t(stage, k)),
  ng as (select query_id, count(*) as n_gold from g group by 1), h as (select st.stage, st.k, ranked.query_id, ranked.rank, g.vec_id is not null as hit from st join ranked on ranked.rank <= st.k left join g on g.query_id = ranked.query_id and g.vec_id = ranked.vec_id),
  m as (select stage, k, ng.query_id, n_gold, count(*) filter (where hit) as f, count(*) as n, min(case when hit then rank end) as first from ng join h using (query_id) group by all), x as (select stage, k, round(f / n_gold, 6) as recall, round(f / greatest(n, 1), 6) as precision, round(coalesce(1.0 / first, 0), 6)::double as mrr, f = n_gold as found_all, case when f = n_gold then 'none' when n_gold > (select count(*) from g join ranked using (query_id, vec_id) where g.query_id = m.query_id) then 'recall_failure' else 'rank_failure' end as failure_kind from m)
  select stage, k, count(*) as n, round(avg(recall), 4) as recall, round(avg(precision), 4) as precision, round(avg(mrr), 4) as mrr, round(avg(found_all::int), 4) as recall_all_rate, count(*) filter (where failure_kind = 'recall_failure') as n_recall_failure, count(*) filter (where failure_kind = 'rank_failure') as n_rank_failure from x group by 1, 2""")
def a09_stages(spark, d):
    """Searches graded at several cut-offs of the retrieval and at the context's, then put together per stage."""
    from jangbu.operators import retrieval

    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    ranked = retrieval.cosine_top_k(q.select("query_id", "embedding"), v.select("vec_id", "embedding"), 20)
    gold = q.select("query_id", "label").join(v.select("vec_id", "label"), "label").where("query_id <> vec_id").select("query_id", "vec_id")
    out = None
    for stage, k in (("retrieval", 5), ("retrieval", 10), ("retrieval", 20), ("context", 5)):
        m = retrieval.stage_metrics(ranked, gold, k).join(retrieval.failure_kinds(ranked, gold, 20, k), "query_id")
        m = m.select(F.lit(stage).alias("stage"), F.lit(k).alias("k"), "recall", "precision", "mrr", (F.col("n_found") == F.col("n_gold")).alias("found_all"), F.col("failure").alias("failure_kind"))
        out = m if out is None else out.unionByName(m)
    return reports.stages(out)


@registered(_SETS + """, n as (select item_key, case when len(gold) = 0 then score when len(list_intersect(gold, got)) = len(gold) and len(list_distinct(got)) = len(gold) then 1 else 0 end::double as score from t where failure is null)
  select item_key, case when n.item_key is null then 'removed' else 'changed' end as change from t left join n using (item_key) where n.item_key is null or n.score is distinct from t.score""")
def j19_scores_compared(spark, d):
    """Partial scores against all-or-nothing ones, failed runs being left out of the second file."""
    from jangbu.operators import diffs

    t = _sets(spark, d).select("item_key", "score", "gold", "failure", F.transform("selected_document_ids", lambda x: F.upper(F.trim(x))).alias("got"))
    exact = (F.size(F.array_intersect("gold", "got")) == F.size("gold")) & (F.size(F.array_distinct("got")) == F.size("gold"))
    new = t.where("failure is null").withColumn("score", F.when(F.size("gold") == 0, F.col("score")).otherwise(exact.cast("double")))
    return diffs.full_diff(t, new, ["item_key"], ["score"])


@registered("""with n as (select document_id from chunks where chunking_version = 'c1' and document_id is not null) select chunk_key, document_id, 'kept' as edition from chunks where coalesce(document_id, '') not in (select document_id from n) union all select chunk_key, document_id, 'made again' from chunks where chunking_version = 'c1' and document_id is not null""")
def u06_refreshed_chunks(spark, d):
    """Chunks kept of other documents, and those of the first version made again."""
    from jangbu.operators import diffs

    c = table(spark, d, "chunks").select("chunk_key", "document_id", "chunking_version")
    new = c.where("chunking_version = 'c1' and document_id is not null").select("chunk_key", "document_id", F.lit("made again").alias("edition"))
    return diffs.refresh(c.select("chunk_key", "document_id", F.lit("kept").alias("edition")), new, "document_id")
