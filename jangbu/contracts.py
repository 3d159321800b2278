"""Queries of data contracts, merges and report summaries, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from jangbu.functions import columns as C
from jangbu.operators import diffs, locate, reports, scoring, selection
from jangbu.runtime import table
from jangbu.registry import registered
from jangbu.tender import _CELLS


@registered("""with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0), s as (select q.query_id, v.vec_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 6) as similarity from q join embeddings v on q.query_id <> v.vec_id),
  r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s) select query_id, count(*) filter (where similarity >= 0.3) as n_recalled, max(similarity) as best from r where rank <= 3 group by 1""")
def j26_recalled_memory(spark, d):
    """Nearest three of every query, the threshold applied after the cut."""
    from jangbu.operators.retrieval import cosine_top_k

    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    top = cosine_top_k(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, 3)
    return top.groupBy("query_id").agg(F.count_if(F.col("similarity") >= 0.3).alias("n_recalled"), F.max("similarity").alias("best"))


@registered(f"""with {_CELLS}, e as (select item_key, x.location.document as doc, x.field as field, x.status as claimed from (select item_key, unnest(evidence) as x from evaluation_items) where x.location.document is not null and x.field is not null),
  b as (select e.item_key, e.doc, e.field, bool_or(c.status is not null and coalesce(e.claimed, c.status) = c.status) as satisfied from e left join cur c on e.doc = c.document_id and e.field = c.field_name group by 1, 2, 3)
  select item_key, count(*) as n_bundles, count(*) filter (where satisfied) as n_satisfied, round(count(*) filter (where satisfied) / count(*), 6) as score from b group by 1""")
def r10_citation_scores(spark, d):
    e = table(spark, d, "evaluation_items").select("item_key", F.explode("evidence").alias("x")).select("item_key", F.col("x.location.document").alias("document_id"), F.col("x.field").alias("field_name"), F.col("x.status").alias("claimed")).where("document_id is not null and field_name is not null")
    c = selection.current_cells(table(spark, d, "extraction_rows")).select("document_id", "field_name", "status")
    ok = F.col("status").isNotNull() & (F.coalesce("claimed", "status") == F.col("status"))
    b = e.join(c, ["document_id", "field_name"], "left").groupBy("item_key", "document_id", "field_name").agg(F.bool_or(ok).alias("s"))
    return b.groupBy("item_key").agg(F.count("*").alias("n_bundles"), F.count_if("s").alias("n_satisfied"), F.round(F.count_if("s") / F.count("*"), 6).alias("score"))


@registered(f"""with {_CELLS}, e as (select item_key, x.location.document as doc, x.field as field, x.status as claimed from (select item_key, unnest(evidence) as x from evaluation_items) where x.location.document is not null and x.field is not null),
  b as (select e.item_key, e.doc, e.field, bool_or(c.status is not null and coalesce(e.claimed, c.status) = c.status) as satisfied from e left join cur c on e.doc = c.document_id and e.field = c.field_name group by 1, 2, 3),
  s as (select item_key, count(*) as n, count(*) filter (where satisfied) as k from b group by 1)
  select count(*) as n_items, round(avg(k / n), 6) as accuracy, round(count(*) filter (where k = 0) / count(*), 6) as rate_none, round(count(*) filter (where k > 0 and k < n) / count(*), 6) as rate_partial from s""")
def a10_citation_summary(spark, d):
    s = r10_citation_scores(spark, d)
    n, k = F.col("n_bundles"), F.col("n_satisfied")
    return s.agg(F.count("*").alias("n_items"), F.round(F.avg(k / n), 6).alias("accuracy"), F.round(F.count_if(k == 0) / F.count("*"), 6).alias("rate_none"), F.round(F.count_if((k > 0) & (k < n)) / F.count("*"), 6).alias("rate_partial"))


@registered("""select t.chunking_version, t.corpus_version as tag_corpus, count(c.chunk_key) as n_chunks, count(distinct c.corpus_version) as n_corpus_versions, count(*) filter (where c.preprocess_version <> t.preprocess_version) as n_mismatched from index_tags t left join chunks c using (chunking_version) group by 1, 2""")
def a25_version_invariants(spark, d):
    c = table(spark, d, "chunks").select("chunking_version", "chunk_key", F.col("corpus_version").alias("cv"), F.col("preprocess_version").alias("pv"))
    j = F.broadcast(table(spark, d, "index_tags")).join(c, "chunking_version", "left")
    return j.groupBy("chunking_version", F.col("corpus_version").alias("tag_corpus")).agg(F.count("chunk_key").alias("n_chunks"), F.countDistinct("cv").alias("n_corpus_versions"), F.count_if(F.col("pv") != F.col("preprocess_version")).alias("n_mismatched"))


@registered("""select item_key, array_to_string(list_sort(list_transform(list_filter(coalesce(evidence, []), lambda e: e.value is not null), lambda e: lpad(cast(1000 - length(e.value) as varchar), 4, '0') || ':' || e.value)), '|') as by_length from evaluation_items""")
def o07_longest_first(spark, d):
    v = F.filter(F.coalesce("evidence.value", F.array().cast("array<string>")), lambda x: x.isNotNull())
    key = F.transform(v, lambda x: F.concat(F.lpad((1000 - F.length(x)).cast("string"), 4, "0"), F.lit(":"), x))
    return table(spark, d, "evaluation_items").select("item_key", F.array_join(F.array_sort(key), "|").alias("by_length"))


@registered("""with v as (select memory_key, list_distinct(list_filter(coalesce(approved_plan.document_ids, []), lambda x: x is not null)) as ids from approved_memory) select memory_key, len(list_filter(ids, lambda k: len(list_filter(ids, lambda o: o <> k and contains(o, k))) = 0)) as n_kept from v""")
def u07_subsumed_ids(spark, d):
    ids = F.array_distinct(F.filter(F.coalesce("approved_plan.document_ids", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    v = table(spark, d, "approved_memory").select("memory_key", ids.alias("ids"))
    return v.select("memory_key", F.size(F.filter("ids", lambda k: ~F.exists("ids", lambda o: (o != k) & F.contains(o, k)))).cast("long").alias("n_kept"))


@registered("""select item_key, case when document_id is null and answer_raw is null then 'ok' when document_id is null then 'hallucination' when answer_raw is null and task_type = 'selection' then 'critical_abstain' when answer_raw is null then 'over_refusal' else 'answered' end as kind from evaluation_items""")
def g06_abstention_kinds(spark, d):
    e = table(spark, d, "evaluation_items")
    return e.select("item_key", scoring.abstention(F.col("document_id").isNull(), F.col("answer_raw").isNull(), F.lit(False), F.coalesce(F.col("task_type") == "selection", F.lit(False))).alias("kind"))


@registered("""with e as (select item_key, document_id, created_at, list_filter(list_transform(coalesce(evidence, []), lambda e: e.location.document), lambda x: x is not null) as docs from evaluation_items)
  select 'no_time' as check_name, count(*) filter (where created_at is null) as n from e union all select 'evidence_elsewhere', count(*) filter (where len(docs) > 0 and document_id is not null and not list_contains(docs, document_id)) from e union all select 'no_evidence', count(*) filter (where len(docs) = 0) from e""")
def v03_scope_checks(spark, d):
    docs = F.filter(F.coalesce("evidence.location.document", F.array().cast("array<string>")), lambda x: x.isNotNull())
    e = table(spark, d, "evaluation_items").select("document_id", "created_at", docs.alias("docs"))
    n = e.agg(F.count_if(F.col("created_at").isNull()).alias("no_time"), F.count_if((F.size("docs") > 0) & F.col("document_id").isNotNull() & ~F.array_contains("docs", F.col("document_id"))).alias("evidence_elsewhere"), F.count_if(F.size("docs") == 0).alias("no_evidence"))
    return n.unpivot([], n.columns, "check_name", "n")


@registered(f"""with {_CELLS}, g as (select i.document_id, i.field_tag, i.answer_normalized from evaluation_items i where i.document_id is not null and i.field_tag is not null),
  j as (select g.*, c.status, c.answer_normalized as cell from g left join cur c on g.document_id = c.document_id and g.field_tag = c.field_name)
  select case when status is null then 'no cell' when status <> 'value_present' then 'no value' when cell is distinct from answer_normalized then 'differs' else 'same' end as outcome, count(*) as n from j group by 1""")
def v05_gold_recomputed(spark, d):
    c = selection.current_cells(table(spark, d, "extraction_rows")).select("document_id", F.col("field_name").alias("field_tag"), "status", F.col("answer_normalized").alias("cell"))
    j = table(spark, d, "evaluation_items").where("document_id is not null and field_tag is not null").select("document_id", "field_tag", "answer_normalized").join(c, ["document_id", "field_tag"], "left")
    out = F.when(F.col("status").isNull(), "no cell").when(F.col("status") != "value_present", "no value").when(~F.col("cell").eqNullSafe(F.col("answer_normalized")), "differs").otherwise("same")
    return j.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@registered("""with e as (select item_key, x.location.document as doc, x.location.line as line from (select item_key, unnest(evidence) as x from evaluation_items) where x.location.line is not null),
  r as (select e.item_key, e.doc, e.line, bool_or(coalesce(c.retrieval_eligible, false)) as retrievable from e left join chunks c on e.doc = c.document_id and e.line between c.md_line_start and c.md_line_end group by 1, 2, 3)
  select retrievable, count(*) as n from r group by 1""")
def v06_retrievable_evidence(spark, d):
    e = table(spark, d, "evaluation_items").select("item_key", F.explode("evidence").alias("x")).select("item_key", F.col("x.location.document").alias("doc"), F.col("x.location.line").alias("line")).where("line is not null")
    e = e.distinct()
    c = table(spark, d, "chunks").select(F.col("document_id").alias("doc"), "md_line_start", "md_line_end", "retrieval_eligible")
    held = locate.covering(e, c, "doc", "line", "md_line_start", "md_line_end").where("retrieval_eligible").select("item_key", "doc", "line").distinct().withColumn("ok", F.lit(True))
    on = [e["item_key"] == held["item_key"], e["doc"].eqNullSafe(held["doc"]), e["line"] == held["line"]]
    r = e.join(held, on, "left").select(F.coalesce(held["ok"], F.lit(False)).alias("retrievable"))
    return r.groupBy("retrievable").agg(F.count("*").alias("n"))


@registered("""select schema_version, extraction_version, corpus_version, registry_version, count(*) as n, count(*) filter (where schema_version is null or extraction_version is null or corpus_version is null or registry_version is null) = 0 as complete from extraction_rows group by 1, 2, 3, 4""")
def v09_provenance(spark, d):
    axes = ["schema_version", "extraction_version", "corpus_version", "registry_version"]
    gap = F.col(axes[0]).isNull()
    for a in axes[1:]:
        gap = gap | F.col(a).isNull()
    return table(spark, d, "extraction_rows").groupBy(*axes).agg(F.count("*").alias("n"), (F.count_if(gap) == 0).alias("complete"))


@registered("""with a as (select field_name, status, count(*) as n from extraction_rows where lower(coalesce(active, 'true')) <> 'false' group by 1, 2), b as (select field_name, status, count(*) as n from extraction_rows group by 1, 2)
  select field_name, status, case when a.n is null then 'added' else 'changed' end as change from b left join a using (field_name, status) where a.n is distinct from b.n""")
def v07_report_diff(spark, d):
    r = table(spark, d, "extraction_rows")
    n = lambda df: df.groupBy("field_name", "status").agg(F.count("*").alias("n"))
    return diffs.full_diff(n(r.where(C.active())), n(r), ["field_name", "status"], ["n"])


@registered("""select field_name, count(distinct document_id) as n_documents, count(distinct extraction_version) as n_versions, count(distinct row_id) as n_rows from extraction_rows group by 1""")
def a35_profile_counts(spark, d):
    return table(spark, d, "extraction_rows").groupBy("field_name").agg(F.countDistinct("document_id").alias("n_documents"), F.countDistinct("extraction_version").alias("n_versions"), F.countDistinct("row_id").alias("n_rows"))


@registered(f"""with {_CELLS}, c as (select field_name as axis, count(*) as n, round(avg(case when status = 'value_present' then 1.0 else 0.0 end), 4) as m from cur group by 1) select axis, n, m as mean_score, round(100.0 / n, 4)::double as points_per_item, n >= 5 as reliable from c""")
def a08_field_report(spark, d):
    cells = selection.current_cells(table(spark, d, "extraction_rows")).withColumn("score", C.status_is("present").cast("double"))
    return reports.cells(cells, "field_name", "score")
