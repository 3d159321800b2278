"""Queries over the tender tables, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jangbu.functions import columns as C
from jangbu.operators import diffs, locate, reports, retrieval, selection
from jangbu.operators.selection import Condition
from jangbu.registry import oracle_sql, queries, registered  # noqa: F401
from jangbu.runtime import table

_CELLS = """
cells as (
  select document_id, field_name, arg_min({'status': status, 'raw': answer_raw, 'norm': answer_normalized}, row_id) as c
  from extraction_rows where lower(coalesce(active, 'true')) <> 'false' and document_id is not null group by 1, 2),
cur as (select document_id, field_name, c.status as status, c.raw as answer_raw, c.norm as answer_normalized from cells)
"""
_AMOUNT = r"case when regexp_full_match({0}, '\s*[0-9][0-9,]*(\.[0-9]+)?\s*(원)?\s*') then cast(regexp_replace({0}, '[,원\s]', '', 'g') as double) end"
_SCOPE = "scope as (select distinct document_id from registry where retrieval_eligible and deleted_at is null and document_id is not null)"
CONDITIONS = [Condition("예산", ">=", 100_000_000.0), Condition("지역제한", "absent", negated=True)]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extraction_rows")


# Scans, predicates, selection


@registered("""select lower(coalesce(active, 'true')) <> 'false' as is_active, status, count(*) as n from extraction_rows group by 1, 2""")
def pred01_active_status(spark, d):
    return _rows(spark, d).groupBy(C.active().alias("is_active"), "status").agg(F.count("*").alias("n"))


@registered("""select field_name, count(*) filter (where status = 'value_present') as n_present, count(*) filter (where status in ('extraction_failed', 'review_required')) as n_unresolved,
  count(*) filter (where status <> 'field_absent') as n_not_absent from extraction_rows group by 1""")
def pred03_status_operators(spark, d):
    return _rows(spark, d).groupBy("field_name").agg(F.count_if(C.status_is("present")).alias("n_present"), F.count_if(C.status_is("unresolved")).alias("n_unresolved"), F.count_if(C.status_is("absent", negated=True)).alias("n_not_absent"))


@registered(f"""with {_CELLS} select document_id, status, {_AMOUNT.format("coalesce(answer_normalized, answer_raw)")} as amount,
  case when status = 'value_present' then {_AMOUNT.format("coalesce(answer_normalized, answer_raw)")} >= 500000000 end as large from cur where field_name = '예산'""")
def pred05_amount_predicate(spark, d):
    c = selection.current_cells(_rows(spark, d).where(F.col("field_name") == "예산"))
    amount = C.plain_amount(F.coalesce("answer_normalized", "answer_raw"))
    return c.select("document_id", "status", amount.alias("amount"), F.when(F.col("status") == "value_present", C.compare(amount, ">=", 5e8)).alias("large"))


@registered(f"""with {_CELLS} select case when answer_raw is null then 'unknown' when regexp_matches(answer_raw, '본점|본사|소재지|소재한|권역|관내|지역\\s*업체|지역\\s*의무') then 'restricted'
  when regexp_matches(answer_raw, '제한\\s*(없|하지)|전국|무관|해당\\s*없') then 'none' else 'unknown' end as restriction, count(*) as n from cur where field_name = '지역제한' group by 1""")
def pred06_region_restriction(spark, d):
    c = selection.current_cells(_rows(spark, d).where(F.col("field_name") == "지역제한"))
    return c.groupBy(C.region_restriction(F.col("answer_raw")).alias("restriction")).agg(F.count("*").alias("n"))


@registered(f"""with {_CELLS} select document_id, field_name, status, answer_raw, answer_normalized from cur where document_id = 'RFP-00000001' and field_name = '예산'""")
def pred11_point_lookup(spark, d):
    return selection.lookup(_rows(spark, d), "RFP-00000001", "예산").drop("row_id")


@registered("""select c.chunk_key from chunks c join (select distinct document_id from registry where retrieval_eligible and deleted_at is null) r using (document_id)
  where c.retrieval_eligible and not coalesce(c.table_degraded, false) and trim(coalesce(c.text, ''), ' ') <> ''""")
def pred15_retrievable_chunks(spark, d):
    c = table(spark, d, "chunks").where(F.col("retrieval_eligible") & ~F.coalesce("table_degraded", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return c.join(selection.scope(table(spark, d, "registry")), "document_id", "left_semi").select("chunk_key")


@registered(f"""with {_CELLS} select field_name, status, count(*) as n, count(coalesce(nullif(trim(answer_normalized), ''), nullif(trim(answer_raw), ''))) as n_shown,
  count(distinct coalesce(nullif(trim(answer_normalized), ''), nullif(trim(answer_raw), ''))) as n_distinct from cur group by 1, 2""")
def pred17_displayed_values(spark, d):
    c = selection.current_cells(_rows(spark, d)).withColumn("shown", C.display(F.col("answer_normalized"), F.col("answer_raw")))
    return c.groupBy("field_name", "status").agg(F.count("*").alias("n"), F.count("shown").alias("n_shown"), F.countDistinct("shown").alias("n_distinct"))


@registered("""select row_id, count(*) as n from (select distinct row_id, l.document_id as doc, l.heading as heading, l.line as line from
  (select row_id, representative_location as l from extraction_rows union all select row_id, unnest(additional_locations) from extraction_rows) where l is not null) group by 1""")
def pred29_citations(spark, d):
    r = _rows(spark, d).select("row_id", F.explode(F.concat(F.array("representative_location"), F.coalesce("additional_locations", F.array().cast("array<struct<document_id:string,file:string,heading:string,line:int,line_start:int,line_end:int,source_type:string,block_type:string,block_index:int,section_path:array<struct<level:int,line:int,title:string>>>>")))).alias("l"))
    return r.where("l is not null").select("row_id", "l.document_id", "l.heading", "l.line").distinct().groupBy("row_id").agg(F.count("*").alias("n"))


_VERDICT = f"""with {_CELLS}, {_SCOPE},
wide as (select document_id, max(case when field_name = '예산' then status end) as bs, max(case when field_name = '예산' then coalesce({_AMOUNT.format("answer_normalized")}, {_AMOUNT.format("answer_raw")}) end) as amt,
  max(case when field_name = '지역제한' then status end) as rs from cur where field_name in ('예산', '지역제한') group by 1),
judged as (select s.document_id, (case when bs = 'value_present' then amt >= 100000000 end) and rs <> 'field_absent' as ok from scope s left join wide using (document_id)),
picked as (select document_id, case when ok then 'confirmed' when ok is null then 'undetermined' end as verdict from judged where ok is not false)
"""


@registered(_VERDICT + "select * from picked")
def j01_selection(spark, d):
    return selection.verdicts(_rows(spark, d), CONDITIONS, selection.scope(table(spark, d, "registry")))


@registered(_VERDICT + """select count(*) filter (where verdict = 'confirmed') as n_confirmed, count(*) filter (where verdict = 'undetermined') as n_undetermined,
  case when count(*) filter (where verdict = 'confirmed') > 0 and count(*) filter (where verdict = 'undetermined') = 0 then 'matched' when count(*) filter (where verdict = 'confirmed') > 0 then 'partial'
  when count(*) filter (where verdict = 'undetermined') > 0 then 'undetermined_only' else 'empty' end as outcome from picked""")
def q16_outcome(spark, d):
    return selection.outcome(j01_selection(spark, d))


@registered(f"""with {_CELLS}, {_SCOPE} select distinct document_id from cur where document_id not in (select document_id from scope)""")
def j02_out_of_scope(spark, d):
    return selection.current_cells(_rows(spark, d)).select("document_id").distinct().join(selection.scope(table(spark, d, "registry")), "document_id", "left_anti")


@registered(f"""with {_CELLS}, {_SCOPE}, want as (select document_id, f as field_name from scope, (values ('예산'), ('사업기간'), ('지역제한')) v(f))
  select w.document_id, w.field_name, coalesce(c.status, 'missing') as status, coalesce(c.answer_normalized, c.answer_raw) as value from want w left join cur c using (document_id, field_name)""")
def q14_comparison_grid(spark, d):
    return selection.grid(_rows(spark, d), selection.scope(table(spark, d, "registry")), ["예산", "사업기간", "지역제한"])


@registered(f"""with {_CELLS} select field_name, status, count(*) as n_documents from cur group by 1, 2""")
def a31_status_matrix(spark, d):
    return selection.status_matrix(_rows(spark, d))


_NAMED = {"budget_present": ("예산", "present"), "budget_conflict": ("예산", "conflict"), "region_absent": ("지역제한", "absent"), "period_external": ("사업기간", "external"), "scoring_unresolved": ("평가 배점", "unresolved")}


@registered(f"""with {_CELLS} select 'budget_present' as condition, count(*) as n from cur where field_name = '예산' and status = 'value_present'
  union all select 'budget_conflict', count(*) from cur where field_name = '예산' and status = 'conflict' union all select 'region_absent', count(*) from cur where field_name = '지역제한' and status = 'field_absent'
  union all select 'period_external', count(*) from cur where field_name = '사업기간' and status = 'external_reference' union all select 'scoring_unresolved', count(*) from cur where field_name = '평가 배점' and status in ('extraction_failed', 'review_required')""")
def u01_named_conditions(spark, d):
    cells = selection.current_cells(_rows(spark, d))
    held = F.filter(F.array(*(F.when((F.col("field_name") == f) & C.status_is(op), F.lit(name)) for name, (f, op) in _NAMED.items())), lambda x: x.isNotNull())
    n = cells.select(F.explode(held).alias("condition")).groupBy("condition").agg(F.count("*").alias("k"))
    names = spark.createDataFrame([(x,) for x in _NAMED], "condition string")
    return names.join(n, "condition", "left").select("condition", F.coalesce("k", F.lit(0)).alias("n"))


@registered(f"""with {_CELLS}, {_SCOPE} select document_id from scope except select document_id from cur where field_name = '예산' and status = 'field_absent'""")
def u02_candidates_minus_absent(spark, d):
    absent = selection.current_cells(_rows(spark, d)).where((F.col("field_name") == "예산") & C.status_is("absent")).select("document_id")
    return selection.scope(table(spark, d, "registry")).join(absent, "document_id", "left_anti")


@registered("""select item_key, len(list_distinct(list_filter(list_transform(coalesce(evidence, []), lambda e: e.location.document), lambda x: x is not null and x <> coalesce(document_id, '')))) as n_other,
  coalesce(list_bool_and(list_transform(coalesce(evidence, []), lambda e: coalesce(e.status, '') = 'field_absent')), true) and len(coalesce(evidence, [])) > 0 as all_absent from evaluation_items""")
def pred26_evidence_tests(spark, d):
    e = table(spark, d, "evaluation_items")
    docs = F.coalesce("evidence.location.document", F.array().cast("array<string>"))
    other = F.size(F.array_distinct(F.filter(docs, lambda x: x.isNotNull() & (x != F.coalesce("document_id", F.lit(""))))))
    ev = F.coalesce("evidence.status", F.array().cast("array<string>"))
    return e.select("item_key", other.cast("long").alias("n_other"), (F.forall(ev, lambda s: F.coalesce(s, F.lit("")) == "field_absent") & (F.size(ev) > 0)).alias("all_absent"))


# Joins


@registered("""with f as (select i.record_id, i.document_id, r.n from identity_records i left join (select document_id, count(*) as n from registry group by 1) r using (document_id))
  select case when document_id is null then 'no_id' when n is null then 'unknown' else 'known' end as state, count(*) as n from f group by 1""")
def j03_identity_registry(spark, d):
    r = table(spark, d, "registry").groupBy("document_id").agg(F.count("*").alias("k"))
    j = table(spark, d, "identity_records").join(r, "document_id", "left")
    return j.groupBy(F.when(F.col("document_id").isNull(), "no_id").when(F.col("k").isNull(), "unknown").otherwise("known").alias("state")).agg(F.count("*").alias("n"))


@registered("""with c as (select distinct document_id, processed_sha256 from chunks where document_id is not null), r as (select document_id, max(processed_sha256) as sha from registry where document_id is not null group by 1),
  c2 as (select document_id, max(processed_sha256) as sha from c group by 1)
  select coalesce(c2.document_id, r.document_id) as document_id, case when r.document_id is null then 'added' when c2.document_id is null then 'removed' else 'changed' end as change
  from r full outer join c2 using (document_id) where r.document_id is null or c2.document_id is null or r.sha is distinct from c2.sha""")
def j10_chunks_registry(spark, d):
    latest = lambda name: table(spark, d, name).where("document_id is not null").groupBy("document_id").agg(F.max("processed_sha256").alias("sha"))
    return diffs.full_diff(latest("registry"), latest("chunks"), ["document_id"], ["sha"])


@registered("""with o as (select document_id, array_to_string(section_path, ' > ') as path, location_label, count(*) as n from chunks where chunking_version in ('c1', 'c2') and document_id is not null and location_label is not null group by all),
  m as (select document_id, array_to_string(section_path, ' > ') as path, location_label, count(*) as n from chunks where chunking_version in ('c3', 'c4', 'c5') and document_id is not null and location_label is not null group by all)
  select document_id, path, location_label, case when o.n is null then 'added' when m.n is null then 'removed' else 'changed' end as change from o full outer join m using (document_id, path, location_label) where o.n is distinct from m.n""")
def j11_location_diff(spark, d):
    c = table(spark, d, "chunks").where("document_id is not null and location_label is not null")
    at = lambda *v: c.where(F.col("chunking_version").isin(*v)).groupBy("document_id", F.array_join("section_path", " > ").alias("path"), "location_label").agg(F.count("*").alias("n"))
    return diffs.full_diff(at("c1", "c2"), at("c3", "c4", "c5"), ["document_id", "path", "location_label"], ["n"])


@registered("""select 'row_without_document' as violation, count(*) as n from extraction_rows e where document_id is not null and not exists (select 1 from registry r where r.document_id = e.document_id)
  union all select 'chunk_without_tag', count(*) from chunks c where not exists (select 1 from index_tags t where t.chunking_version = c.chunking_version)
  union all select 'record_without_batch', count(*) from identity_records i where not exists (select 1 from data_manifest m where m.batch_no = i.batch_no)
  union all select 'record_without_system', count(*) from identity_records i where not exists (select 1 from collection_systems s where s.collection_system = i.collection_system)
  union all select 'label_without_document', count(*) from abuse_labels a where not exists (select 1 from documents x where x.doc_id = a.doc_id)""")
def v02_reference_integrity(spark, d):
    t = lambda n: table(spark, d, n)
    gone = {
        "row_without_document": t("extraction_rows").where("document_id is not null").select("document_id").join(t("registry").select("document_id").distinct(), "document_id", "left_anti"),
        "chunk_without_tag": t("chunks").select("chunking_version").join(F.broadcast(t("index_tags").select("chunking_version")), "chunking_version", "left_anti"),
        "record_without_batch": t("identity_records").select("batch_no").join(t("data_manifest").select("batch_no").distinct(), "batch_no", "left_anti"),
        "record_without_system": t("identity_records").select("collection_system").join(F.broadcast(t("collection_systems").select("collection_system")), "collection_system", "left_anti"),
        "label_without_document": t("abuse_labels").select("doc_id").join(t("documents").select("doc_id"), "doc_id", "left_anti"),
    }
    out = None
    for name, df in gone.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@registered("""with p as (select row_id, representative_location.document_id as doc, representative_location.line as line from extraction_rows where representative_location.line is not null),
  iv as (select chunk_key, document_id as doc, md_line_start as s, md_line_end as e from chunks where md_line_start <= md_line_end and document_id is not null),
  m as (select p.row_id, iv.chunk_key, row_number() over (partition by p.row_id order by e - s, -s, chunk_key) as rn from p join iv on p.doc = iv.doc and p.line between iv.s and iv.e)
  select p.row_id, m.chunk_key from p left join (select * from m where rn = 1) m using (row_id)""")
def j08_narrowest_chunk(spark, d):
    p = _rows(spark, d).select("row_id", F.col("representative_location.document_id").alias("doc"), F.col("representative_location.line").alias("line")).where("line is not null")
    iv = table(spark, d, "chunks").select("chunk_key", F.col("document_id").alias("doc"), "md_line_start", "md_line_end").where("doc is not null")
    return locate.narrowest(p, iv, "doc", "line", "md_line_start", "md_line_end", "chunk_key", "row_id")


@registered("""with g as (select item_key, location.document as document_id, location.section as section, location.line as line from evaluation_items where location.document is not null and location.line is not null),
  c as (select chunk_key, document_id, section_path[len(section_path)] as section, md_line_start as line, md_line_end as line_end from chunks)
  select g.item_key as gold_id, c.chunk_key as candidate_id from g join c on g.document_id = c.document_id and g.section = c.section where g.line between c.line and coalesce(c.line_end, c.line)""")
def j06_gold_locations(spark, d):
    g = table(spark, d, "evaluation_items").select(F.col("item_key").alias("gold_id"), F.col("location.document").alias("document_id"), F.col("location.section").alias("section"), F.col("location.line").alias("line"), F.lit(None).cast("string").alias("ref_no")).where("line is not null")
    c = table(spark, d, "chunks").select(F.col("chunk_key").alias("candidate_id"), "document_id", F.try_element_at("section_path", F.lit(-1)).alias("section"), F.col("md_line_start").alias("line"), F.col("md_line_end").alias("line_end"), F.lit(None).cast("string").alias("ref_no"))
    return locate.in_section(g, c)


@registered("""with e as (select distinct item_key, x.field as field, x.location.document as doc from (select item_key, unnest(evidence) as x from evaluation_items)),
  t as (select document_id as doc, field_name as field, bool_or(status = 'value_present') as present from extraction_rows group by 1, 2)
  select e.item_key, count(*) as n_facts, count(*) filter (where t.doc is not null) as n_known, coalesce(bool_or(t.present), false) as any_present from e left join t using (doc, field) where e.doc is not null and e.field is not null group by 1""")
def a11_fact_bundles(spark, d):
    e = table(spark, d, "evaluation_items").select("item_key", F.explode("evidence").alias("x")).select("item_key", F.col("x.field").alias("field"), F.col("x.location.document").alias("doc")).where("doc is not null and field is not null").distinct()
    t = _rows(spark, d).groupBy(F.col("document_id").alias("doc"), F.col("field_name").alias("field")).agg(F.bool_or(F.col("status") == "value_present").alias("present"), F.lit(True).alias("known"))
    return e.join(t, ["doc", "field"], "left").groupBy("item_key").agg(F.count("*").alias("n_facts"), F.count("known").alias("n_known"), F.coalesce(F.bool_or("present"), F.lit(False)).alias("any_present"))


# Retrieval


@registered("""with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0), s as (select q.query_id, v.vec_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 6) as similarity from q join embeddings v on q.query_id <> v.vec_id),
  r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s) select * from r where rank <= 10""")
def r01_cosine_top_k(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.cosine_top_k(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, 10)


@registered("""with q as (select vec_id as query_id, label, embedding::double[] as e from embeddings where vec_id % 50 = 0), s as (select q.query_id, v.vec_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 6) as similarity from q join embeddings v on q.query_id <> v.vec_id and q.label = v.label),
  r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s) select * from r where rank <= 5""")
def r01_scoped_top_k(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return retrieval.cosine_top_k(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, 5, same_scope="label")


_RANKED = """with q as (select vec_id as query_id, label, embedding::double[] as e from embeddings where vec_id % 50 = 0), s as (select q.query_id, v.vec_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 6) as similarity from q join embeddings v on q.query_id <> v.vec_id),
  r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s), ranked as (select * from r where rank <= 20),
  g as (select q.query_id, v.vec_id from q join embeddings v on q.label = v.label and q.query_id <> v.vec_id) """


def _ranked(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.cosine_top_k(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, 20)


def _gold(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return q.join(v, "label").where("query_id <> vec_id").select("query_id", "vec_id")


@registered(_RANKED + """, h as (select ranked.query_id, rank, g.vec_id is not null as hit from ranked left join g on ranked.query_id = g.query_id and ranked.vec_id = g.vec_id where rank <= 5), n as (select query_id, count(*) as n_gold from g group by 1)
  select n.query_id, n_gold, count(*) filter (where hit) as n_found, round(count(*) filter (where hit) / n_gold, 6) as recall, round(count(*) filter (where hit) / greatest(count(*), 1), 6) as precision,
  round(coalesce(1.0 / min(case when hit then rank end), 0), 6)::double as mrr from n join h using (query_id) group by 1, 2""")
def r08_stage_metrics(spark, d):
    return retrieval.stage_metrics(_ranked(spark, d), _gold(spark, d), 5)


@registered(_RANKED + """, located as (select g.query_id, ranked.rank from g left join ranked on ranked.query_id = g.query_id and ranked.vec_id = g.vec_id)
  select query_id, case when count(*) filter (where rank <= 5) = count(*) then 'none' when count(*) filter (where rank <= 20) < count(*) then 'recall_failure' else 'rank_failure' end as failure from located group by 1""")
def r09_failure_kinds(spark, d):
    return retrieval.failure_kinds(_ranked(spark, d), _gold(spark, d), 20, 5)


# Aggregations


def _scored(spark, d):
    return table(spark, d, "customer").withColumn("score", F.col("c_acctbal") / 10000)


_SCORED = "scored as (select *, c_acctbal / 10000 as score from customer)"


@registered(f"with {_SCORED} select coalesce(c_mktsegment, 'None') as axis, count(*) as n, round(avg(score), 4) as mean_score, round(100.0 / count(*), 4)::double as points_per_item, count(*) >= 5 as reliable from scored group by 1")
def a01_cell_report(spark, d):
    return reports.cells(_scored(spark, d), "c_mktsegment", "score")


@registered(f"""with {_SCORED}, c as (select coalesce(c_mktsegment, 'None') as axis, count(*) as n, round(avg(score), 4) as m from scored group by 1), g as (select * from (values ('BUILDING', 0.4::double), ('MACHINERY', 0.9::double), ('NOTHING', 0.1::double)) v(axis, least))
  select g.axis, g.least, coalesce(c.n, 0) as n, case when c.n is null then 'no_items' when c.m >= g.least then 'pass' else 'FAIL' end as gate from g left join c using (axis)""")
def a02_gates(spark, d):
    least = spark.createDataFrame([("BUILDING", 0.4), ("MACHINERY", 0.9), ("NOTHING", 0.1)], "axis string, least double")
    return reports.gates(reports.cells(_scored(spark, d), "c_mktsegment", "score"), least)


_W = "w as (select * from (values ('1-URGENT', 5.0::double), ('2-HIGH', 3.0::double), ('3-MEDIUM', 1.0::double), ('5-LOW', 0.0::double)) v(o_orderpriority, weight))"


@registered(f"with {_W} select round(sum(o_totalprice * weight) / sum(weight), 6) as weighted_mean, count(*) as n from orders join w using (o_orderpriority) where weight > 0")
def a03_weighted_mean(spark, d):
    w = spark.createDataFrame([("1-URGENT", 5.0), ("2-HIGH", 3.0), ("3-MEDIUM", 1.0), ("5-LOW", 0.0)], "o_orderpriority string, weight double")
    return reports.weighted_mean(table(spark, d, "orders"), w, "o_orderpriority", "o_totalprice")


@registered("""select count(*) as n, count(*) filter (where o_orderstatus = 'F') as n_done, round(count(*) filter (where o_orderstatus = 'F') / greatest(count(*), 1), 6) as rate_done,
  count(*) filter (where o_orderstatus = 'P' and o_totalprice < 1000) as n_small, round(count(*) filter (where o_orderstatus = 'P' and o_totalprice < 1000) / greatest(count(*), 1), 6) as rate_small from orders""")
def a05_rates(spark, d):
    return reports.rates(table(spark, d, "orders"), {"done": F.col("o_orderstatus") == "F", "small": (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 1000)})


@registered("""with l as (select doc_id, max(abusive) as hi, min(abusive) as lo from abuse_labels group by 1) select x.source, l.lo as gold, l.hi as predicted, count(*) as n from l join documents x using (doc_id) group by 1, 2, 3""")
def a12_confusion(spark, d):
    lab = table(spark, d, "abuse_labels").groupBy("doc_id").agg(F.max("abusive").alias("predicted"), F.min("abusive").alias("gold"))
    return reports.confusion(lab.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source", "gold", "predicted")


@registered("""select event_type as metric, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(max(value) - min(value), 6) as spread from events group by 1 having count(value) >= 2""")
def a15_variance(spark, d):
    return reports.variance(table(spark, d, "events").withColumnRenamed("event_type", "metric"), "metric", "value")


@registered("""select round(corr(l_quantity, l_extendedprice), 6) as r, corr(l_quantity, l_extendedprice) >= 0.8 as usable from lineitem""")
def a16_correlation(spark, d):
    r = F.corr("l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").agg(F.round(r, 6).alias("r"), (r >= 0.8).alias("usable"))


@registered("""with h as (select event_type as metric, avg(value) filter (where event_id % 2 = 0) as old, avg(value) filter (where event_id % 2 = 1) as new, stddev_pop(value) as sd from events group by 1)
  select metric, round(new - old, 6) as delta, case when round(new - old, 6) <= -2 * sd then 'alarm' else 'ok' end as verdict from h""")
def a17_regression(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "metric")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("metric").agg(F.avg("value").alias("value"))
    return reports.regression(half(0), half(1), e.groupBy("metric").agg(F.stddev_pop("value").alias("sd")))


@registered("""select document_id, field_name, count(*) as n from extraction_rows where lower(coalesce(active, 'true')) <> 'false' group by 1, 2 having count(*) > 1""")
def a22_duplicate_cells(spark, d):
    return reports.duplicates(_rows(spark, d).where(C.active()), ["document_id", "field_name"])


@registered("""select document_id, count(distinct processed_sha256) as n_processed_sha256, count(distinct document_version) as n_document_version, count(distinct corpus_version) as n_corpus_version from chunks group by 1
  having count(distinct processed_sha256) > 1 or count(distinct document_version) > 1 or count(distinct corpus_version) > 1""")
def a24_invariants(spark, d):
    return reports.single_valued(table(spark, d, "chunks"), "document_id", ["processed_sha256", "document_version", "corpus_version"])


@registered("""select document_id, array_to_string(section_path, ' > ') as path, count(*) as n, bool_or(retrieval_eligible) as any_eligible, min(chunk_id) as first_chunk, max(chunk_id) as last_chunk from chunks group by 1, 2""")
def a26_location_groups(spark, d):
    return table(spark, d, "chunks").groupBy("document_id", F.array_join("section_path", " > ").alias("path")).agg(F.count("*").alias("n"), F.bool_or("retrieval_eligible").alias("any_eligible"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


@registered("""with l as (select block_type, length(text) as len, row_number() over (partition by block_type order by length(text)) - 1 as r, count(*) over (partition by block_type) as n from chunks where text is not null)
  select block_type, n, max(case when r = least(floor(n * 0.5), n - 1) then len end) as median, max(case when r = least(floor(n * 0.95), n - 1) then len end) as p95, max(len) as longest from l group by 1, 2""")
def a27_length_statistics(spark, d):
    c = table(spark, d, "chunks").select("block_type", F.length("text").cast("long").alias("len"))
    return reports.nearest_rank(c, ["block_type"], "len", {"median": 0.5, "p95": 0.95, "longest": 1.0})


@registered("""select l_returnflag, metric, value from (select l_returnflag, sum(l_quantity) as quantity, sum(l_extendedprice) as price, count(*)::double as n from lineitem group by 1) unpivot (value for metric in (quantity, price, n))""")
def a20_flatten(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.count("*").cast("double").alias("n"))
    return reports.flatten(g, ["l_returnflag"], ["quantity", "price", "n"])


@registered("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def a00_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02 00:00:00'"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


# Windows, sorts, samples


@registered("""select doc_id, pos, line, sum(case when replace(line, ' ', '') <> '' then 1 else 0 end) over (partition by doc_id order by pos) as paragraph_no from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null)""")
def w03_paragraph_numbers(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), "line")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return lines.withColumn("paragraph_no", F.sum((F.replace("line", F.lit(" "), F.lit("")) != "").cast("long")).over(w))


@registered("""select chunk_key, row_number() over (partition by document_id, chunking_version order by md_line_start nulls first, chunk_key) as seq, sum(case when block_type = 'table' then 1 else 0 end) over (partition by document_id, chunking_version order by md_line_start nulls first, chunk_key rows unbounded preceding) as table_no from chunks""")
def w05_sequence_numbers(spark, d):
    w = Window.partitionBy("document_id", "chunking_version").orderBy(F.asc_nulls_first("md_line_start"), "chunk_key")
    return table(spark, d, "chunks").select("chunk_key", F.row_number().over(w).cast("long").alias("seq"), F.sum(F.when(F.col("block_type") == "table", 1).otherwise(0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("table_no"))


@registered("""select doc_id, pos, count(*) filter (where hit) over (partition by doc_id order by pos rows between 6 preceding and 6 following) as near from (select doc_id, pos, line like '%사업%' as hit from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null))""")
def w08_proximity(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("line").contains("사업").cast("long").alias("hit"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-6, 6)
    return lines.select("doc_id", "pos", F.sum("hit").over(w).alias("near"))


@registered("""select document_id, chunk_key from (select document_id, chunk_key, row_number() over (partition by document_id order by length(coalesce(text, '')) desc, md_line_start nulls first, chunk_key) as r from chunks) where r = 1""")
def w10_representative(spark, d):
    best = F.max_by("chunk_key", F.struct(F.length(F.coalesce("text", F.lit(""))).alias("l"), (-F.coalesce(F.col("md_line_start"), F.lit(-1))).alias("s"), (-F.col("chunk_key")).alias("k")))
    return table(spark, d, "chunks").groupBy("document_id").agg(best.alias("chunk_key"))


@registered("""select doc_id, source, turn from (select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) as turn from documents) where turn <= 20""")
def w11_stratified_sample(spark, d):
    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return table(spark, d, "documents").select("doc_id", "source", F.row_number().over(w).cast("long").alias("turn")).where("turn <= 20")


# Text functions


@registered(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[mail]', 'g'), '[0-9]{6}-[1-4][0-9]{6}', '[id]', 'g'), '0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}', '[phone]', 'g') as redacted from documents""")
def f17_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", C.redact(F.col("text")).alias("redacted"))


@registered(r"""select chunk_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\|', ' ', 'g'), '(-{3,}|[#*`])', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as search_text from chunks""")
def c06_search_text(spark, d):
    return table(spark, d, "chunks").select("chunk_key", C.strip_markup(F.col("text")).alias("search_text"))


@registered(r"""select row_id, lower(regexp_replace(answer_raw, '[^0-9A-Za-z가-힣]', '', 'g')) as key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer_raw, '\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|【[^【】]*】', '', 'g'), '\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|【[^【】]*】', '', 'g'), '\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|【[^【】]*】', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as bare from extraction_rows""")
def f13_keys(spark, d):
    return _rows(spark, d).select("row_id", C.expression_key(F.col("answer_raw")).alias("key"), C.strip_brackets(F.col("answer_raw")).alias("bare"))


@registered(r"""select row_id, trim(regexp_replace(answer_raw, '^\s*(?:[0-9]+[.)]|[가-하][.)]|[-○●■□◦▪※*•])\s*', '')) as value, case when answer_raw is null then '' else concat_ws(',', case when answer_raw like '%이내%' then '이내' end, case when answer_raw like '%이상%' then '이상' end, case when answer_raw like '%이하%' then '이하' end,
  case when answer_raw like '%초과%' then '초과' end, case when answer_raw like '%미만%' then '미만' end, case when answer_raw like '%VAT%' then 'VAT' end) end as conditions from extraction_rows""")
def f15_values(spark, d):
    return _rows(spark, d).select("row_id", C.strip_enumerator(F.col("answer_raw")).alias("value"), C.amount_conditions(F.col("answer_raw")).alias("conditions"))


@registered(r"""with m as (select row_id, regexp_extract(answer_raw, '((?:19|20)[0-9]{2})[-./년 ]+([0-9]{1,2})[-./월 ]+([0-9]{1,2})', ['y', 'm', 'd']) as p from extraction_rows where field_name = '공고일')
  select row_id, case when p.y <> '' and cast(nullif(p.m, '') as int) between 1 and 12 and cast(nullif(p.d, '') as int) between 1 and 31 then concat_ws('-', p.y, lpad(p.m, 2, '0'), lpad(p.d, 2, '0')) end as day from m""")
def f41_loose_dates(spark, d):
    return _rows(spark, d).where(F.col("field_name") == "공고일").select("row_id", C.loose_date(F.col("answer_raw")).alias("day"))


@registered("""select chunk_key, try_cast(regexp_extract(chunk_id, '-([0-9]+)$', 1) as int) as ordinal, sha256(coalesce(text, '')) as digest, array_to_string(list_filter(section_path, lambda x: x is not null and x <> ''), ' > ') as section from chunks""")
def f57_chunk_coordinates(spark, d):
    return table(spark, d, "chunks").select("chunk_key", C.ordinal(F.col("chunk_id")).alias("ordinal"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), C.section(F.col("section_path")).alias("section"))


@registered()
def f31_query_amounts(spark, d):
    from jangbu.functions.amounts import graded_amount_udf, query_amount_udf

    return _rows(spark, d).where(F.col("field_name") == "예산").select("row_id", query_amount_udf("answer_raw").alias("amount"), graded_amount_udf("answer_raw").alias("graded"))


# Scores, contracts, names


@registered(f"""with {_CELLS}, gold as (select distinct document_id from cur where field_name = '예산' and status = 'value_present'), got as (select distinct document_id from cur where field_name = '사업기간' and status = 'value_present'),
  s as (select count(*) filter (where g.document_id is not null and t.document_id is not null) as hit, count(g.document_id) as n_gold, count(t.document_id) as n_got from gold g full outer join got t using (document_id))
  select n_gold, n_got, hit, round(case when n_gold = 0 then case when n_got = 0 then 1 else 0 end else 0.7 * hit / n_gold + 0.3 * hit / greatest(n_got, 1) end, 6)::double as score from s""")
def g01_document_set(spark, d):
    cells = selection.current_cells(_rows(spark, d)).where(C.status_is("present"))
    g = cells.where(F.col("field_name") == "예산").select("document_id", F.lit(1).alias("g"))
    t = cells.where(F.col("field_name") == "사업기간").select("document_id", F.lit(1).alias("t"))
    s = g.join(t, "document_id", "full_outer").agg(F.count_if(F.col("g").isNotNull() & F.col("t").isNotNull()).alias("hit"), F.count("g").alias("n_gold"), F.count("t").alias("n_got"))
    blend = 0.7 * F.col("hit") / F.col("n_gold") + 0.3 * F.col("hit") / F.greatest("n_got", F.lit(1))
    return s.select("n_gold", "n_got", "hit", F.round(F.when(F.col("n_gold") == 0, (F.col("n_got") == 0).cast("double")).otherwise(blend), 6).alias("score"))


@registered("""with f as (select document_id, field_name, arg_min(answer_normalized, row_id) as v from extraction_rows where corpus_version = 'v1' and document_id is not null group by 1, 2), s as (select document_id, field_name, arg_min(answer_normalized, row_id) as v from extraction_rows where corpus_version = 'v2' and document_id is not null group by 1, 2)
  select field_name, count(*) filter (where f.document_id is not null) as n_gold, count(*) filter (where f.document_id is null) as n_extra, count(*) filter (where f.v is not distinct from s.v and f.document_id is not null and s.document_id is not null) as n_matched from f full outer join s using (document_id, field_name) group by 1""")
def g05_comparison(spark, d):
    at = lambda v, n: _rows(spark, d).where((F.col("corpus_version") == v) & F.col("document_id").isNotNull()).groupBy("document_id", "field_name").agg(F.min_by("answer_normalized", "row_id").alias(f"v{n}"), F.lit(True).alias(f"k{n}"))
    j = at("v1", 1).join(at("v2", 2), ["document_id", "field_name"], "full_outer")
    return j.groupBy("field_name").agg(F.count("k1").alias("n_gold"), F.count_if(F.col("k1").isNull()).alias("n_extra"), F.count_if(F.col("v1").eqNullSafe(F.col("v2")) & F.col("k1").isNotNull() & F.col("k2").isNotNull()).alias("n_matched"))


@registered("""select message, count(*) as n from (select unnest(list_filter([case when question is null or trim(question) = '' then 'no question' end, case when task_type is null then 'no task type' end, case when answer_type is null then 'no answer type' end,
  case when answer_normalized is null and answer_raw is not null then 'not normalised' end, case when document_id is null then 'no document' end], lambda x: x is not null)) as message from evaluation_items) group by 1""")
def v01_item_messages(spark, d):
    e = table(spark, d, "evaluation_items")
    say = {"no question": F.col("question").isNull() | (F.trim("question") == ""), "no task type": F.col("task_type").isNull(), "no answer type": F.col("answer_type").isNull(), "not normalised": F.col("answer_normalized").isNull() & F.col("answer_raw").isNotNull(), "no document": F.col("document_id").isNull()}
    found = F.filter(F.array(*(F.when(c, F.lit(m)) for m, c in say.items())), lambda x: x.isNotNull())
    return e.select(F.explode(found).alias("message")).groupBy("message").agg(F.count("*").alias("n"))


@registered("""select batch_no, doc_count as expected, coalesce(n, 0) as counted, coalesce(n, 0) = doc_count as ok from data_manifest left join (select batch_no, count(distinct document_id) as n from identity_records group by 1) using (batch_no)""")
def v08_manifest_counts(spark, d):
    n = table(spark, d, "identity_records").groupBy("batch_no").agg(F.countDistinct("document_id").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return table(spark, d, "data_manifest").join(n, "batch_no", "left").select("batch_no", F.col("doc_count").alias("expected"), k.alias("counted"), (k == F.col("doc_count")).alias("ok"))


@registered("""with t as (select distinct document_id, token from (select document_id, unnest(string_split(project_name, ' ')) as token from identity_records where document_id is not null) where length(token) >= 3) select token, min(document_id) as document_id from t group by 1 having count(*) = 1""")
def d05_alias_tokens(spark, d):
    """Words of project names that name one document only."""
    t = table(spark, d, "identity_records").where("document_id is not null").select("document_id", F.explode(F.split("project_name", " ")).alias("token")).where("length(token) >= 3").distinct()
    return t.groupBy("token").agg(F.min("document_id").alias("document_id"), F.count("*").alias("n")).where("n = 1").drop("n")


@registered(r"""select item_key, id from (select item_key, unnest(regexp_extract_all(concat_ws(' ', question, answer_raw, document_id), 'RFP-[0-9]+')) as id from evaluation_items)""")
def d01_explicit_ids(spark, d):
    return table(spark, d, "evaluation_items").select("item_key", F.explode(F.expr("regexp_extract_all(concat_ws(' ', question, answer_raw, document_id), 'RFP-[0-9]+', 0)")).alias("id"))


@registered("""select case when regexp_matches(question, '비교|차이|각각') then 'compare' when regexp_matches(question, '모두|목록|어떤 사업|찾아') then 'select' when regexp_matches(question, '예산|기간|기한|배점|제출|마감') then 'extract' else 'qa' end as route, task_type, count(*) as n from evaluation_items where question is not null group by 1, 2""")
def q08_routes(spark, d):
    from jangbu.plans.router import route

    return table(spark, d, "evaluation_items").where("question is not null").groupBy(route(F.col("question")).alias("route"), "task_type").agg(F.count("*").alias("n"))


@registered("""select action, count(*) as n, count(*) filter (where problem is null) as n_valid, count(*) filter (where problem = 'no documents') as n_without_documents from (select approved_plan.action as action, case when approved_plan is null then 'no plan' when approved_plan.action is null then 'no action'
  when approved_plan.document_scope = 'explicit' and len(coalesce(approved_plan.document_ids, [])) = 0 then 'no documents' end as problem from approved_memory) group by 1""")
def q09_plan_contracts(spark, d):
    from jangbu.plans.router import plan_problem

    m = table(spark, d, "approved_memory").withColumn("problem", plan_problem())
    return m.groupBy(F.col("approved_plan.action").alias("action")).agg(F.count("*").alias("n"), F.count_if(F.col("problem").isNull()).alias("n_valid"), F.count_if(F.col("problem") == "no documents").alias("n_without_documents"))


@registered()
def c11_chunk_documents(spark, d):
    from jangbu.operators.chunking import chunk_documents

    return chunk_documents(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), "title", "text"), 800, 80)


@registered()
def c05_table_quality(spark, d):
    from jangbu.operators.chunking import blank_ratio

    return table(spark, d, "chunks").where("block_type = 'table' and text is not null").select("chunk_key", blank_ratio("text").alias("blank_ratio"))
