"""Queries that check evaluation items, chunks and an index against their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jangbu.functions import columns as C
from jangbu.operators import contracts, index, locate, selection
from jangbu.registry import registered
from jangbu.runtime import table
from jangbu.tender import _CELLS, _SCOPE


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return selection.current_cells(_t(spark, d, "extraction_rows"))


_EV = """ev as (select item_key, generate_subscripts(evidence, 1) - 1 as i, unnest(evidence) as x from evaluation_items), e as (select item_key, i, x.kind as kind, x.field as field, x.status as status, x.location.document as document_id, x.location.section as section, x.location.ref_no as ref_no, x.location.line as line from ev where x is not null)"""


@registered("""select item_key, concat_ws(',', case when id is null then 'no_id' end, case when trim(coalesce(question, '')) = '' then 'no_question' end, case when coalesce(task_type not in ('selection', 'extraction', 'qa', 'comparison'), true) then 'task_type' end,
  case when coalesce(answer_type not in ('value', 'list', 'summary', 'comparison', 'document_set', 'unanswerable'), true) then 'answer_type' end,
  case when not ((task_type = 'selection' and answer_type = 'document_set') or (task_type = 'extraction' and answer_type in ('value', 'list')) or (task_type = 'qa' and answer_type in ('value', 'list', 'summary', 'unanswerable', 'comparison')) or (task_type = 'comparison' and answer_type = 'comparison')) then 'combination' end,
  case when answer_type <> 'unanswerable' and answer_raw is null then 'no_answer' end, case when field_tag is not null and field_tag not in ('critical', 'major', 'minor') then 'field_tag' end) as problems from evaluation_items""")
def v01_item_schema(spark, d):
    return _t(spark, d, "evaluation_items").select("item_key", F.array_join(contracts.schema_problems(), ",").alias("problems"))


@registered(f"""with {_SCOPE}, g as (select item_key, task_type, answer_type, created_at, nullif(upper(trim(document_id)), '') as doc, list_distinct(list_filter(list_transform(coalesce(evidence, []), lambda e: upper(trim(e.location.document))), lambda x: x is not null and x <> '')) as docs from evaluation_items),
  k as (select distinct upper(trim(document_id)) as doc from registry where document_id is not null), s as (select distinct upper(trim(document_id)) as doc from scope), j as (select g.*, k.doc is not null as known, s.doc is not null as inside from g left join k using (doc) left join s using (doc))
  select item_key, unnest(list_filter([case when doc is not null and not known then 'S1_unknown' end, case when task_type = 'selection' and known and not inside then 'S1_out_of_scope' end, case when task_type = 'selection' and created_at is null then 'S2' end,
    case when doc is not null and len(list_filter(docs, lambda x: x <> doc)) > 0 then 'S3' end, case when answer_type = 'comparison' and len(docs) < 2 then 'S4' end], lambda x: x is not null)) as problem from j""")
def v03_item_scope(spark, d):
    r = _t(spark, d, "registry")
    return contracts.scope_problems(_t(spark, d, "evaluation_items"), r, selection.scope(r))


@registered(r"""with t as (select *, coalesce(answer_raw, '') as txt, string_split_regex(coalesce(answer_raw, ''), '\s*[,;\n]\s*') as points from evaluation_items)
  select item_key, concat_ws(',', case when answer_source is null then 'S6' end, case when answer_type <> 'unanswerable' and len(coalesce(evidence, [])) = 0 and location is null and txt <> '' then 'S7' end, case when answer_type = 'value' and (contains(txt, chr(10)) or length(txt) > 120) then 'S10_value' end,
  case when answer_type = 'list' and len(list_filter(points, lambda p: length(p) > 120)) > 0 then 'S10_list' end, case when answer_type = 'summary' and (txt = '' or len(list_filter(points, lambda p: length(p) > 40)) > 0) then 'S10_summary' end,
  case when regexp_matches(txt, '어느\s*(사업|공고|문서)|사업명을|무엇을\s*찾으시는|정확히\s*어떤') and answer_type <> 'unanswerable' then 'S14' end) as problems from t""")
def v04_item_consistency(spark, d):
    return _t(spark, d, "evaluation_items").select("item_key", F.array_join(contracts.consistency_problems(), ",").alias("problems"))


@registered(f"""with {_CELLS}, {_EV}, cov as (select distinct e.item_key, e.i from e join chunks c on e.document_id = c.document_id and e.line between c.md_line_start and c.md_line_end where e.kind = 'chunk'),
  j as (select e.*, cur.status as cell, cov.i is not null as covered from e left join cur on cur.document_id = e.document_id and cur.field_name = e.field left join cov on cov.item_key = e.item_key and cov.i = e.i),
  p as (select item_key, i, case when coalesce(kind, '?') not in ('chunk', 'table', 'identity') then 'unknown_kind' when (kind = 'table' and (document_id is null or field is null or status is null)) or (kind = 'identity' and (document_id is null or field is null)) or (kind = 'chunk' and (document_id is null or line is null)) then 'incomplete'
    when kind = 'table' and cell is null then 'no_cell' when kind = 'table' and cell <> status then 'other_status' when kind = 'identity' and field not in ('예산', '사업기간', '공고일') then 'no_identity_field' when kind = 'chunk' and not covered then 'no_chunk' end as problem from j)
  select * from p where problem is not null""")
def j13_missing_evidence(spark, d):
    return contracts.missing_evidence(_t(spark, d, "evaluation_items"), _cells(spark, d), ["예산", "사업기간", "공고일"], _t(spark, d, "chunks"))


@registered(f"""with {_EV}, c as (select document_id, location_label as ref_no, bool_or(retrieval_eligible) as ok from chunks group by 1, 2), g as (select item_key, count(*) filter (where kind <> 'chunk') as others, count(ok) as known, coalesce(bool_or(ok), false) as any_ok from e left join c using (document_id, ref_no) group by 1) select item_key from g where others = 0 and known > 0 and not any_ok""")
def v06_unretrievable_items(spark, d):
    return contracts.unretrievable(_t(spark, d, "evaluation_items"), _t(spark, d, "chunks"))


@registered(f"""with {_EV}, n as (select item_key, list_transform(regexp_extract_all(coalesce(answer_raw, ''), '[0-9][0-9,]{{2,}}'), lambda x: replace(x, ',', '')) as numbers from evaluation_items), c as (select document_id, location_label as ref_no, replace(coalesce(text, ''), ',', '') as text from chunks),
  g as (select item_key, bool_or(len(list_filter(numbers, lambda x: contains(text, x))) > 0) as found from (select distinct item_key, document_id, ref_no from e where kind = 'chunk') join c using (document_id, ref_no) join n using (item_key) where len(numbers) > 0 group by 1) select item_key from g where not found""")
def v06_irrelevant_evidence(spark, d):
    return contracts.irrelevant(_t(spark, d, "evaluation_items"), _t(spark, d, "chunks"))


@registered()
def v06_incompatible_values(spark, d):
    return contracts.incompatible(_t(spark, d, "evaluation_items"), _cells(spark, d))


@registered("""with s as (select item_key, lower(regexp_replace(q, '[^0-9A-Za-z가-힣]', '', 'g')) as k from (select item_key, question as q from evaluation_items union select item_key, answer_raw from evaluation_items)), t as (select doc_id, lower(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g')) as k from documents)
  select distinct item_key, doc_id from s join t on contains(t.k, s.k) where length(s.k) >= 12""")
def j14_items_in_texts(spark, d):
    """Items whose question or answer stands in a document."""
    return contracts.leaked(_t(spark, d, "evaluation_items"), _t(spark, d, "documents").where("text is not null"), "doc_id", "text")


@registered("""with f as (select * from evaluation_items where task_type <> 'qa'), p as (select * from evaluation_items where task_type = 'qa') select item_key, 'id' as shares from f where id in (select id from p) union all select item_key, 'question' from f where question in (select question from p where trim(question) <> '') union all select item_key, 'document_id' from f where document_id in (select document_id from p where trim(document_id) <> '')""")
def j15_final_and_practice(spark, d):
    """Selections and extractions as the final set, questions and answers as the one practised on."""
    e = _t(spark, d, "evaluation_items")
    return contracts.shared_with_practice(e.where("task_type <> 'qa'"), e.where("task_type = 'qa'"))


@registered(f"""with {_CELLS}, {_SCOPE}, x as (select distinct document_id from registry where document_id is not null except select document_id from scope), g as (select item_key, document_id from evaluation_items where task_type = 'selection' and document_id is not null) select item_key, document_id from g where document_id in (select document_id from x)""")
def j16_gold_out_of_scope(spark, d):
    """Gold documents of selections on the list of excluded documents."""
    excluded = selection.id_lists(_t(spark, d, "registry")).where("list = 'excluded'").select("document_id")
    return _t(spark, d, "evaluation_items").where("task_type = 'selection' and document_id is not null").select("item_key", "document_id").join(excluded, "document_id", "left_semi")


@registered("""with r as (select question_id as id, max(question) as q from approved_memory where question_id is not null group by 1) select item_key::varchar as row_key, coalesce(r.q, e.question) as question, r.q is not null as replaced from evaluation_items e left join r using (id) union all select 'unknown:' || id, null, null from r where id not in (select id from evaluation_items where id is not null)""")
def j20_replaced_by_id(spark, d):
    """Questions of items replaced by those of approved plans; plans of unknown items are reported, not dropped."""
    by = _t(spark, d, "approved_memory").where("question_id is not null").select(F.col("question_id").alias("id"), "question")
    merged, unknown = contracts.replaced(_t(spark, d, "evaluation_items").select("item_key", "id", "question"), by, "id", "question")
    return merged.select(F.col("item_key").cast("string").alias("row_key"), "question", "replaced").unionByName(unknown.select(F.concat(F.lit("unknown:"), "id").alias("row_key"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("boolean").alias("replaced")))


@registered("""with w as (select memory_key, pos - 1 as pos, x as document_id from (select memory_key, generate_subscripts(approved_plan.document_ids, 1) as pos, unnest(approved_plan.document_ids) as x from approved_memory) where x is not null), r as (select document_id, max(document_version) as newest from registry where document_id is not null group by 1) select memory_key, pos, document_id, newest from w left join r using (document_id)""")
def j21_documents_in_order(spark, d):
    """Documents of every plan in the order it names them, with their newest version."""
    wanted = _t(spark, d, "approved_memory").select("memory_key", F.posexplode("approved_plan.document_ids").alias("pos", "document_id")).where("document_id is not null").select("memory_key", F.col("pos").cast("long").alias("pos"), "document_id")
    r = _t(spark, d, "registry").where("document_id is not null").groupBy("document_id").agg(F.max("document_version").alias("newest"))
    return contracts.subset(r, wanted, "document_id")


@registered(f"""with p as (select document_id, min(answer_normalized) as v from extraction_rows where field_name = '예산' and status = 'value_present' and answer_normalized is not null and document_id is not null group by 1), f as (select document_id, min(answer_raw) as v from extraction_rows where field_name = '예산' and document_id is not null group by 1)
  select document_id, coalesce(p.v, f.v) as value, case when p.v is not null then 'preferred' else 'fallback' end as source from p full outer join f using (document_id)""")
def j22_preferred_values(spark, d):
    """Budgets as normalised where that was done, else as written."""
    r = _t(spark, d, "extraction_rows").where("field_name = '예산' and document_id is not null")
    return contracts.chosen(r.select("document_id", "status", F.col("answer_normalized").alias("value")), r.select("document_id", F.col("answer_raw").alias("value")), "document_id", "value", (F.col("status") == "value_present") & F.col("value").isNotNull())


@registered(f"""with {_CELLS}, dec as (select document_id, max(answer_normalized) as v from extraction_rows where field_name = '사업기간' and answer_normalized is not null and document_id is not null group by 1), b as (select document_id, answer_normalized as v from cur where field_name = '사업기간')
  select document_id, coalesce(dec.v, b.v) as answer_normalized, false as error from b left join dec using (document_id) union all select dec.document_id, dec.v, true from dec left join b using (document_id) where b.document_id is null or b.v is null or b.v = dec.v""")
def j23_overlaid_table(spark, d):
    """Decisions laid over the current cells of one field; those without a cell to change, and those that change nothing, are errors and come out beside the table."""
    from jangbu.operators import diffs

    base = _cells(spark, d).where("field_name = '사업기간'").select("document_id", "answer_normalized")
    dec = _t(spark, d, "extraction_rows").where("field_name = '사업기간' and answer_normalized is not null and document_id is not null").groupBy("document_id").agg(F.max("answer_normalized").alias("answer_normalized"))
    merged, error = diffs.overlay(base, dec, ["document_id"], "answer_normalized")
    return merged.withColumn("error", F.lit(False)).unionByName(error.join(dec, "document_id").withColumn("error", F.lit(True)))


_NAMED = {"budget_present": ("예산", "present"), "region_absent": ("지역제한", "absent"), "period_external": ("사업기간", "external"), "scoring_unresolved": ("평가 배점", "unresolved")}


@registered(f"""with {_CELLS}, {_SCOPE}, w as (select * from (values ('budget_present', '예산', ['value_present']), ('region_absent', '지역제한', ['field_absent']), ('period_external', '사업기간', ['external_reference']), ('scoring_unresolved', '평가 배점', ['extraction_failed', 'review_required'])) v(id, f, s))
  select w.id, c.document_id, c.field_name, c.status from cur c join w on c.field_name = w.f and list_contains(w.s, c.status) where c.document_id in (select document_id from scope)""")
def v10_built_items(spark, d):
    return contracts.built_items(_NAMED, _cells(spark, d), selection.scope(_t(spark, d, "registry")), C.STATUS_SETS)


_PROV = ["schema_version", "extraction_version", "corpus_version", "registry_version"]


@registered("""select document_id, concat_ws(',', case when count(*) filter (where schema_version is null) > 0 then 'no_schema_version' when count(*) filter (where upper(trim(schema_version)) = 'UNKNOWN') > 0 then 'unknown_schema_version' end, case when count(*) filter (where extraction_version is null) > 0 then 'no_extraction_version' when count(*) filter (where upper(trim(extraction_version)) = 'UNKNOWN') > 0 then 'unknown_extraction_version' end,
  case when count(*) filter (where corpus_version is null) > 0 then 'no_corpus_version' when count(*) filter (where upper(trim(corpus_version)) = 'UNKNOWN') > 0 then 'unknown_corpus_version' end, case when count(*) filter (where registry_version is null) > 0 then 'no_registry_version' when count(*) filter (where upper(trim(registry_version)) = 'UNKNOWN') > 0 then 'unknown_registry_version' end) as problems,
  count(*) filter (where schema_version is null or extraction_version is null or corpus_version is null or registry_version is null or 'UNKNOWN' in (upper(trim(schema_version)), upper(trim(extraction_version)), upper(trim(corpus_version)), upper(trim(registry_version)))) = 0 and count(distinct schema_version) = 1 and count(distinct extraction_version) = 1 and count(distinct corpus_version) = 1 and count(distinct registry_version) = 1 as reproducible from extraction_rows group by 1""")
def v09_document_provenance(spark, d):
    p = contracts.provenance_problems(_t(spark, d, "extraction_rows"), _PROV, ["document_id"])
    return p.select("document_id", F.array_join("problems", ",").alias("problems"), "reproducible")


@registered()
def v07_contract_report(spark, d):
    """All contracts in one report; the relevance of evidence is for people to review, and there is no practice file."""
    e, r, c = _t(spark, d, "evaluation_items"), _t(spark, d, "registry"), _t(spark, d, "chunks")
    cells = _cells(spark, d)
    return contracts.contract_report(
        {"C1": e.where(F.size(contracts.schema_problems()) > 0), "S1-S4": contracts.scope_problems(e, r, selection.scope(r)), "S6-S14": e.where(F.size(contracts.consistency_problems()) > 0), "S11": contracts.missing_evidence(e, cells, ["예산", "사업기간", "공고일"], c), "S12": contracts.unretrievable(e, c), "S13": contracts.irrelevant(e, c), "S15": contracts.incompatible(e, cells), "practice": None},
        review=("S13",),
    )


@registered("""with x as (select case when doc_count < 50 then 'few' end as a, case when load_rate < 0.99 then 'load' end as b, case when raw_doc_count <> md_doc_count then 'lost' end as c, case when encoding_corruption_count > 0 then 'encoding' end as e, batch_no, corpus_version, extraction_table_version from data_manifest), t as (select corpus_version, count(distinct chunking_version) as n from index_tags group by 1)
  select batch_no, concat_ws(',', a, b, c, e, case when t.n is null then 'no_index' end) as problems from x left join t using (corpus_version)""")
def a25_manifest_invariants(spark, d):
    """Batches against fixed counts and against the versions an index exists for."""
    m = _t(spark, d, "data_manifest").join(F.broadcast(_t(spark, d, "index_tags").groupBy("corpus_version").agg(F.countDistinct("chunking_version").alias("_n"))), "corpus_version", "left")
    c = F.col
    said = {"few": c("doc_count") < 50, "load": c("load_rate") < 0.99, "lost": c("raw_doc_count") != c("md_doc_count"), "encoding": c("encoding_corruption_count") > 0, "no_index": c("_n").isNull()}
    return m.select("batch_no", F.concat_ws(",", *(F.when(v, F.lit(k)) for k, v in said.items())).alias("problems"))


# Locations and the index


@registered("""with p as (select row_id, representative_location.document_id as doc, representative_location.line as line from extraction_rows where representative_location.line is not null), m as (select p.row_id, c.chunk_key, row_number() over (partition by p.row_id order by md_line_end - md_line_start, -md_line_start, c.chunk_key) as rn from p join chunks c on p.doc = c.document_id and p.line between c.md_line_start and c.md_line_end where md_line_start <= md_line_end)
  select p.row_id, c.chunk_id, concat_ws(' | ', c.document_id, c.location_label) as citation from p left join (select * from m where rn = 1) m using (row_id) left join chunks c on c.chunk_key = m.chunk_key""")
def j09_location_citations(spark, d):
    """Every located cell with the citation of the narrowest chunk that covers its line; none is invented where no chunk does."""
    c = _t(spark, d, "chunks")
    p = _t(spark, d, "extraction_rows").select("row_id", F.col("representative_location.document_id").alias("doc"), F.col("representative_location.line").alias("line")).where("line is not null")
    near = locate.narrowest(p, c.select("chunk_key", F.col("document_id").alias("doc"), "md_line_start", "md_line_end").where("doc is not null"), "doc", "line", "md_line_start", "md_line_end", "chunk_key", "row_id")
    return near.join(c.select("chunk_key", "chunk_id", F.nullif(F.concat_ws(" | ", "document_id", "location_label"), F.lit("")).alias("citation")), "chunk_key", "left").select("row_id", "chunk_id", F.when(F.col("chunk_key").isNull(), "").otherwise(F.coalesce("citation", F.lit(""))).alias("citation"))


@registered("""select chunking_version, concat_ws(',', case when chunk_size <> 600 then 'chunk_size_differs' end, case when embedding_provider <> 'local' then 'embedding_provider_differs' end, case when vector_dimension is distinct from (select max(len(embedding)) from embeddings) then 'dimension_differs' end) as problems from index_tags""")
def r04_index_tags(spark, d):
    """Tags against settings of which only some are given, and the dimension against the vectors."""
    dim = _t(spark, d, "embeddings").agg(F.max(F.size("embedding")).alias("_dim"))
    t = _t(spark, d, "index_tags").join(F.broadcast(dim), F.lit(True))
    return index.tag_problems(t, {"chunk_size": 600, "embedding_provider": "local"}, F.col("_dim")).select("chunking_version", F.array_join("problems", ",").alias("problems"))


@registered("""with r as (select chunking_version, min(corpus_version) as v, count(distinct corpus_version) as n from chunks group by 1) select t.chunking_version, case when coalesce(n, 0) > 1 or (t.corpus_version is not null and v is not null and t.corpus_version <> v) then 'conflict' when t.corpus_version is not null then 'declared:' || t.corpus_version when v is not null then 'records:' || v else 'settings:v1' end as lineage from index_tags t left join r using (chunking_version)""")
def r05_index_lineage(spark, d):
    r = _t(spark, d, "chunks").groupBy("chunking_version").agg(F.min("corpus_version").alias("v"), F.countDistinct("corpus_version").alias("n"))
    t = _t(spark, d, "index_tags").select("chunking_version", "corpus_version").join(r, "chunking_version", "left")
    return t.select("chunking_version", index.lineage(F.col("corpus_version"), F.col("v"), F.coalesce("n", F.lit(0)), F.lit("v1")).alias("lineage"))


@registered("""select chunk_key, coalesce(document_id not in (select document_id from registry where deleted_at is not null and document_id is not null), true) as active from chunks""")
def r03_soft_deleted(spark, d):
    """The index with withdrawn documents set inactive."""
    gone = _t(spark, d, "registry").where("deleted_at is not null and document_id is not null")
    return index.soft_delete(_t(spark, d, "chunks").select("chunk_key", "document_id", F.lit(True).alias("active")), gone).select("chunk_key", "active")


@registered("""with g as (select e.item_key, list_sort(list_distinct(list(c.chunk_key))) as k from evaluation_items e join chunks c on c.document_id = e.location.document and c.section_path[len(c.section_path)] = e.location.section group by 1) select item_key, array_to_string(coalesce(k, []), ',') as contexts, k is not null as forced from evaluation_items left join g using (item_key)""")
def r11_forced_contexts(spark, d):
    e = _t(spark, d, "evaluation_items")
    c = _t(spark, d, "chunks").select("document_id", F.try_element_at("section_path", F.lit(-1)).alias("section"), "chunk_key")
    gold = e.select("item_key", F.col("location.document").alias("document_id"), F.col("location.section").alias("section")).join(c, ["document_id", "section"]).select("item_key", "chunk_key")
    empty = F.array().cast("array<long>")
    return index.forced_contexts(e.select("item_key", empty.alias("contexts"), empty.alias("retrieved")), gold).select("item_key", F.array_join("contexts", ",").alias("contexts"), "forced")


@registered("""with x as (select (select max(len(embedding)) from embeddings) as d) select 'dimension' as problem, (select count(*) from embeddings, x where len(embedding) <> d) as n union all select 'duplicate', (select count(*) from (select chunk_id from chunks join embeddings on vec_id = chunk_key group by 1 having count(*) > 1)) union all select 'foreign', 0""")
def r02_upsert_contract(spark, d):
    """A delivery of the index to itself: no foreign ids, every repeated chunk id found."""
    v = _t(spark, d, "embeddings").join(_t(spark, d, "chunks").select(F.col("chunk_key").alias("vec_id"), "chunk_id", "document_id"), "vec_id").withColumn("active", F.lit(True))
    owner = v.groupBy("chunk_id").agg(F.count("*").alias("k")).where("k = 1").select("chunk_id")
    return index.upsert_problems(v.join(owner, "chunk_id", "left_semi"), v, "embedding")


# Windows


@registered("""with g as (select item_key, location.document as doc, location.section as section, location.line as line from evaluation_items where location.line is not null), r as (select item_key, c.chunk_key, row_number() over (partition by item_key order by c.chunk_key) as pos, g.section = c.section_path[len(c.section_path)] and g.line between c.md_line_start and c.md_line_end as hit from g join chunks c on c.document_id = g.doc)
  select g.item_key, coalesce(min(r.pos) filter (where r.hit), -1) as rank from g left join r using (item_key) group by 1""")
def w01_first_hit_ranks(spark, d):
    """Rank of the first chunk of an item's document, in order of the chunks, that its gold location lies in; -1 without one."""
    g = _t(spark, d, "evaluation_items").select("item_key", F.col("location.document").alias("document_id"), F.col("location.section").alias("section"), F.col("location.line").alias("line")).where("line is not null")
    c = _t(spark, d, "chunks").where("document_id is not null").withColumn("pos", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_key"))).select("document_id", "pos", F.try_element_at("section_path", F.lit(-1)).alias("sec"), "md_line_start", "md_line_end")
    hit = g.join(c, "document_id").where((F.col("section") == F.col("sec")) & F.col("line").between(F.col("md_line_start"), F.col("md_line_end"))).groupBy("item_key").agg(F.min("pos").alias("rank"))
    return g.select("item_key").join(hit, "item_key", "left").select("item_key", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))


@registered("""select chunk_key, sum(case when block_type = 'table' then 1 else 0 end) over (partition by document_id, chunking_version order by md_line_start nulls first, chunk_key rows unbounded preceding)::bigint as table_no from chunks""")
def w04_table_numbers(spark, d):
    w = Window.partitionBy("document_id", "chunking_version").orderBy(F.asc_nulls_first("md_line_start"), "chunk_key").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, d, "chunks").select("chunk_key", F.sum(F.when(F.col("block_type") == "table", 1).otherwise(0)).over(w).alias("table_no"))


@registered("""with t as (select memory_key, split_part(question_id, '-', 1) as session_id, reviewed_at, case when approved_plan.document_scope = 'specific_documents' then list_filter(approved_plan.document_ids, lambda x: x is not null)[1] end as own from approved_memory)
  select memory_key, session_id, own, coalesce(own, last_value(own ignore nulls) over (partition by session_id order by reviewed_at nulls first, memory_key rows between unbounded preceding and 1 preceding)) as active_document from t""")
def w06_active_documents(spark, d):
    """Questions in order: the last document named in a session is carried on, one's own goes before it, another session begins without any."""
    own = F.when(F.col("approved_plan.document_scope") == "specific_documents", F.get(F.filter("approved_plan.document_ids", lambda x: x.isNotNull()), F.lit(0)))
    t = _t(spark, d, "approved_memory").select("memory_key", F.substring_index("question_id", "-", 1).alias("session_id"), "reviewed_at", own.alias("own"))
    w = Window.partitionBy("session_id").orderBy(F.asc_nulls_first("reviewed_at"), "memory_key").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("memory_key", "session_id", "own", F.coalesce("own", F.last("own", ignorenulls=True).over(w)).alias("active_document"))


@registered("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from documents where text is not null) select doc_id, pos, count(*) over (partition by doc_id order by pos rows between 6 preceding and 2 following) as n_lines, sum(length(line)) over (partition by doc_id order by pos rows between 6 preceding and 2 following)::bigint as n_chars from l""")
def w09_line_contexts(spark, d):
    """The window of six lines before and two behind every line."""
    e = _t(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(-6, 2)
    return e.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), F.count("*").over(w).alias("n_lines"), F.sum(F.length("line")).over(w).alias("n_chars"))


@registered("""with v as (select memory_key, list_distinct(list_filter(coalesce(approved_plan.requested_fields, []), lambda x: x is not null)) as f from approved_memory) select memory_key, array_to_string(list_sort(list_filter(f, lambda k: len(list_filter(f, lambda o: o <> k and contains(o, k))) = 0)), ',') as kept from v""")
def d03_longest_fields(spark, d):
    from jangbu.operators.resolve import without_subsumed

    f = F.array_distinct(F.filter(F.coalesce("approved_plan.requested_fields", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return _t(spark, d, "approved_memory").select("memory_key", f.alias("f")).select("memory_key", F.array_join(F.array_sort(without_subsumed(F.col("f"))), ",").alias("kept"))
