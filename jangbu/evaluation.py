"""Queries over evaluation items, chunks and reports, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from jangbu.functions import columns as C
from jangbu.operators import diffs, extract, locate, reports, scoring, selection
from jangbu.runtime import table
from jangbu.registry import registered
from jangbu.tender import _CELLS, _SCOPE


@registered("""select document_id, count(*) as n_rows, max(document_version) as newest, bool_or(retrieval_eligible and deleted_at is null) as eligible, count(distinct duplicate_of_document_id) as n_originals from registry where document_id is not null group by 1""")
def s05_registry_scope(spark, d):
    r = table(spark, d, "registry").where("document_id is not null")
    return r.groupBy("document_id").agg(F.count("*").alias("n_rows"), F.max("document_version").alias("newest"), F.coalesce(F.bool_or(F.col("retrieval_eligible") & F.col("deleted_at").isNull()), F.lit(None).cast("boolean")).alias("eligible"), F.countDistinct("duplicate_of_document_id").alias("n_originals"))


@registered(r"""select distinct kind, key, document_id from (select 'org' as kind, lower(regexp_replace(buyer_org, '[^0-9A-Za-z가-힣]', '', 'g')) as key, document_id from identity_records union all select 'project', lower(regexp_replace(project_name, '[^0-9A-Za-z가-힣]', '', 'g')), document_id from identity_records) where length(key) >= 4 and document_id is not null""")
def s06_name_index(spark, d):
    from jangbu.operators.resolve import name_keys

    return name_keys(table(spark, d, "identity_records"))


@registered("""select m.batch_no, m.doc_count, m.raw_doc_count - m.md_doc_count as lost, round(m.load_rate, 6) as load_rate, len(coalesce(m.duplicate_doc_ids, [])) as n_duplicates, count(i.record_id) as n_records, count(i.record_id) filter (where i.metadata_found = 'true') as n_with_metadata
  from data_manifest m left join identity_records i using (batch_no) group by all""")
def s20_manifest(spark, d):
    i = table(spark, d, "identity_records").groupBy("batch_no").agg(F.count("*").alias("r"), F.count_if(F.col("metadata_found") == "true").alias("f"))
    m = table(spark, d, "data_manifest").join(i, "batch_no", "left")
    zero = F.lit(0)
    return m.select("batch_no", "doc_count", (F.col("raw_doc_count") - F.col("md_doc_count")).alias("lost"), F.round("load_rate", 6).alias("load_rate"), F.size(F.coalesce("duplicate_doc_ids", F.array().cast("array<string>"))).cast("long").alias("n_duplicates"), F.coalesce("r", zero).alias("n_records"), F.coalesce("f", zero).alias("n_with_metadata"))


@registered(r"""with m as (select record_id, regexp_extract(bid_deadline_raw, '((?:19|20)[0-9]{2})[-./년 ]+([0-9]{1,2})[-./월 ]+([0-9]{1,2})', ['y', 'm', 'd']) as p from identity_records),
  t as (select record_id, case when p.y <> '' and cast(nullif(p.m, '') as int) between 1 and 12 and cast(nullif(p.d, '') as int) between 1 and 31 then concat_ws('-', p.y, lpad(p.m, 2, '0'), lpad(p.d, 2, '0')) end as day from m)
  select record_id, day, case when day is null then 'unknown' when day >= '2024-06-01' then 'open' else 'expired' end as state from t""")
def pred14_deadline_state(spark, d):
    i = table(spark, d, "identity_records").select("record_id", C.loose_date(F.col("bid_deadline_raw")).alias("day"))
    return i.select("record_id", "day", F.when(F.col("day").isNull(), "unknown").when(F.col("day") >= "2024-06-01", "open").otherwise("expired").alias("state"))


@registered("""select chunk_key, concat_ws(' | ', document_id, nullif(array_to_string(list_filter(section_path, lambda x: x is not null and x <> ''), ' > '), ''), location_label) as source, case when part > 0 and "of" > 1 then concat(part, '/', "of") end as piece from chunks""")
def pred22_source_strings(spark, d):
    c = table(spark, d, "chunks")
    piece = F.when((F.col("part") > 0) & (F.col("of") > 1), F.concat(F.col("part").cast("string"), F.lit("/"), F.col("of").cast("string")))
    return c.select("chunk_key", F.concat_ws(" | ", "document_id", F.nullif(C.section(F.col("section_path")), F.lit("")), "location_label").alias("source"), piece.alias("piece"))


@registered(f"""with {_CELLS} select i.item_key, coalesce(c.status, 'missing') as status, case when c.status = 'value_present' and c.answer_normalized = i.answer_normalized then 1.0 else 0.0 end::double as score
  from evaluation_items i left join cur c on i.document_id = c.document_id and i.field_tag = c.field_name""")
def j04_items_answers(spark, d):
    """Every item with its cell; items without one stay and score 0."""
    cells = selection.current_cells(table(spark, d, "extraction_rows")).select("document_id", F.col("field_name").alias("field_tag"), F.col("status").alias("s"), F.col("answer_normalized").alias("v"))
    j = table(spark, d, "evaluation_items").select("item_key", "document_id", "field_tag", "answer_normalized").join(cells, ["document_id", "field_tag"], "left")
    hit = (F.col("s") == "value_present") & (F.col("v") == F.col("answer_normalized"))
    return j.select("item_key", F.coalesce("s", F.lit("missing")).alias("status"), F.when(hit, 1.0).otherwise(0.0).alias("score"))


@registered("""with a as (select id, count(*) as n from evaluation_items where id is not null group by 1), b as (select question_id as id, count(*) as n from approved_memory where question_id is not null group by 1)
  select case when b.id is null then 'missing' when a.id is null then 'extra' when b.n > 1 then 'duplicate' else 'single' end as state, count(*) as n from a full outer join b using (id) group by 1""")
def j05_one_to_one(spark, d):
    a = table(spark, d, "evaluation_items").where("id is not null").groupBy("id").agg(F.count("*").alias("na"))
    b = table(spark, d, "approved_memory").where("question_id is not null").groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("nb"))
    state = F.when(F.col("nb").isNull(), "missing").when(F.col("na").isNull(), "extra").when(F.col("nb") > 1, "duplicate").otherwise("single")
    return a.join(b, "id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@registered(f"""with {_CELLS}, e as (select item_key, x.location.document as doc, x.field as field, x.location.line as line from (select item_key, unnest(evidence) as x from evaluation_items) where x.location.document is not null),
  by_cell as (select e.item_key, c.document_id || '/' || c.field_name as hit from e join cur c on e.doc = c.document_id and e.field = c.field_name where c.status = 'value_present'),
  by_line as (select e.item_key, cast(k.chunk_key as varchar) as hit from e join chunks k on e.doc = k.document_id and e.line between k.md_line_start and k.md_line_end)
  select item_key, count(distinct hit) as n_hits from (select * from by_cell union all select * from by_line) group by 1""")
def j07_evidence_citations(spark, d):
    """Evidence met by a table cell or by a chunk that holds its line: two joins on keys, no join on "or"."""
    e = table(spark, d, "evaluation_items").select("item_key", F.explode("evidence").alias("x")).select("item_key", F.col("x.location.document").alias("doc"), F.col("x.field").alias("field"), F.col("x.location.line").alias("line")).where("doc is not null")
    c = selection.current_cells(table(spark, d, "extraction_rows")).where(C.status_is("present")).select(F.col("document_id").alias("doc"), F.col("field_name").alias("field"))
    k = table(spark, d, "chunks").select(F.col("document_id").alias("doc"), "chunk_key", "md_line_start", "md_line_end")
    by_cell = e.join(c, ["doc", "field"]).select("item_key", F.concat_ws("/", "doc", "field").alias("hit"))
    by_line = locate.covering(e, k, "doc", "line", "md_line_start", "md_line_end").select("item_key", F.col("chunk_key").cast("string").alias("hit"))
    return by_cell.unionByName(by_line).groupBy("item_key").agg(F.countDistinct("hit").alias("n_hits"))


@registered("""select e.registry_version, e.corpus_version, count(distinct e.document_id) as n_documents, count(distinct e.document_id) filter (where r.document_id is null) as n_unknown from extraction_rows e left join (select distinct document_id from registry) r using (document_id) group by 1, 2""")
def j12_table_registry(spark, d):
    r = table(spark, d, "registry").select("document_id").distinct().withColumn("k", F.lit(1))
    j = table(spark, d, "extraction_rows").select("registry_version", "corpus_version", "document_id").distinct().join(r, "document_id", "left")
    return j.groupBy("registry_version", "corpus_version").agg(F.countDistinct("document_id").alias("n_documents"), F.countDistinct(F.when(F.col("k").isNull(), F.col("document_id"))).alias("n_unknown"))


@registered("""select o.org_id, p.org_id as inside_of from buyer_orgs o join buyer_orgs p on o.org_id <> p.org_id and contains(replace(p.official_name, ' ', ''), replace(o.region || o.org_type, ' ', ''))""")
def j18_names_inside_names(spark, d):
    """Organisations whose bare name stands inside another's; the list is fixed at 260 rows, so one side is broadcast."""
    o = table(spark, d, "buyer_orgs")
    bare = lambda c: F.regexp_replace(c, " ", "")
    a, b = o.select("org_id", bare(F.concat("region", "org_type")).alias("key")), o.select(F.col("org_id").alias("inside_of"), bare(F.col("official_name")).alias("name"))
    return b.join(F.broadcast(a), F.contains(b.name, a.key) & (a.org_id != b.inside_of)).select("org_id", "inside_of")


@registered("""with g as (select item_key, location.document as document_id, location.section as section from evaluation_items where location.document is not null and location.section is not null), c as (select document_id, section_path[len(section_path)] as section, chunk_key from chunks)
  select g.item_key, count(distinct c.chunk_key) as n_chunks, min(c.chunk_key) as first_chunk from g join c using (document_id, section) group by 1""")
def j25_gold_chunks(spark, d):
    g = table(spark, d, "evaluation_items").select("item_key", F.col("location.document").alias("document_id"), F.col("location.section").alias("section")).where("section is not null")
    c = table(spark, d, "chunks").select("document_id", F.try_element_at("section_path", F.lit(-1)).alias("section"), "chunk_key")
    return g.join(c, ["document_id", "section"]).groupBy("item_key").agg(F.countDistinct("chunk_key").alias("n_chunks"), F.min("chunk_key").alias("first_chunk"))


@registered("""with l as (select chunking_version, cast(chunk_size as varchar) as chunk_size, cast(chunk_overlap as varchar) as chunk_overlap, preprocess_version, corpus_version, registry_version, extraction_version from index_tags), u as (select * from l unpivot (value for axis in (chunk_size, chunk_overlap, preprocess_version, corpus_version, registry_version, extraction_version)))
  select a.chunking_version as before, b.chunking_version as after, count(*) filter (where a.value <> b.value) as n_changed, count(*) filter (where a.value <> b.value) <= 1 as clean from u a join u b on a.axis = b.axis and a.chunking_version < b.chunking_version group by 1, 2""")
def a18_changed_axes(spark, d):
    t = table(spark, d, "index_tags").select("chunking_version", F.col("chunk_size").cast("string"), F.col("chunk_overlap").cast("string"), "preprocess_version", "corpus_version", "registry_version", "extraction_version")
    u = reports.flatten(t, ["chunking_version"], t.columns[1:])
    a, b = u.alias("a"), u.alias("b")
    j = a.join(b, (F.col("a.metric") == F.col("b.metric")) & (F.col("a.chunking_version") < F.col("b.chunking_version")))
    n = F.count_if(F.col("a.value") != F.col("b.value"))
    return j.groupBy(F.col("a.chunking_version").alias("before"), F.col("b.chunking_version").alias("after")).agg(n.alias("n_changed"), (n <= 1).alias("clean"))


@registered("""with m as (select batch_no, load_rate, csv_decode_failure_rows, encoding_corruption_count, zero_table_doc_count, doc_count from data_manifest)
  select batch_no, concat_ws(',', case when load_rate < 0.99 then 'load' end, case when csv_decode_failure_rows > 0 then 'decode' end, case when encoding_corruption_count > 0 then 'encoding' end, case when zero_table_doc_count > 0.2 * doc_count then 'tables' end) as warnings from m""")
def a32_data_warnings(spark, d):
    c = F.col
    rules = {"load": c("load_rate") < 0.99, "decode": c("csv_decode_failure_rows") > 0, "encoding": c("encoding_corruption_count") > 0, "tables": c("zero_table_doc_count") > 0.2 * c("doc_count")}
    return table(spark, d, "data_manifest").select("batch_no", F.concat_ws(",", *(F.when(r, F.lit(n)) for n, r in rules.items())).alias("warnings"))


@registered("""with q as (select * from (values ('selection', 100), ('extraction', 100), ('qa', 100)) v(task_type, quota)), n as (select task_type, count(*) as n from evaluation_items group by 1) select q.task_type, q.quota, coalesce(n.n, 0) as n, coalesce(n.n, 0) - q.quota as excess from q left join n using (task_type)""")
def a23_quota(spark, d):
    q = spark.createDataFrame([("selection", 100), ("extraction", 100), ("qa", 100)], "task_type string, quota int")
    n = table(spark, d, "evaluation_items").groupBy("task_type").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return F.broadcast(q).join(n, "task_type", "left").select("task_type", "quota", k.alias("n"), (k - F.col("quota")).alias("excess"))


@registered("""select memory_key, len(list_distinct(list_filter(coalesce(approved_plan.document_ids, []), lambda x: x is not null))) as n_ids, len(coalesce(approved_plan.requested_fields, [])) as n_fields,
  array_to_string(list_sort(list_distinct(list_filter(coalesce(approved_plan.document_ids, []), lambda x: x is not null))), ',') as ids from approved_memory""")
def o01_sorted_ids(spark, d):
    ids = F.array_distinct(F.filter(F.coalesce("approved_plan.document_ids", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return table(spark, d, "approved_memory").select("memory_key", F.size(ids).cast("long").alias("n_ids"), F.size(F.coalesce("approved_plan.requested_fields", F.array().cast("array<string>"))).cast("long").alias("n_fields"), F.array_join(F.array_sort(ids), ",").alias("ids"))


@registered("""with d as (select item_key, list_distinct(list_filter(list_transform(coalesce(evidence, []), lambda e: e.location.document), lambda x: x is not null)) as got, case when document_id is null or trim(document_id) = '' then [] else [document_id] end as gold from evaluation_items)
  select item_key, len(list_filter(gold, lambda x: not list_contains(got, x))) as n_missing, len(list_filter(got, lambda x: not list_contains(gold, x))) as n_extra,
  round(case when len(gold) = 0 then case when len(got) = 0 then 1 else 0 end else 0.7 * len(list_intersect(gold, got)) / len(gold) + 0.3 * len(list_intersect(gold, got)) / greatest(len(got), 1) end, 6)::double as score from d""")
def u03_missing_and_extra(spark, d):
    got = F.array_distinct(F.filter(F.coalesce("evidence.location.document", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    gold = F.when(F.col("document_id").isNull() | (F.trim("document_id") == ""), F.array().cast("array<string>")).otherwise(F.array("document_id"))
    e = table(spark, d, "evaluation_items").select("item_key", got.alias("got"), gold.alias("gold"))
    return e.select("item_key", F.size(F.array_except("gold", "got")).cast("long").alias("n_missing"), F.size(F.array_except("got", "gold")).cast("long").alias("n_extra"), F.round(scoring.set_score(F.col("gold"), F.col("got")), 6).alias("score"))


@registered("""select status, field_name, count(*) as n from (select row_id, document_id, field_name, status, row_number() over (partition by document_id, field_name, status, answer_raw order by row_id) as r from extraction_rows) where r = 1 group by 1, 2""")
def u04_first_of_repeats(spark, d):
    return table(spark, d, "extraction_rows").groupBy("document_id", "field_name", "status", "answer_raw").agg(F.min("row_id").alias("row_id")).groupBy("status", "field_name").agg(F.count("*").alias("n"))


@registered("""select doc_id, nfc_normalize(text) = text as composed, length(nfc_normalize(text)) as n_composed from documents where text is not null""")
def f01_composed_forms(spark, d):
    from jangbu.functions.unicode import nfc

    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", nfc("text").alias("c"))
    return t.select("doc_id", (F.col("c") == F.col("text")).alias("composed"), F.length("c").cast("long").alias("n_composed"))


@registered("""select row_id, case when answer_raw is null then null when not regexp_matches(answer_raw, '어느|무엇을 말씀|구체적으로|확인 부탁') and regexp_matches(answer_raw, '찾을 수 없|확인이 필요|확인되지|알 수 없') then 'abstention' else 'other' end as kind, answer_raw is null or trim(answer_raw) in ('', '[]', '{}') as is_empty from extraction_rows""")
def f19_response_kinds(spark, d):
    kind = F.when(F.col("answer_raw").isNull(), F.lit(None)).when(C.response_kind(F.col("answer_raw")) == "abstention", "abstention").otherwise("other")
    return table(spark, d, "extraction_rows").select("row_id", kind.alias("kind"), (F.col("answer_raw").isNull() | F.trim("answer_raw").isin("", "[]", "{}")).alias("is_empty"))


@registered("""with c as (select chunk_key, document_id, true as active from chunks), named as (select distinct document_id from chunks where chunking_version = 'c5') select chunk_key, c.document_id, not coalesce(n.document_id is not null, false) as active from c left join named n using (document_id)
  union all select -chunk_key, document_id, true from chunks where chunking_version = 'c5'""")
def r02_soft_upsert(spark, d):
    c = table(spark, d, "chunks")
    index = c.select("chunk_key", "document_id", F.lit(True).alias("active"))
    return diffs.upsert_soft(index, c.where("chunking_version = 'c5'").select((-F.col("chunk_key")).alias("chunk_key"), "document_id"))


@registered(f"""with {_CELLS}, {_SCOPE}, p as (select s.document_id, max(case when field_name = '예산' then status end) as b, max(case when field_name = '사업기간' then status end) as t from scope s left join cur using (document_id) group by 1)
  select coalesce(b, 'missing') as budget, coalesce(t, 'missing') as span, count(*) as n from p group by 1, 2""")
def a31_pools(spark, d):
    cells = selection.current_cells(table(spark, d, "extraction_rows")).where(F.col("field_name").isin("예산", "사업기간")).groupBy("document_id").agg(F.max(F.when(F.col("field_name") == "예산", F.col("status"))).alias("b"), F.max(F.when(F.col("field_name") == "사업기간", F.col("status"))).alias("t"))
    p = selection.scope(table(spark, d, "registry")).join(cells, "document_id", "left")
    return p.groupBy(F.coalesce("b", F.lit("missing")).alias("budget"), F.coalesce("t", F.lit("missing")).alias("span")).agg(F.count("*").alias("n"))


@registered("""select d.source, d.lang, count(*) as n, count(*) filter (where text is null or replace(text, ' ', '') = '') as n_blank, count(*) - count(distinct text) as n_repeated, max(n_chars) as longest, count(*) filter (where n_chars <> coalesce(length(text), 0)) as n_miscounted from documents d group by 1, 2""")
def v08_corpus_checks(spark, d):
    x = table(spark, d, "documents")
    return x.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.replace("text", F.lit(" "), F.lit("")) == "")).alias("n_blank"), (F.count("*") - F.countDistinct("text")).alias("n_repeated"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") != F.coalesce(F.length("text"), F.lit(0))).alias("n_miscounted"))


@registered("""select x.doc_id, o.org_id from documents x join buyer_orgs o on contains(x.text, o.official_name)""")
def j17_org_mentions(spark, d):
    """Documents that name an organisation officially; the 260 names are matched by one automaton, not row against row."""
    from jangbu.operators.resolve import verbatim

    return verbatim(table(spark, d, "documents"), table(spark, d, "buyer_orgs").select(F.col("official_name").alias("key"), "org_id"), "doc_id", "text", "org_id")


@registered()
def e02_extracted_fields(spark, d):
    return extract.table(table(spark, d, "documents"))


@registered("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2""")
def t02_stream_counts(spark, d):
    """The streaming twin run to its end over the events file."""
    import uuid

    from jangbu.runtime import checkpoint_dir
    from jangbu.streaming.twins import counts

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"t02_{uuid.uuid4().hex}"
    q = counts(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@registered()
def g03_list_scores(spark, d):
    e = table(spark, d, "evaluation_items")
    items = lambda c: F.split(F.coalesce(c, F.lit("")), r"\s*[,;\n]\s*")
    return e.select("item_key", scoring.list_score(items(F.col("answer_normalized")), items(F.col("answer_raw"))).alias("score"))


@registered()
def f22_short_answers(spark, d):
    r = table(spark, d, "extraction_rows").where("answer_normalized is not null")
    return r.select("row_id", scoring.match_short_udf("answer_normalized", "answer_raw").alias("m")).select("row_id", "m.ok", "m.why")


@registered()
def d02_resolved_questions(spark, d):
    from jangbu.operators.resolve import name_keys, resolve

    return resolve(table(spark, d, "evaluation_items").select(F.col("item_key").alias("question_id"), "question"), name_keys(table(spark, d, "identity_records")))
