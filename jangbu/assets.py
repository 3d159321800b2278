"""Queries that write tables through the sinks and read them back through the readers, and what comes of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jangbu.functions import columns as C
from jangbu.operators import diffs, selection
from jangbu.registry import registered
from jangbu.runtime import checkpoint_dir, stream, table
from jangbu.sources import assets, readers, sinks
from jangbu.streaming import twins
from jangbu.tender import _SCOPE

STATUSES = ("value_present", "field_absent", "external_reference", "not_disclosed", "conflict", "extraction_failed", "review_required")


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV files that begin with a byte-order mark and a header, as spreadsheets write them."""
    names = df.columns

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for b in batches:
            text = b.to_csv(index=False, header=first, columns=names, lineterminator="\n").rstrip("\n")
            yield pd.DataFrame({"value": [("﻿" if first else "") + text]})
            first = False

    df.mapInPandas(lines, "value string").where("value <> ''").write.text(path)


# Scans


@registered("""select doc_id, source, lang, n_chars from documents""")
def s01_json_lines(spark, d):
    path = _place(spark, "s01")
    table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").write.json(path)
    return readers.checked_jsonl(spark, path, "doc_id long, source string, lang string, n_chars long")


@registered("""select count(*) as n_bad, min(line_no)::bigint as first_line from (select 3 as line_no)""")
def s01_bad_lines(spark, d):
    """A file whose third line is cut off: which line it is."""
    path = _place(spark, "s01")
    spark.createDataFrame([('{"id": 1}\n{"id": 2}\n{"id": \n{"id": 4}',)], "value string").coalesce(1).write.text(path)
    return readers.bad_lines(spark, path, "id long").agg(F.count("*").alias("n_bad"), F.min("line_no").alias("first_line"))


@registered("""select registry_row, document_id, output_filename from registry""")
def s02_json_stream(spark, d):
    """Pretty-printed objects one after another."""
    path = _place(spark, "s02")
    r = table(spark, d, "registry").select("registry_row", "document_id", "output_filename")
    r.select(F.to_json(F.struct(*r.columns), {"pretty": "true"}).alias("value")).write.text(path)
    return readers.json_stream(spark, path, "registry_row long, document_id string, output_filename string")


@registered("""select row_id, document_id, field_name, status, answer_raw from extraction_rows""")
def s03_field_table(spark, d):
    """Files with their rows under one member."""
    path = _place(spark, "s03")
    r = table(spark, d, "extraction_rows").select("row_id", "document_id", "field_name", "status", "answer_raw")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            yield pd.DataFrame({"value": [json.dumps({"rows": [{k: (None if v is None else v) for k, v in row.items()} for row in b.astype(object).where(b.notna(), None).to_dict("records")], "made_by": "x"}, ensure_ascii=False)], "part": [uuid.uuid4().hex]})

    r.mapInPandas(files, "value string, part string").write.partitionBy("part").text(path)
    return readers.rows_of(spark, f"{path}/*", "row_id:long,document_id:string,field_name:string,status:string,answer_raw:string")


@registered("""select 'no_key' as problem, count(*) filter (where document_id is null or field_name is null) as n from extraction_rows union all select 'unknown_status', count(*) filter (where status is null or status not in ('value_present', 'field_absent', 'external_reference', 'not_disclosed', 'conflict', 'extraction_failed', 'review_required')) from extraction_rows
  union all select 'value_without_status', count(*) filter (where status = 'field_absent' and answer_normalized is not null) from extraction_rows
  union all select 'several_active', count(*) from (select document_id, field_name from extraction_rows where lower(coalesce(active, 'true')) <> 'false' and document_id is not null and field_name is not null group by 1, 2 having count(*) > 1)""")
def s03_table_problems(spark, d):
    return readers.table_problems(table(spark, d, "extraction_rows"), STATUSES, active=C.active())


@registered("""select registry_row::varchar as registry_row, document_id, output_filename from registry""")
def s04_csv_with_mark(spark, d):
    path = _place(spark, "s04")
    _csv_with_mark(table(spark, d, "registry").select("registry_row", "document_id", "output_filename"), path)
    return readers.csv(spark, path, ["document_id"], "document_id").select("registry_row", "document_id", "output_filename")


@registered("""select registry_row, case when document_id is not null and coalesce(retrieval_eligible, false) and deleted_at is null then 'in_scope' when document_id is null then 'no_id' when deleted_at is not null then 'withdrawn' when duplicate_of_document_id is not null then 'duplicate' else 'not_eligible' end as part from registry""")
def s05_scope_split(spark, d):
    inside, outside = selection.scope_split(table(spark, d, "registry"))
    return inside.select("registry_row", F.lit("in_scope").alias("part")).unionByName(outside.select("registry_row", F.col("reason").alias("part")))


@registered("""select row_id::varchar as row_id, document_id, kind from extraction_rows, (values ('csv'), ('json')) v(kind)""")
def s07_table_by_suffix(spark, d):
    """One table as CSV and as JSON, read by the ending of its name."""
    r = table(spark, d, "extraction_rows").select("row_id", "document_id")
    a, b = _place(spark, "s07") + ".csv", _place(spark, "s07") + ".json"
    r.write.option("header", True).csv(a)
    r.select(F.struct("row_id", "document_id").alias("rows")).select(F.array("rows").alias("rows")).write.json(b)
    text = readers.table_by_suffix(spark, a, "", ["row_id", "document_id"]).select("row_id", "document_id", F.lit("csv").alias("kind"))
    member = spark.read.schema("rows array<struct<row_id:long,document_id:string>>").json(b).select(F.inline("rows"))
    return text.unionByName(member.select(F.col("row_id").cast("string").alias("row_id"), "document_id", F.lit("json").alias("kind")))


@registered(f"""with {_SCOPE}, r as (select distinct document_id from registry where document_id is not null), i as (select distinct document_id from identity_records where document_id is not null), t as (select distinct document_id from extraction_rows where document_id is not null), a as (select * from r union select * from i union select * from t)
  select document_id, document_id in (from r) as in_registry, document_id in (from i) as in_identity, document_id in (from t) as in_table, document_id in (from scope) and document_id in (from i) and document_id in (from t) as usable from a""")
def s08_selection_inputs(spark, d):
    return selection.selection_inputs(table(spark, d, "registry"), table(spark, d, "identity_records"), table(spark, d, "extraction_rows"))


@registered("""select 'batch_no' as name, max(batch_no)::varchar as value from data_manifest union all select chunking_version || '.chunk_size', chunk_size::varchar from index_tags union all select chunking_version || '.built', strftime(build_timestamp, '%Y-%m-%d %H:%M:%S') from index_tags where build_timestamp is not null""")
def s10_versions(spark, d):
    """Versions written as ``name : value`` and read back; values may hold colons."""
    path = _place(spark, "s10")
    t = table(spark, d, "index_tags")
    lines = table(spark, d, "data_manifest").agg(F.concat(F.lit("batch_no : "), F.max("batch_no").cast("string")).alias("value"))
    lines = lines.unionByName(t.select(F.concat("chunking_version", F.lit(".chunk_size : "), F.col("chunk_size").cast("string")).alias("value"))).unionByName(t.where("build_timestamp is not null").select(F.concat("chunking_version", F.lit(".built : "), F.date_format("build_timestamp", "yyyy-MM-dd HH:mm:ss")).alias("value")))
    lines.unionByName(spark.createDataFrame([("a line without one",)], "value string")).write.text(path)
    return readers.versions(spark, path)


@registered("""select 'version=' || max(chunking_version) as latest from chunks""")
def s11_latest_version(spark, d):
    path = _place(spark, "s11")
    table(spark, d, "chunks").select("chunk_key", F.col("chunking_version").alias("version")).write.partitionBy("version").parquet(path)
    return spark.createDataFrame([(assets.latest_folder(spark, path, "version=c*"),)], "latest string")


@registered("""select item_key, id, task_type, answer_type from evaluation_items""")
def s12_strict_items(spark, d):
    path = _place(spark, "s12")
    table(spark, d, "evaluation_items").select("item_key", "id", "task_type", "answer_type").write.json(path)
    return readers.strict_jsonl(spark, path, "item_key long, id string, task_type string, answer_type string", ("item_key",))


@registered("""select 'question' as key, count(question) as n from evaluation_items union all select 'task_type', count(task_type) from evaluation_items""")
def s12_unknown_members(spark, d):
    path = _place(spark, "s12")
    table(spark, d, "evaluation_items").select("item_key", "question", "task_type").write.json(path)
    return readers.unknown_keys(spark, path, "item_key long")


@registered("""select memory_key::varchar as memory_key, record_id, promotion_status from approved_memory where promotion_status = 'approved'""")
def s13_reviewed_decisions(spark, d):
    path = _place(spark, "s13")
    m = table(spark, d, "approved_memory").select("memory_key", "record_id", "promotion_status")
    m.where("promotion_status = 'approved'").write.option("header", True).csv(path)
    return readers.decisions(spark, path, ["memory_key"], reviewed="promotion_status")


@registered("""select document_id, location_label, min(chunk_key) as chunk_key, count(*) as n, sum(count(*)) over (partition by document_id)::bigint as n_of_document from chunks where document_id is not null group by 1, 2""")
def s14_chunk_lookup(spark, d):
    from jangbu.operators.locate import lookup

    return lookup(table(spark, d, "chunks"))


@registered("""select org_id::varchar as org_id, region, len(string_split(official_name, ' ')) as n_parts, official_name from buyer_orgs""")
def s15_profiles(spark, d):
    """Profiles with lists joined by semicolons, as written in spreadsheets."""
    path = _place(spark, "s15")
    o = table(spark, d, "buyer_orgs")
    _csv_with_mark(o.select("org_id", "region", F.concat_ws(";", F.split("official_name", " ")).alias("fields")), path)
    p = readers.csv(spark, path, ["org_id", "fields"])
    parts = F.filter(F.split("fields", r"\s*;\s*"), lambda x: x != "")
    return p.select("org_id", "region", F.size(parts).cast("long").alias("n_parts"), F.array_join(parts, " ").alias("official_name"))


@registered("""select * from (values ('chunking.overlap', '60'), ('chunking.size', '600'), ('index.top_k', '10'), ('reference_time', '2024-06-01')) v(name, value)""")
def s17_layered_settings(spark, d):
    """A base and an overlay whose values come from the index tags' first row."""
    t = table(spark, d, "index_tags").orderBy("chunking_version").limit(1).collect()[0]  # fixed: 5 rows
    s = assets.layered({"chunking": {"size": 1, "overlap": t.chunk_overlap}, "reference_time": "2024-06-01"}, {"chunking": {"size": t.chunk_size}, "index": {"top_k": 10}}, required=("chunking.size", "reference_time"))
    return spark.createDataFrame(assets.flattened(s), "name string, value string")


@registered("""select document_id, document_version, count(*) as n_places, count(distinct processed_sha256) as n_contents from registry where processed_sha256 is not null group by 1, 2 having count(distinct processed_sha256) > 1""")
def s18_conflicting_versions(spark, d):
    return assets.conflicting_versions(table(spark, d, "registry"), ["document_id", "document_version"], "processed_sha256")


@registered("""select document_id, case when bool_or(coalesce(retrieval_eligible, false) and deleted_at is null) then 'included' else 'excluded' end as list from registry where document_id is not null group by 1""")
def s19_id_lists(spark, d):
    return selection.id_lists(table(spark, d, "registry"))


@registered("""with r as (select batch_no, count(*) as n_records, count(distinct document_id) as n_documents, count(*) filter (where lower(trim(metadata_found)) in ('true', '1', 'yes')) as n_with_metadata, count(distinct case when document_id in (select document_id from extraction_rows) then document_id end) as n_covered from identity_records group by 1)
  select m.batch_no, m.doc_count, len(coalesce(m.duplicate_doc_ids, [])) as n_duplicates, coalesce(n_records, 0) as n_records, coalesce(n_documents, 0) as n_documents, coalesce(n_with_metadata, 0) as n_with_metadata, coalesce(n_covered, 0) as n_covered from data_manifest m left join r using (batch_no)""")
def s20_derived_manifest(spark, d):
    return selection.manifest(table(spark, d, "data_manifest"), table(spark, d, "identity_records"), table(spark, d, "extraction_rows"))


@registered("""select e.vec_id, c.chunk_id, len(e.embedding) as dimension from embeddings e join chunks c on e.vec_id = c.chunk_key""")
def s09_index_load(spark, d):
    from jangbu.operators.index import loaded

    return loaded(table(spark, d, "embeddings"), table(spark, d, "chunks").select(F.col("chunk_key").alias("vec_id"), "chunk_id")).drop("label")


# Sinks


@registered("""select chunk_key, chunk_id from chunks where chunk_id is not null""")
def k01_published_index(spark, d):
    """Published twice: the second output replaces the first whole; a third that breaks its contract changes nothing."""
    path = _place(spark, "k01")
    c = table(spark, d, "chunks").select("chunk_key", "chunk_id")
    sinks.publish(c.limit(0), path)
    sinks.publish(c.where("chunk_id is not null"), path, c.where("chunk_key is null"))
    try:
        sinks.publish(c.limit(0), path, spark.range(1))
    except ValueError:
        pass
    return spark.read.parquet(path)


@registered("""select document_id, count(*) as n from chunks where document_id is not null group by 1 having count(*) > 0""")
def k02_published_chunks(spark, d):
    """Chunks published after their contract: text lines in order, pieces within their number."""
    path = _place(spark, "k02")
    c = table(spark, d, "chunks").where("document_id is not null")
    sinks.publish(c.select("chunk_key", "document_id"), path, c.where("part > of or md_line_start > md_line_end"))
    return spark.read.parquet(path).groupBy("document_id").agg(F.count("*").alias("n"))


@registered("""select chunk_key, document_id, case when document_id in (select document_id from chunks where chunking_version = 'c5') then 'new' else 'old' end as edition from chunks where document_id is not null and (chunking_version = 'c5' or document_id not in (select document_id from chunks where chunking_version = 'c5' and document_id is not null))""")
def k03_refreshed_documents(spark, d):
    """Documents with a chunk of the newest version refreshed by those, all others kept."""
    path = _place(spark, "k03")
    c = table(spark, d, "chunks").where("document_id is not null").select("chunk_key", "document_id", "chunking_version")
    sinks.refresh_buckets(c.select("chunk_key", "document_id", F.lit("old").alias("edition")), path)
    sinks.refresh_buckets(c.where("chunking_version = 'c5'").select("chunk_key", "document_id", F.lit("new").alias("edition")), path)
    return spark.read.parquet(path).drop("bucket")


@registered("""select 'csv' as kind, count(*) as n, count(distinct document_id) as n_documents, min(row_id) as first_row from extraction_rows union all select 'json', count(*), count(distinct document_id), min(row_id) from extraction_rows union all select 'alias', count(distinct field_name), count(distinct field_name), min(length(field_name)) from extraction_rows""")
def k04_written_outputs(spark, d):
    """The field table as CSV and JSON in a fixed order, and its field names apart."""
    r = table(spark, d, "extraction_rows").select("row_id", "document_id", "field_name", "status")
    a, b, c = _place(spark, "k04"), _place(spark, "k04"), _place(spark, "k04")
    sinks.ordered_files(r, a, ["document_id", "row_id"])
    sinks.ordered_files(r, b, ["document_id", "row_id"], "json")
    sinks.one_file(r.select("field_name").distinct(), c, ["field_name"])  # twelve names
    schema = "row_id long, document_id string, field_name string, status string"
    said = lambda df, kind: df.agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"), F.min("row_id").alias("first_row")).select(F.lit(kind).alias("kind"), "n", "n_documents", "first_row")
    names = spark.read.schema("field_name string").json(c)
    return said(spark.read.schema(schema).option("header", True).csv(a), "csv").unionByName(said(spark.read.schema(schema).json(b), "json")).unionByName(names.agg(F.count("*").alias("n"), F.countDistinct("field_name").alias("n_documents"), F.min(F.length("field_name")).cast("long").alias("first_row")).select(F.lit("alias").alias("kind"), "n", "n_documents", "first_row"))


@registered("""select task_type as axis, count(*) as n from evaluation_items group by 1 union all select 'items', count(*) from evaluation_items""")
def k05_result_files(spark, d):
    """Results as JSON lines and their one-row report."""
    from jangbu.operators import reports

    a, b = _place(spark, "k05"), _place(spark, "k05")
    e = table(spark, d, "evaluation_items").select("item_key", "task_type", F.lit(1.0).alias("score"))
    e.write.json(a)
    read = readers.jsonl(spark, a, "item_key long, task_type string, score double")
    sinks.one_file(read.agg(F.count("*").alias("n")).withColumn("axis", F.lit("items")), b, ["axis"])
    return reports.cells(read, "task_type", "score").select("axis", "n").unionByName(readers.jsonl(spark, b, "n long, axis string").select("axis", "n"))


@registered("""select 'details' as output, count(*) as n from evaluation_items union all select 'responses', count(*) from evaluation_items union all select 'usage', count(distinct document_id) + count(distinct case when document_id is null then 1 end) from chunks union all select 'summary', count(distinct task_type) from evaluation_items""")
def k06_run_outputs(spark, d):
    """The four outputs of a run, each published whole."""
    from jangbu.grading import a30_usage_merged, responses

    e = table(spark, d, "evaluation_items")
    outputs = {"details": e.select("item_key", "question"), "responses": responses(spark, d).select("item_key", "answer"), "usage": a30_usage_merged(spark, d), "summary": e.groupBy("task_type").agg(F.count("*").alias("n"))}
    out = None
    for name, df in outputs.items():
        path = _place(spark, "k06")
        sinks.publish(df, path)
        n = spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@registered(r"""with b as (select lower(regexp_replace(official_name, '\s', '', 'g')) as k, org_id, official_name, region from buyer_orgs), dl as (select lower(regexp_replace(buyer_org, '\s', '', 'g')) as k, min(buyer_org) as name, count(*) as n from identity_records where buyer_org is not null and trim(buyer_org) <> '' group by 1)
  select b.org_id, coalesce(dl.name, b.official_name) as official_name, b.region from b full outer join dl using (k)""")
def k07_upserted_profiles(spark, d):
    """Delivered buyer names merged into the list by compacted name; columns the delivery does not have are kept."""
    i = table(spark, d, "identity_records").where("buyer_org is not null and trim(buyer_org) <> ''").withColumn("k", C.compact(F.col("buyer_org"))).groupBy("k").agg(F.min("buyer_org").alias("official_name")).drop("k")
    return diffs.upsert(table(spark, d, "buyer_orgs").select("org_id", "official_name", "region"), i, C.compact(F.col("official_name")))


@registered("""with s as (select item_key, id, task_type, case when document_id is null then 'FAIL' when answer_normalized is null then 'REVIEW' else 'PASS' end as verdict from evaluation_items) select item_key, id, verdict, count(*) over (partition by verdict) as n_of_verdict, count(*) over () as n_all from s where verdict <> 'PASS' """.replace("count(*) over ()", "(select count(*) from s)"))
def k09_listing(spark, d):
    """Items of two verdicts, with the totals of their verdict and of all."""
    from jangbu.operators.reports import listing

    e = table(spark, d, "evaluation_items").select("item_key", "id", F.when(F.col("document_id").isNull(), "FAIL").when(F.col("answer_normalized").isNull(), "REVIEW").otherwise("PASS").alias("verdict"))
    return listing(e, ["FAIL", "REVIEW"])


# Streams


@registered("""select user_id::varchar as session_id, event_id as turn, case when event_type = 'purchase' then event_id::varchar end as document_id, last_value(case when event_type = 'purchase' then event_id::varchar end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as active_document from events""")
def t01_active_documents(spark, d):
    """The stream of events run to its end: the last confirmed document of a session at every turn."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    turns = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("turn"), F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("document_id"))
    return twins.finished(twins.active_documents(turns, expire=False), _place(spark, "t01"), _place(spark, "t01c"))


@registered("""select user_id::varchar as item, event_id as step, round(value)::bigint as tokens, sum(coalesce(round(value), 0)) over (partition by user_id order by event_id)::bigint as used from events""")
def t02_usage_per_item(spark, d):
    """Tokens used so far, from 0 again for every item, over the stream of events."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    calls = e.select(F.col("user_id").cast("string").alias("item"), F.col("event_id").alias("step"), F.round("value").cast("long").alias("tokens"))
    return twins.finished(twins.usages(calls, expire=False), _place(spark, "t02"), _place(spark, "t02c"))


@registered("""select document_id, registered_at from (select document_id, max(registered_at) as registered_at from registry where registered_at is not null group by 1) """)
def t03_streamed_refresh(spark, d):
    """The registry streamed into a table of which each document keeps its newest row."""
    path = _place(spark, "t03")
    r = stream(spark, d, "registry").where("registered_at is not null").select("document_id", "registered_at")
    q = r.writeStream.foreachBatch(twins.merge_buckets(path, "document_id", "registered_at")).option("checkpointLocation", _place(spark, "t03c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("document_id string, registered_at timestamp_ntz, bucket int").parquet(path).drop("bucket").groupBy("document_id").agg(F.max("registered_at").alias("registered_at"))


@registered("""with r as (select question_id, promotion_status, row_number() over (partition by question_id order by reviewed_at nulls first, memory_key) as attempt from approved_memory where question_id is not null), f as (select *, min(case when promotion_status = 'approved' then attempt end) over (partition by question_id) as ok from r)
  select question_id, max(attempt) filter (where attempt <= 2)::bigint as attempts, coalesce(bool_or(promotion_status = 'approved' and attempt <= 2), false) as succeeded from f where attempt <= coalesce(ok, 2) group by 1""")
def t04_retried_once(spark, d):
    """Attempts recorded for a question: the first, and one more only where it failed."""
    from jangbu.operators.reports import retried

    m = table(spark, d, "approved_memory").where("question_id is not null").select("question_id", "memory_key", "reviewed_at", (F.col("promotion_status") == "approved").alias("ok"))
    return retried(m, "question_id", ["reviewed_at", "memory_key"], "ok")
