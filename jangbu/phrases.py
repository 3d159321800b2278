"""Queries of the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jangbu.functions import amounts, answers, names
from jangbu.functions import columns as C
from jangbu.registry import registered
from jangbu.runtime import table


@registered(r"""select doc_id, trim(regexp_replace(nfc_normalize(title), '\s+', ' ', 'g')) as shown from documents where title is not null""")
def f03_displayed_titles(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", names.shown_text("title").alias("shown"))


@registered()
def f05_name_keys(spark, d):
    """All keys of every record's organisation and project."""
    k = table(spark, d, "identity_records").select("record_id", names.name_keys("buyer_org", "project_name").alias("k"))
    return k.select("record_id", "k.org", "k.project", "k.org_unbracketed", "k.project_unbracketed", "k.project_folded", "k.generic", "k.behind_org", F.array_join("k.rounds", ",").alias("rounds"))


@registered(r"""select record_id, coalesce(list_sort(list_distinct(list_transform(regexp_extract_all(project_name, '(?:^|[^0-9])([0-9]{1,2})\s*차(?:[^가-힣]|$)', 1), lambda x: cast(x as int)))), []) = [] as none from identity_records where project_name is not null and not regexp_matches(project_name, '차(사업|용역|공고)')""")
def f11_project_rounds(spark, d):
    r = table(spark, d, "identity_records").where("project_name is not null and not project_name rlike '차(사업|용역|공고)'")
    return r.select("record_id", (F.size(names.name_keys("buyer_org", "project_name")["rounds"]) == 0).alias("none"))


@registered()
def f11_question_rounds(spark, d):
    return table(spark, d, "evaluation_items").where("question is not null").select("item_key", F.array_join(names.question_rounds("question"), ",").alias("rounds"))


@registered()
def f12_file_aliases(spark, d):
    return table(spark, d, "identity_records").select("record_id", names.alias_of_file("source_filename_nfc", "buyer_org", "project_name").alias("alias"))


@registered()
def f02_scored_whole(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(answers.scored_text("text"), 256).alias("digest"))


@registered()
def f14_stripped_answers(spark, d):
    return table(spark, d, "evaluation_items").where("answer_raw is not null").select("item_key", answers.stripped_of_endings("answer_raw").alias("stripped"))


@registered("""select e.item_key, trim(coalesce(e.answer_normalized, '')) <> '' and (e.answer_raw = trim(e.answer_normalized) or starts_with(e.answer_raw, trim(e.answer_normalized) || ' ')) as at_start from evaluation_items e where e.answer_raw is not null and e.answer_normalized is not null and not contains(substr(e.answer_raw, 2), trim(e.answer_normalized)) and not contains(e.answer_raw, trim(e.answer_normalized) || ',')""")
def f16_bounded_answers(spark, d):
    """Normalised answers that stand at the beginning of the raw ones as words of their own."""
    e = table(spark, d, "evaluation_items").where("answer_raw is not null and answer_normalized is not null and not contains(substr(answer_raw, 2), trim(answer_normalized)) and not contains(answer_raw, concat(trim(answer_normalized), ','))")
    return e.select("item_key", C.bounded(F.col("answer_raw"), F.col("answer_normalized")).alias("at_start"))


@registered(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?:sk|pk|key|token)[-_][A-Za-z0-9]{8,}', '[secret]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[mail]', 'g'), '0[0-9]{1,2}-?[0-9]{3,4}-?[0-9]{4}', '[phone]', 'g') as masked from documents where text is not null""")
def f18_masked_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.masked_secrets(F.col("text")).alias("masked"))


@registered()
def f20_absence_kinds_whole(spark, d):
    """Absence and field absence of every answer written in the field table."""
    r = table(spark, d, "extraction_rows").where("answer_raw is not null")
    return r.select("row_id", answers.absence_kind("answer_raw").alias("absence"), answers.field_absence_kind("answer_raw").alias("field_absence"))


@registered()
def f23_used_evidence(spark, d):
    """Answers with their evidence's numbers marked behind them, split again."""
    marks = F.concat(F.coalesce("answer_raw", F.lit("")), F.lit(" [근거 "), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce(F.size("evidence"), F.lit(1)), F.lit(1))), lambda i: i.cast("string")), ", "), F.lit("]"))
    e = table(spark, d, "evaluation_items").select("item_key", answers.marks_of(marks).alias("m"))
    return e.select("item_key", "m.answer", F.array_join("m.used", ",").alias("used"))


@registered("""select chunk_key, sha256(text) as digest from chunks where text is not null""")
def f30_digests(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("chunk_key", F.sha2("text", 256).alias("digest"))


@registered()
def f32_graded_amounts(spark, d):
    r = table(spark, d, "extraction_rows").where("field_name = '예산' and answer_raw is not null")
    return r.select("row_id", amounts.graded_amount_udf("answer_raw").alias("won"))


@registered()
def f33_budgets(spark, d):
    """Budgets in parts: amounts, won where exactly one, foreign currency, conditions."""
    r = table(spark, d, "extraction_rows").where("field_name = '예산' and answer_raw is not null").select("row_id", amounts.budget("answer_raw").alias("b"))
    return r.select("row_id", F.array_join(F.transform("b.amounts", lambda x: x.cast("string")), ",").alias("amounts"), "b.krw", "b.foreign", F.array_join("b.conditions", ",").alias("conditions"))


@registered()
def f37_period_differences(spark, d):
    r = table(spark, d, "extraction_rows").where("field_name = '사업기간' and answer_raw is not null and answer_normalized is not null")
    return r.select("row_id", answers.periods_apart("answer_raw", "answer_normalized").alias("differ"))


@registered()
def f38_ratio_pairs_whole(spark, d):
    r = table(spark, d, "extraction_rows").where("field_name = '평가 배점' and answer_raw is not null")
    return r.select("row_id", F.array_join(answers.ratio_of("answer_raw"), ",").alias("pair"))


@registered("""select task_type, round(100.0 / count(*), 4)::double as points from evaluation_items group by 1""")
def f39_points_per_item(spark, d):
    return table(spark, d, "evaluation_items").groupBy("task_type").agg(C.points_per_item(F.count("*")).alias("points"))


@registered()
def f42_dates_and_times(spark, d):
    r = table(spark, d, "identity_records").where("bid_deadline_raw is not null")
    return r.select("record_id", answers.date_stated("bid_deadline_raw").alias("day"), answers.time_stated("bid_deadline_raw").alias("time"))


@registered("""select item_key, timestamp '2024-06-01 00:00:00' as reference, date_diff('day', created_at::date, date '2024-06-01') as days from evaluation_items""")
def f43_reference_time(spark, d):
    """Every item against the injected reference time; the clock is not asked."""
    ref = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "evaluation_items").select("item_key", ref.alias("reference"), F.datediff(ref.cast("date"), F.col("created_at").cast("date")).cast("long").alias("days"))


@registered("""select memory_key, len(list_filter(coalesce(approved_plan.document_ids, []), lambda x: x is not null and trim(x) <> '')) as n from approved_memory""")
def f44_ids_as_lists(spark, d):
    """Lists of ids written as JSON and read back, single ids and none among them."""
    return table(spark, d, "approved_memory").select("memory_key", F.size(C.as_array(F.to_json("approved_plan.document_ids"))).cast("long").alias("n")).select("memory_key", "n")


@registered()
def f45_list_values(spark, d):
    r = table(spark, d, "extraction_rows").where("field_name in ('필수 제출 서류', '과업 범위', '참가 자격(면허·실적)')")
    return r.select("row_id", F.to_json(answers.listed("answer_normalized", "answer_raw")).alias("items"))


@registered()
def f46_stored_lists(spark, d):
    r = table(spark, d, "extraction_rows").where("answer_raw is not null")
    return r.select("row_id", answers.list_stored("answer_raw").alias("stored"))


@registered("""select file_id, json_valid(raw_json) as readable from metadata_files where raw_json is not null and left(raw_json, 1) = '{'""")
def f47_canonical_files(spark, d):
    """Whether a file has a canonical form; the form itself is the same for files that differ in order and blanks only."""
    m = table(spark, d, "metadata_files").where("raw_json is not null and left(raw_json, 1) = '{'")
    return m.select("file_id", C.canonical_json(F.col("raw_json")).isNotNull().alias("readable"))


@registered("""with g as (select item_key, unnest(evidence) as x from evaluation_items), w as (select distinct item_key, x.location.document as document_id, x.field as field, x.value as value from g where x.location.document is not null and x.field is not null) select item_key, document_id, field, value, not regexp_matches(document_id, '^RFP-[0-9]{8}$') as error from w""")
def f48_comparison_gold(spark, d):
    """Gold of a comparison as cells, written as an object of objects and read back; ids of another form are errors."""
    g = table(spark, d, "evaluation_items").select("item_key", F.explode("evidence").alias("x")).select("item_key", F.col("x.location.document").alias("document_id"), F.col("x.field").alias("field"), F.col("x.value").alias("value")).where("document_id is not null and field is not null").distinct()
    wide = g.groupBy("item_key").agg(F.to_json(F.collect_list(F.struct("document_id", F.struct("field", "value").alias("cell"))), {"ignoreNullFields": "false"}).alias("j"))  # the evidence of one item
    e = wide.select("item_key", F.explode(F.from_json("j", "array<struct<document_id:string,cell:struct<field:string,value:string>>>")).alias("c"))
    return e.select("item_key", "c.document_id", "c.cell.field", "c.cell.value", (~F.col("c.document_id").rlike("^RFP-[0-9]{8}$")).alias("error"))


@registered(r"""select chunk_key, trim(regexp_replace(location_label, '\s*\(\d+/\d+\)\s*$', '')) as ref_no, coalesce(list_filter(section_path, lambda x: x is not null and x <> '')[-1], nullif(trim(regexp_extract(location_label, '^([^·\d]+)', 1)), '')) as section, try_cast(regexp_extract(location_label, '(\d+)', 1) as int) as number from chunks""")
def f49_locations(spark, d):
    """Section, reference and number of every chunk."""
    c = table(spark, d, "chunks").select("chunk_key", C.location_of(F.col("section_path"), F.col("location_label")).alias("l"))
    return c.select("chunk_key", "l.ref_no", "l.section", "l.number")


@registered("""with c as (select chunk_key, section_path as a, lag(section_path) over (partition by document_id order by chunk_key) as b from chunks where document_id is not null), n as (select chunk_key, a, list_transform(range(1, 1 + least(len(a), len(b))), lambda i: a[i] is not distinct from b[i]) as same from c where a is not null and b is not null)
  select chunk_key, coalesce(list_position(same, false) - 1, len(same))::bigint as n_common from n""")
def f51_common_prefixes(spark, d):
    """How far the path of every chunk is that of the one before it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("document_id").orderBy("chunk_key")
    c = table(spark, d, "chunks").where("document_id is not null").select("chunk_key", F.col("section_path").alias("a"), F.lag("section_path").over(w).alias("b"))
    return c.where("a is not null and b is not null").select("chunk_key", F.size(C.common_prefix(F.col("a"), F.col("b"))).cast("long").alias("n_common"))


@registered()
def f52_list_units(spark, d):
    c = table(spark, d, "chunks").where("text is not null").select("chunk_key", answers.units_of_list(F.split("text", "\n")).alias("u"))
    return c.select("chunk_key", F.size("u").alias("n_units"), F.sha2(F.array_join("u", "\n"), 256).alias("digest"))


@registered("""select label_id, abusive = 1 as passed, abusive::double as score, 'json' as how from abuse_labels where abusive is not null""")
def f53_verdicts(spark, d):
    """Labels written as a judge's replies, with words around, and read back."""
    reply = F.concat(F.lit("Here it is: "), F.to_json(F.struct((F.col("abusive") == 1).alias("verdict"), F.col("abusive").cast("double").alias("score"))), F.lit(" thank you"))
    v = table(spark, d, "abuse_labels").where("abusive is not null").select("label_id", answers.judged_reply(reply).alias("v"))
    return v.select("label_id", "v.passed", "v.score", "v.how")


@registered()
def f54_comparison_keys(spark, d):
    r = table(spark, d, "extraction_rows").where("answer_raw is not null")
    return r.select("row_id", answers.compared_by("answer_raw").alias("key"))


@registered()
def f55_residuals(spark, d):
    """What raw answers hold beside their normalised form, where that is part of them."""
    r = table(spark, d, "extraction_rows").where("answer_raw is not null and answer_normalized <> '' and contains(answer_raw, answer_normalized)")
    return r.select("row_id", answers.rest_of("answer_raw", "answer_normalized").alias("rest"))


@registered("""select chunking_version, lower(trim(embedding_model)) as family from index_tags""")
def f58_model_families(spark, d):
    """Makers of the models of the index tags; those not known keep their own name."""
    return table(spark, d, "index_tags").select("chunking_version", answers.family_of("embedding_model").alias("family"))
