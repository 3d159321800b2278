"""Queries that clean, classify and compare texts cell by cell, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jangbu.functions import columns as C
from jangbu.runtime import table
from jangbu.registry import registered


@registered("""select retrieval_eligible, coalesce(lower(trim(cast(retrieval_eligible as varchar))), 'true') not in ('false', '0', 'no', 'n') as flag, count(*) as n from registry group by 1, 2""")
def pred02_flags(spark, d):
    return table(spark, d, "registry").groupBy("retrieval_eligible", C.flag(F.col("retrieval_eligible")).alias("flag")).agg(F.count("*").alias("n"))


@registered(r"""select row_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(answer_raw, '^\s*(?:[0-9]+[.)]|[가-하][.)]|[-○●■□◦▪※*•])\s*', ''), '^[^:：0-9]{1,12}[:：]\s*', ''), '^\s*금\s*', '')), ''), trim(answer_raw)) as shown from extraction_rows""")
def pred20_clean_values(spark, d):
    """Values without list number, label and amount word; never emptied."""
    v = F.regexp_replace(C.strip_label(C.strip_enumerator(F.col("answer_raw"))), r"^\s*금\s*", "")
    return table(spark, d, "extraction_rows").select("row_id", F.coalesce(F.nullif(F.trim(v), F.lit("")), F.trim("answer_raw")).alias("shown"))


@registered("""select row_id, status = 'conflict' as undecided, case when status = 'value_present' then coalesce(nullif(trim(answer_normalized), ''), answer_raw) when status = 'conflict' then concat('상충: ', answer_raw) when status = 'field_absent' then '기재 없음' when status = 'external_reference' then '별도 문서 참조' else '확인 필요' end as cell from extraction_rows""")
def pred19_rendered_cells(spark, d):
    s = F.col("status")
    cell = F.when(s == "value_present", F.coalesce(F.nullif(F.trim("answer_normalized"), F.lit("")), "answer_raw")).when(s == "conflict", F.concat(F.lit("상충: "), "answer_raw")).when(s == "field_absent", "기재 없음").when(s == "external_reference", "별도 문서 참조").otherwise("확인 필요")
    return table(spark, d, "extraction_rows").select("row_id", (s == "conflict").alias("undecided"), cell.alias("cell"))


@registered("""select doc_id, text is null or trim(text, ' ') in ('', '[]', '{}', 'null') as is_empty from documents""")
def pred21_empty_values(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("text").isNull() | F.trim("text").isin("", "[]", "{}", "null")).alias("is_empty"))


@registered(r"""select item_key, trim(regexp_replace(lower(regexp_replace(question, '[^0-9A-Za-z가-힣%]+', ' ', 'g')), ' +', ' ', 'g')) as scored from evaluation_items""")
def f02_scored_texts(spark, d):
    return table(spark, d, "evaluation_items").select("item_key", F.trim(F.regexp_replace(F.lower(F.regexp_replace("question", "[^0-9A-Za-z가-힣%]+", " ")), " +", " ")).alias("scored"))


@registered(r"""select record_id, lower(regexp_replace(regexp_replace(buyer_org, '㈜|㈳|㈶|\([주재사]\)|주식회사|재단법인|사단법인', '', 'g'), '[^0-9A-Za-z가-힣]', '', 'g')) as org_key, lower(regexp_replace(regexp_replace(project_name, '^\s*[\[(<][^\])>]{1,8}[\])>]\s*', ''), '[^0-9A-Za-z가-힣]', '', 'g')) as project_key from identity_records""")
def f04_name_keys(spark, d):
    org = C.expression_key(F.regexp_replace("buyer_org", r"㈜|㈳|㈶|\([주재사]\)|주식회사|재단법인|사단법인", ""))
    project = C.expression_key(F.regexp_replace("project_name", r"^\s*[\[(<][^\])>]{1,8}[\])>]\s*", ""))
    return table(spark, d, "identity_records").select("record_id", org.alias("org_key"), project.alias("project_key"))


@registered("""select record_id, case when starts_with(project_name, buyer_org) and length(trim(project_name)) > length(buyer_org) then trim(substr(project_name, length(buyer_org) + 1)) else project_name end as bare from identity_records""")
def f09_projects_without_org(spark, d):
    i = table(spark, d, "identity_records")
    leads = F.startswith("project_name", "buyer_org") & (F.length(F.trim("project_name")) > F.length("buyer_org"))
    return i.select("record_id", F.when(leads, F.trim(F.expr("substring(project_name, length(buyer_org) + 1)"))).otherwise(F.col("project_name")).alias("bare"))


@registered(r"""select record_id, try_cast(nullif(regexp_extract(project_name, '([0-9]+)\s*단계', 1), '') as int) as phase, try_cast(nullif(regexp_extract(project_name, '(20[0-9][0-9])', 1), '') as int) as year, notice_round from identity_records""")
def f11_rounds(spark, d):
    n = lambda rx: F.regexp_extract("project_name", rx, 1).try_cast("int")
    return table(spark, d, "identity_records").select("record_id", n(r"([0-9]+)\s*단계").alias("phase"), n("(20[0-9][0-9])").alias("year"), "notice_round")


@registered(r"""select record_id, regexp_replace(source_filename_nfc, '\.[A-Za-z0-9]{2,5}$', '') as stem, lower(regexp_extract(source_filename_nfc, '\.([A-Za-z0-9]{2,5})$', 1)) as ending from identity_records""")
def f12_file_stems(spark, d):
    f = F.col("source_filename_nfc")
    return table(spark, d, "identity_records").select("record_id", F.regexp_replace(f, r"\.[A-Za-z0-9]{2,5}$", "").alias("stem"), F.lower(F.regexp_extract(f, r"\.([A-Za-z0-9]{2,5})$", 1)).alias("ending"))


@registered(r"""select record_id, regexp_replace(regexp_replace(project_name, '\s+$', ''), '(\S{2,})의(\s)', '\1\2', 'g') || regexp_extract(project_name, '\s*$') as folded from identity_records""")
def f10_possessive_folded(spark, d):
    """Project names without the particle 의 between words, where two or more characters stand before it."""
    return table(spark, d, "identity_records").select("record_id", F.regexp_replace("project_name", r"(\S{2,})의(?=\s+\S)", "$1").alias("folded"))


@registered(r"""select item_key, document_id, regexp_matches(concat(' ', coalesce(answer_raw, ''), ' '), '[ ,(]' || regexp_escape(coalesce(answer_normalized, '~none~')) || '(은|는|이|가|을|를|의|에|입니다)?[ ,.)]') as stands_free from evaluation_items""")
def f16_bounded_containment(spark, d):
    """Whether the normalised answer stands in the raw one as a word of its own."""
    raw, norm = F.concat(F.lit(" "), F.coalesce("answer_raw", F.lit("")), F.lit(" ")), F.coalesce("answer_normalized", F.lit("~none~"))
    rx = F.concat(F.lit(r"[ ,(]\Q"), F.replace(norm, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(은|는|이|가|을|를|의|에|입니다)?[ ,.)]"))
    return table(spark, d, "evaluation_items").select("item_key", "document_id", F.rlike(raw, rx).alias("stands_free"))


@registered(r"""select row_id, case when answer_raw is null then 0 when regexp_matches(answer_raw, '확인이 필요|추후|별도 통지') then 2 when regexp_matches(answer_raw, '없음|없다|해당\s*없') then 1 else 0 end as absence from extraction_rows""")
def f20_absence_kinds(spark, d):
    """2: not verified, 1: said to be absent, 0: neither; not verified comes first."""
    a = F.col("answer_raw")
    return table(spark, d, "extraction_rows").select("row_id", F.when(a.isNull(), 0).when(a.rlike("확인이 필요|추후|별도 통지"), 2).when(a.rlike(r"없음|없다|해당\s*없"), 1).otherwise(0).alias("absence"))


@registered(r"""select doc_id, len(list_distinct(regexp_extract_all(text, '[A-Z]{2,4}-[0-9]+'))) as n_ids, trim(regexp_replace(text, '[A-Z]{2,4}-[0-9]+', '', 'g'), ' ') as without from documents where text is not null""")
def f23_markers_split(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(F.array_distinct(F.expr("regexp_extract_all(text, '[A-Z]{2,4}-[0-9]+', 0)"))).cast("long").alias("n_ids"), F.trim(F.regexp_replace("text", "[A-Z]{2,4}-[0-9]+", "")).alias("without"))


@registered("""with a as (select o_orderkey, cast(round(o_totalprice) as bigint) as won from orders) select o_orderkey, format('{:,}원', won) as shown from a""")
def f36_formatted_amounts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.format_number(F.round("o_totalprice").cast("long"), 0), F.lit("원")).alias("shown"))


@registered(r"""with n as (select row_id, list_transform(regexp_extract_all(answer_raw, '[0-9]+'), lambda x: try_cast(x as bigint)) as v from extraction_rows where field_name = '평가 배점' and answer_raw is not null) select row_id, len(v) as n_numbers, len(list_filter(v, lambda a: list_contains(v, 100 - a))) > 0 as pairs_to_100 from n""")
def f38_ratio_pairs(spark, d):
    r = table(spark, d, "extraction_rows").where("field_name = '평가 배점' and answer_raw is not null")
    v = r.select("row_id", F.transform(F.expr("regexp_extract_all(answer_raw, '[0-9]+', 0)"), lambda x: x.try_cast("long")).alias("v"))
    return v.select("row_id", F.size("v").cast("long").alias("n_numbers"), F.exists("v", lambda a: F.array_contains("v", 100 - a)).alias("pairs_to_100"))


@registered(r"""select record_id, coalesce(try_strptime(bid_deadline_raw, '%Y-%m-%d %H:%M:%S'), try_strptime(bid_deadline_raw, '%Y-%m-%d %H:%M'), try_strptime(bid_deadline_raw, '%Y-%m-%d')) as deadline from identity_records where bid_deadline_raw is null or regexp_full_match(bid_deadline_raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}(:[0-9]{2})?)?') and bid_deadline_raw not like '%24:%'""")
def f40_three_formats(spark, d):
    """Deadlines in the three plain notations; null stays null."""
    raw = F.col("bid_deadline_raw")
    i = table(spark, d, "identity_records").where(raw.isNull() | (raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$") & ~raw.contains("24:")))
    return i.select("record_id", F.expr("try_cast(bid_deadline_raw as timestamp_ntz)").alias("deadline"))


@registered(r"""select record_id, case when regexp_matches(trim(bid_deadline_raw), '^[0-9]{4}-') then coalesce(try_strptime(trim(bid_deadline_raw), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(bid_deadline_raw), '%Y-%m-%d %H:%M'), try_strptime(trim(bid_deadline_raw), '%Y-%m-%d')) end as deadline from identity_records""")
def f40_all_deadlines(spark, d):
    """Deadlines of all records, null where none of the three plain notations parses."""
    return table(spark, d, "identity_records").select("record_id", plain_deadline("bid_deadline_raw").alias("deadline"))


def plain_deadline(name):
    """A text column as time where it is a date, with or without hour and minute, or second; null where it is not, hour 24 included."""
    raw = F.trim(F.col(name))
    return F.when(raw.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(\s+[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?)?\z"), F.regexp_replace(raw, r"\s+", " ").try_cast("timestamp_ntz"))


@registered(r"""select row_id, case when hh is null then null else lpad(cast(case when ap in ('오후', 'PM') and hh < 12 then hh + 12 when ap in ('오전', 'AM') and hh = 12 then 0 else hh end as varchar), 2, '0') || ':' || mm end as at from
  (select record_id as row_id, regexp_extract(bid_deadline_raw, '(오전|오후|AM|PM)?\s*[0-9]{1,2}:[0-9]{2}\s*(?:AM|PM)?', 1) || regexp_extract(bid_deadline_raw, '[0-9]{1,2}:[0-9]{2}\s*(AM|PM)', 1) as ap, try_cast(regexp_extract(bid_deadline_raw, '([0-9]{1,2}):[0-9]{2}', 1) as int) as hh, regexp_extract(bid_deadline_raw, '[0-9]{1,2}:([0-9]{2})', 1) as mm from identity_records)""")
def f42_clock_times(spark, d):
    raw = F.col("bid_deadline_raw")
    ap = F.concat(F.regexp_extract(raw, r"(오전|오후|AM|PM)?\s*[0-9]{1,2}:[0-9]{2}\s*(?:AM|PM)?", 1), F.regexp_extract(raw, r"[0-9]{1,2}:[0-9]{2}\s*(AM|PM)", 1))
    t = table(spark, d, "identity_records").select(F.col("record_id").alias("row_id"), ap.alias("ap"), F.regexp_extract(raw, "([0-9]{1,2}):[0-9]{2}", 1).try_cast("int").alias("hh"), F.regexp_extract(raw, "[0-9]{1,2}:([0-9]{2})", 1).alias("mm"))
    h = F.when(F.col("ap").isin("오후", "PM") & (F.col("hh") < 12), F.col("hh") + 12).when(F.col("ap").isin("오전", "AM") & (F.col("hh") == 12), 0).otherwise(F.col("hh"))
    return t.select("row_id", F.when(F.col("hh").isNotNull(), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), "mm")).alias("at"))


@registered(r"""with s as (select row_id, list_filter(list_transform(string_split_regex(answer_raw, '\s*[,;\n]\s*'), lambda x: trim(x)), lambda x: x <> '') as v from extraction_rows where field_name = '필수 제출 서류' and answer_raw is not null) select row_id, len(v) as n_items, array_to_string(list_slice(v, 1, 60), '|') as items from s""")
def f46_listed_values(spark, d):
    r = table(spark, d, "extraction_rows").where("field_name = '필수 제출 서류' and answer_raw is not null")
    v = F.filter(F.transform(F.split("answer_raw", r"\s*[,;\n]\s*", -1), lambda x: F.trim(x)), lambda x: x != "")
    return r.select("row_id", v.alias("v")).select("row_id", F.size("v").cast("long").alias("n_items"), F.array_join(F.slice("v", 1, 60), "|").alias("items"))


def without_contained(units):
    """An array of texts without those that, by letters and digits, an earlier one contains; a longer one takes the place of the first it contains."""
    key = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))

    def add(kept, x):
        at = F.array_position(F.transform(kept, lambda y: F.contains(key(y), key(x)) | F.contains(key(x), key(y))), True)
        old = F.try_element_at(kept, at.cast("int"))
        longer = F.transform(kept, lambda y, i: F.when(i == at - 1, x).otherwise(y))
        return F.when(F.coalesce(key(x) == "", F.lit(True)), kept).when(at == 0, F.concat(kept, F.array(x))).when(F.contains(key(old), key(x)), kept).otherwise(longer)

    return F.aggregate(units, F.expr("cast(array() as array<string>)"), add)


@registered()
def u05_units_kept(spark, d):
    """Listed values of the documents to submit, without repeats and values contained in others."""
    r = table(spark, d, "extraction_rows").where("field_name = '필수 제출 서류' and answer_raw is not null")
    return r.select("row_id", without_contained(F.split("answer_raw", r"\s*[,;\n]\s*", -1)).alias("units"))


@registered(r"""select chunk_key, coalesce(section_path[len(section_path)], nullif(regexp_extract(location_label, '^([^·]+)', 1), '')) as leaf, regexp_replace(location_label, '\s*\([0-9]+/[0-9]+\)$', '') as label from chunks""")
def f49_chunk_locations(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_key", F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.nullif(F.regexp_extract("location_label", "^([^·]+)", 1), F.lit(""))).alias("leaf"), F.regexp_replace("location_label", r"\s*\([0-9]+/[0-9]+\)$", "").alias("label"))


@registered("""with p as (select document_id, min(array_to_string(section_path, ' > ')) as lo, max(array_to_string(section_path, ' > ')) as hi from chunks where document_id is not null group by 1) select document_id, lo = hi as one_path, split_part(lo, ' > ', 1) = split_part(hi, ' > ', 1) as one_root from p""")
def f51_common_paths(spark, d):
    p = table(spark, d, "chunks").where("document_id is not null").groupBy("document_id").agg(F.min(F.array_join("section_path", " > ")).alias("lo"), F.max(F.array_join("section_path", " > ")).alias("hi"))
    root = lambda c: F.split_part(F.col(c), F.lit(" > "), F.lit(1))
    return p.select("document_id", (F.col("lo") == F.col("hi")).alias("one_path"), (root("lo") == root("hi")).alias("one_root"))


@registered("""select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{1,6} '))) as n_headings, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|'))) as n_rows, contains(text, '<table') as has_html from documents where text is not null""")
def c02_block_counts(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.split("text", "\n", -1).alias("ls"))
    return t.select("doc_id", F.size(F.filter("ls", lambda x: x.rlike("^#{1,6} "))).cast("long").alias("n_headings"), F.size(F.filter("ls", lambda x: x.startswith("|"))).cast("long").alias("n_rows"), F.contains("text", F.lit("<table")).alias("has_html"))


@registered("""with g as (select chunk_key, document_id, chunking_version, block_type, array_to_string(section_path, ' > ') as path, md_line_start from chunks where document_id is not null and md_line_start is not null),
  m as (select *, case when block_type = 'table' or path is distinct from lag(path) over w or lag(block_type) over w is distinct from block_type then 1 else 0 end as starts from g window w as (partition by document_id, chunking_version order by md_line_start, chunk_key)),
  s as (select *, sum(starts) over (partition by document_id, chunking_version order by md_line_start, chunk_key rows unbounded preceding) as grp from m)
  select document_id, chunking_version, grp, count(*) as n, min(chunk_key) as first_chunk from s group by 1, 2, 3""")
def c10_merge_groups(spark, d):
    """Runs of text under one section path; every table is a run of its own."""
    g = table(spark, d, "chunks").where("document_id is not null and md_line_start is not null").select("chunk_key", "document_id", "chunking_version", "block_type", F.array_join("section_path", " > ").alias("path"), "md_line_start")
    w = Window.partitionBy("document_id", "chunking_version").orderBy("md_line_start", "chunk_key")
    starts = (F.col("block_type") == "table") | ~F.col("path").eqNullSafe(F.lag("path").over(w)) | ~F.col("block_type").eqNullSafe(F.lag("block_type").over(w))
    s = g.withColumn("starts", starts.cast("long")).withColumn("grp", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("document_id", "chunking_version", "grp").agg(F.count("*").alias("n"), F.min("chunk_key").alias("first_chunk"))


@registered("""select item_key, regexp_matches(question, '이 사업|해당 사업|위 사업|그 사업|방금') as anaphoric, regexp_matches(question, '마감|기한|언제까지') as asks_deadline, regexp_matches(question, '이유|왜|설명') as asks_why from evaluation_items where question is not null""")
def d08_question_signals(spark, d):
    q = F.col("question")
    return table(spark, d, "evaluation_items").where("question is not null").select("item_key", q.rlike("이 사업|해당 사업|위 사업|그 사업|방금").alias("anaphoric"), q.rlike("마감|기한|언제까지").alias("asks_deadline"), q.rlike("이유|왜|설명").alias("asks_why"))

