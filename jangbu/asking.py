"""Queries from questions and recorded plans to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jangbu.functions import columns as C
from jangbu.operators import answering, consortium, policy, resolve, selection
from jangbu.plans import parse as P
from jangbu.registry import registered
from jangbu.runtime import table
from jangbu.tender import _AMOUNT, _CELLS, _SCOPE


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extraction_rows")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question asked, of items and of approved plans, with a number of its own."""
    i = table(spark, d, "evaluation_items").select(F.concat(F.lit("i"), F.col("item_key").cast("string")).alias("question_id"), "question")
    m = table(spark, d, "approved_memory").select(F.concat(F.lit("m"), F.col("memory_key").cast("string")).alias("question_id"), "question")
    return i.unionByName(m).where("question is not null")


_ASKED = """asked as (select 'i' || item_key as question_id, question from evaluation_items where question is not null union all select 'm' || memory_key, question from approved_memory where question is not null)"""


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """A selection question for every budget written in plain won: at least that much, not that much or more, and with a status beside it."""
    c = selection.current_cells(_rows(spark, d).where("field_name = '예산'"))
    amount = C.plain_amount(F.col("answer_raw"))
    v = c.select("document_id", F.trim("answer_raw").alias("said"), amount.alias("amount")).where("amount is not null")
    forms = {"least": F.concat(F.lit("예산이 "), "said", F.lit(" 이상인 사업을 모두 찾아줘")), "not": F.concat(F.lit("예산이 "), "said", F.lit(" 이상이 아닌 사업을 찾아줘")), "both": F.concat(F.lit("예산이 "), "said", F.lit(" 미만이고 지역제한이 없는 사업을 알려줘"))}
    return v.select("document_id", "amount", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), q.alias("question")) for k, q in forms.items()))).alias("q")).select("document_id", "amount", "q.form", "q.question")


_STATED = f"""with {_CELLS}, v as (select document_id, {_AMOUNT.format("answer_raw")} as amount from cur where field_name = '예산'), f as (select document_id, amount, form from v, (values ('least'), ('not'), ('both')) t(form) where amount is not null)"""


@registered(_STATED + """ select document_id, form, case form when 'least' then '예산>=' when 'not' then '예산<' else '예산<,지역제한absent' end as conditions, amount, true as executable from f""")
def q01_parsed_selections(spark, d):
    q = _stated(spark, d).withColumn("p", P.parsed("question"))
    return q.select("document_id", "form", F.array_join(F.transform("p.conditions", lambda c: F.concat(c["field"], c["operator"])), ",").alias("conditions"), F.get("p.conditions", F.lit(0))["value"].alias("amount"), "p.executable")


@registered()
def q01_parsed_questions(spark, d):
    """All questions asked: conditions read, segments not understood, background."""
    q = _questions(spark, d).withColumn("p", P.parsed("question"))
    return q.select("question_id", F.to_json("p.conditions").alias("conditions"), F.array_join("p.unresolved", "|").alias("unresolved"), F.array_join("p.background", "|").alias("background"), "p.alternative", "p.executable")


_PHRASES = {"있는": ("present", False), "없는": ("absent", False), "비공개인": ("not_disclosed", False), "서로 다른": ("conflict", False), "있는 것이 아닌": ("present", True), "없는 것은 제외한": ("absent", True)}


@registered(f"""with {_CELLS}, w as (select * from (values ('있는', 'present', false), ('없는', 'absent', false), ('비공개인', 'not_disclosed', false), ('서로 다른', 'conflict', false), ('있는 것이 아닌', 'present', true), ('없는 것은 제외한', 'absent', true)) t(said, operator, negated)),
  f as (select distinct field_name from cur) select field_name, said, field_name as field, operator, negated from f, w""")
def q02_status_predicates(spark, d):
    """Every field of the table under every wording of a status, negated ones too."""
    said = F.explode(F.array(*(F.lit(x) for x in _PHRASES))).alias("said")
    q = selection.current_cells(_rows(spark, d)).select("field_name").distinct().select("field_name", said).withColumn("p", P.parsed(F.concat("field_name", F.lit("이 "), "said", F.lit(" 사업을 모두 찾아줘"))))
    c = F.get("p.conditions", F.lit(0))
    return q.select("field_name", "said", c["field"].alias("field"), c["operator"].alias("operator"), c["negated"].alias("negated"))


@registered(_STATED + """ select document_id, '>=' as operator, amount, '<' as flipped from f where form = 'least'""")
def q03_numeric_conditions(spark, d):
    q = _stated(spark, d).where("form <> 'both'").withColumn("c", F.get(P.parsed("question")["conditions"], F.lit(0)))
    return q.groupBy("document_id").agg(F.max(F.when(F.col("form") == "least", F.col("c.operator"))).alias("operator"), F.max("c.value").alias("amount"), F.max(F.when(F.col("form") == "not", F.col("c.operator"))).alias("flipped"))


@registered(f"""with {_CELLS}, f as (select distinct field_name from cur), w as (select * from (values ('present', 'present', false), ('present', 'absent', true), ('absent', 'conflict', true)) t(a, b, clash)) select field_name, a, b, clash from f, w""")
def q04_contradictions(spark, d):
    """Two statuses asked of one field at once: refused unless they are the same."""
    words = {"present": "있는", "absent": "없는", "conflict": "서로 다른"}
    pairs = spark.createDataFrame([(a, b, words[a], words[b]) for a, b in (("present", "present"), ("present", "absent"), ("absent", "conflict"))], "a string, b string, wa string, wb string")
    f = selection.current_cells(_rows(spark, d)).select("field_name").distinct()
    q = f.join(F.broadcast(pairs), F.lit(True)).withColumn("p", P.parsed(F.concat("field_name", F.lit("이 "), "wa", F.lit(" 것이고 "), "field_name", F.lit("이 "), "wb", F.lit(" 사업"))))
    return q.select("field_name", "a", "b", F.exists("p.unresolved", lambda x: x.contains("contradicting")).alias("clash"))


@registered(r"with " + _ASKED + r""" select question_id, regexp_matches(question, '이상|이하|초과|미만|없는|있는|아닌|않은|가능한|불가|허용|필수|제외|맞는|해당하는|조건') as shaped from asked""")
def q05_condition_shapes(spark, d):
    return _questions(spark, d).select("question_id", F.col("question").rlike(P.SHAPE.pattern).alias("shaped"))


@registered(r"with " + _ASKED + r""" select question_id, regexp_matches(question, '제출\s*(방식|방법)|어떻게\s*(제출|접수)|어디로\s*(제출|접수)') as submission, regexp_matches(question, '마감|기한|언제까지|접수\s*중|남은') as deadline from asked""")
def q06_detectors(spark, d):
    q = F.col("question")
    return _questions(spark, d).select("question_id", q.rlike(r"제출\s*(방식|방법)|어떻게\s*(제출|접수)|어디로\s*(제출|접수)").alias("submission"), q.rlike(r"마감|기한|언제까지|접수\s*중|남은").alias("deadline"))


@registered()
def q07_selection_questions(spark, d):
    return _questions(spark, d).select("question_id", P.parsed("question")["selection"].alias("selection"))


@registered()
def q19_unread_wording(spark, d):
    return _questions(spark, d).withColumn("u", P.unread("question")).select("question_id", F.array_join("u.literals", "|").alias("literals"), "u.leftover")


@registered(r"with " + _ASKED + r""" select question_id, array_to_string(list_filter(string_split_regex(rtrim(ltrim(question, ' ?.'), ' ?.'), '\s*(?:[,，;]|이고|이며|하고|그리고|면서)\s*'), lambda x: x <> ''), '|') as segments from asked where not regexp_matches(question, '\d,\d{3}')""")
def f26_condition_segments(spark, d):
    """Questions cut into conditions; those with grouped numbers are tested apart."""
    return _questions(spark, d).where(~F.col("question").rlike(r"\d,\d{3}")).select("question_id", F.array_join(P.segmented("question"), "|").alias("segments"))


@registered()
def f27_clauses(spark, d):
    c = table(spark, d, "chunks").where("text is not null").select("chunk_key", P.in_clauses("text").alias("c"))
    return c.select("chunk_key", F.size("c").alias("n_clauses"), F.array_max(F.transform("c", F.length)).alias("longest"))


@registered()
def f28_field_mentions(spark, d):
    m = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(P.mentioned("text")).alias("m"))
    return m.select("doc_id", "m.start", "m.end", "m.field")


# Consortium


@registered()
def pred07_consortium(spark, d):
    """Every consortium cell: is one required, is one allowed."""
    c = selection.current_cells(_rows(spark, d).where("field_name = '컨소시엄 요건'"))
    text = F.when(F.col("status") == "value_present", F.coalesce("answer_raw", "answer_normalized"))
    return c.withColumn("v", consortium.classified(text)).select("document_id", "v.required", "v.allowed", "v.reason")


@registered()
def pred08_consortium_states(spark, d):
    """The second opinion, the location's heading being the excerpt."""
    r = _rows(spark, d).where((F.col("field_name") == "컨소시엄 요건") & C.active())
    return r.select("row_id", policy.consortium_state("status", "answer_raw", "representative_location.heading").alias("state"))


@registered()
def pred09_consortium_policies(spark, d):
    r = _rows(spark, d).where("field_name = '컨소시엄 요건'")
    return r.select("row_id", policy.consortium_policy("answer_raw").alias("policy"))


@registered(f"""with {_CELLS}, c as (select document_id, case when status = 'value_present' then answer_raw end as t from cur where field_name = '컨소시엄 요건'),
  k as (select document_id, case when t is null then null when regexp_matches(t, '불허|불가|금지|허용하지') then false when regexp_matches(t, '허용|가능') then true end as simple, t from c)
  select count(*) as n, count(*) filter (where simple is not null) as n_told, 0::bigint as n_disagree from k""")
def v05_consortium_agreement(spark, d):
    """Both opinions side by side on every cell: where a plain word says it, neither may say the opposite."""
    c = selection.current_cells(_rows(spark, d).where("field_name = '컨소시엄 요건'")).withColumn("t", F.when(F.col("status") == "value_present", F.col("answer_raw")))
    j = c.select("t", consortium.classified("t")["allowed"].alias("one"), policy.consortium_state("status", "t").alias("two"))
    simple = F.when(F.col("t").rlike("불허|불가|금지|허용하지"), False).when(F.col("t").rlike("허용|가능"), True)
    other = F.when(F.col("two") == "forbidden_all", False).when(F.col("two").isin("allowed_explicit", "required_all"), True)
    j = j.select(simple.alias("simple"), "one", other.alias("other"))
    return j.agg(F.count("*").alias("n"), F.count("simple").alias("n_told"), F.count_if(F.coalesce((F.col("one") != F.col("simple")) | (F.col("other") != F.col("simple")), F.lit(False))).alias("n_disagree"))


@registered(f"""with {_CELLS}, {_SCOPE}, n as (select c.document_id, c.status <> 'field_absent' as has_region, not (c.status <> 'field_absent') as no_region from cur c where field_name = '지역제한') select s.document_id, n.has_region, n.no_region from scope s join n using (document_id)""")
def pred04_negation_is_complement(spark, d):
    """A status condition and its negation on the same cells: each is the other's exact complement, and a comparison cannot be negated."""
    c = selection.current_cells(_rows(spark, d).where("field_name = '지역제한'")).join(selection.scope(table(spark, d, "registry")), "document_id", "left_semi")
    on = lambda neg: selection.Condition("지역제한", "absent", negated=neg).on(F.col("status"), F.lit(None).cast("double"))
    return c.select("document_id", on(True).alias("has_region"), on(False).alias("no_region"))


_COMPAT = "(field_name = '예산' or op not in ('>=', '<')) and (op not in ('required', 'allowed') or field_name = '컨소시엄 요건') and (op <> 'restricted' or field_name = '지역제한')"


@registered(f"""with f as (select distinct field_name from extraction_rows), o as (select * from (values ('present'), ('>='), ('<'), ('required'), ('allowed'), ('restricted'), ('unheard of')) t(op)) select field_name, op, op <> 'unheard of' and {_COMPAT} as fits from f, o""")
def pred10_operators_of_fields(spark, d):
    """Which operators a field takes, as the analyzer decides it."""
    fields = [r.field_name for r in _rows(spark, d).select("field_name").distinct().collect()]  # twelve fields
    out = []
    for f in fields:
        for op in ("present", ">=", "<", "required", "allowed", "restricted", "unheard of"):
            try:
                selection.Condition(f, op, 1.0)
                out.append((f, op, True))
            except ValueError:
                out.append((f, op, False))
    return spark.createDataFrame(out, "field_name string, op string, fits boolean")


# Deadlines


def _deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Latest plainly written deadline of every document."""
    from jangbu.wording import plain_deadline

    return table(spark, d, "identity_records").where("document_id is not null").select("document_id", plain_deadline("bid_deadline_raw").alias("deadline"))


_PLAIN_DEADLINE = r"""dl as (select document_id, max(coalesce(try_strptime(trim(bid_deadline_raw), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(bid_deadline_raw), '%Y-%m-%d %H:%M'), try_strptime(trim(bid_deadline_raw), '%Y-%m-%d'))) as deadline
  from identity_records where document_id is not null and regexp_full_match(trim(bid_deadline_raw), '\d{4}-\d{1,2}-\d{1,2}( ([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?)?') group by 1)"""


@registered(f"with {_PLAIN_DEADLINE} " + """select document_id, deadline >= timestamp '2023-06-01' as before_deadline from (select distinct document_id from identity_records where document_id is not null) left join dl using (document_id)""")
def pred12_before_deadline(spark, d):
    g = _deadlines(spark, d).groupBy("document_id").agg(F.max("deadline").alias("deadline"))
    s = answering.deadline_state(F.col("deadline"), F.lit("2023-06-01").cast("timestamp_ntz"))
    return g.select("document_id", F.when(s != "unknown", s == "open").alias("before_deadline"))


@registered(f"with {_SCOPE}, {_PLAIN_DEADLINE} " + """select document_id, deadline is null as note from scope left join dl using (document_id) where deadline is null or deadline >= timestamp '2023-06-01'""")
def pred13_open_or_unknown(spark, d):
    kept, notes = answering.keep_open(selection.scope(table(spark, d, "registry")), _deadlines(spark, d), "2023-06-01")
    return kept.join(notes.withColumn("n", F.lit(True)), "document_id", "left").select("document_id", F.coalesce("n", F.lit(False)).alias("note"))


@registered(f"with {_PLAIN_DEADLINE} " + """select document_id, case when deadline is null then 'unknown' when deadline >= timestamp '2023-06-01' then 'open' else 'expired' end as state,
  case when deadline is null then '마감일 미상, 확인 필요' when deadline < timestamp '2023-06-01' then '마감 ' || strftime(deadline, '%Y-%m-%d %H:%M') else 'D-' || date_diff('day', date '2023-06-01', cast(deadline as date)) || ' (' || strftime(deadline, '%Y-%m-%d %H:%M') || ')' end as wording
  from (select distinct document_id from identity_records where document_id is not null) left join dl using (document_id)""")
def pred18_deadline_evidence(spark, d):
    g = _deadlines(spark, d).groupBy("document_id").agg(F.max("deadline").alias("deadline"))
    return answering.deadline_evidence(g, "2023-06-01").select("document_id", "state", "wording")


@registered(f"with {_PLAIN_DEADLINE} " + """select deadline, document_id from dl where deadline between timestamp '2023-06-01' and timestamp '2023-06-01' + interval 14 day order by deadline, document_id limit 20""")
def o03_urgent_tenders(spark, d):
    g = _deadlines(spark, d).groupBy("document_id").agg(F.max("deadline").alias("deadline"))
    ref = F.lit("2023-06-01").cast("timestamp_ntz")
    return g.where(F.col("deadline").between(ref, ref + F.expr("interval 14 days"))).orderBy("deadline", "document_id").limit(20).select("deadline", "document_id")


# Projections

_SHOWN = """case status when 'value_present' then coalesce(nullif(trim(answer_normalized), ''), nullif(trim(answer_raw), ''), '(빈 값)') when 'conflict' then '문서 안에서 서로 다름: ' || coalesce(trim(answer_raw), '') when 'field_absent' then '문서에 기재 없음' when 'external_reference' then '별도 문서 참조' when 'not_disclosed' then '비공개' else '확인 필요' end"""


@registered(f"with {_CELLS} select document_id, field_name, {_SHOWN} as shown from cur")
def pred19_field_evidence(spark, d):
    return selection.current_cells(_rows(spark, d)).select("document_id", "field_name", answering.field_evidence(F.col("status"), F.col("answer_normalized"), F.col("answer_raw")).alias("shown"))


@registered("""select c.chunk_key from chunks c where c.document_id in (select document_id from registry where retrieval_eligible and deleted_at is null) and coalesce(c.retrieval_eligible, false) and not coalesce(c.table_degraded, false) and trim(coalesce(c.text, '')) <> ''""")
def pred16_context_rows(spark, d):
    return answering.context_rows(table(spark, d, "chunks"), selection.scope(table(spark, d, "registry"))).select("chunk_key")


@registered("""select count(*) filter (where chunk_id is null) as n_without_chunk_id, count(*) filter (where document_id is null) as n_without_document_id, count(*) filter (where text is null) as n_without_content from chunks""")
def pred23_mapped_chunks(spark, d):
    return answering.mapped_chunks(table(spark, d, "chunks"))[1]


@registered("""select id, answer_raw as answer, null::varchar as structured_answer, null::varchar as contexts, null::varchar as retrieved, null::varchar as reranked, null::varchar as citations, document_id as selected_document_ids, null::varchar as abstained, task_type as route, null::varchar as failure, null::varchar as latency_ms from evaluation_items""")
def pred24_responses(spark, d):
    return answering.as_responses(table(spark, d, "evaluation_items").select("id", F.col("answer_raw").alias("answer"), F.col("document_id").alias("selected_document_ids"), F.col("task_type").alias("route"), "question"))


@registered("""select item_key from (select item_key, case when regexp_matches(question, '비교|차이|각각') then 'compare' when regexp_matches(question, '모두|목록|어떤 사업|찾아') then 'select' when regexp_matches(question, '예산|기간|기한|배점|제출|마감') then 'extract' when question is not null then 'qa' end as route from evaluation_items) where coalesce(route, '') not in ('select', 'compare', 'extract')""")
def pred25_searched_items(spark, d):
    from jangbu.plans.router import route

    return answering.searched(table(spark, d, "evaluation_items").withColumn("route", route(F.col("question")))).select("item_key")


@registered(r"""select item_key, concat_ws(',', case when id is null then 'no_id' end, case when id is not null and not regexp_matches(id, '^(SEL|EXT|QA)-\d{2}-\d{4,}$') then 'bad_id' end, case when answer_raw is not null and trim(answer_raw) = '' then 'no_answer' end,
  case when answer_raw is not null and len(coalesce(evidence, [])) = 0 then 'no_evidence' end) as problems from evaluation_items""")
def pred28_response_problems(spark, d):
    e = table(spark, d, "evaluation_items").select("item_key", "id", F.col("answer_raw").alias("answer"), F.col("answer_raw").isNull().alias("abstained"), F.coalesce(F.size("evidence"), F.lit(0)).alias("n"))
    return e.withColumn("n_evidence", F.greatest("n", F.lit(0))).select("item_key", F.array_join(answering.response_problems(), ",").alias("problems"))


# Physical answers

_QUESTION = "예산이 1억원 이상이고 지역제한이 있는 사업을 모두 찾아줘"


@registered(f"""with {_CELLS}, {_SCOPE}, {_PLAIN_DEADLINE}, wide as (select document_id, max(case when field_name = '예산' then status end) as bs, max(case when field_name = '예산' then coalesce({_AMOUNT.format("answer_normalized")}, {_AMOUNT.format("answer_raw")}) end) as amt, max(case when field_name = '지역제한' then status end) as rs,
    array_to_string(list_sort(list(field_name || '=' || {_SHOWN})), '; ') as cells from cur where field_name in ('예산', '지역제한') group by 1),
  j as (select s.document_id, (case when bs = 'value_present' then amt >= 100000000 end) and rs = 'value_present' as ok, cells, deadline from scope s left join wide using (document_id) left join dl using (document_id))
  select document_id, case when ok then 'confirmed' else 'undetermined' end as verdict, cells, case when deadline is null then '마감일 미상' end as note from j where ok is not false and (deadline is null or deadline >= timestamp '2023-06-01')""")
def q12_selection_answer(spark, d):
    """A question in words, parsed and answered over all documents in scope."""
    return answering.answer_selection(_QUESTION, _rows(spark, d), selection.scope(table(spark, d, "registry")), _deadlines(spark, d), "2023-06-01")


_ASKED_CELLS = """pairs as (select distinct memory_key, document_id, field_name from (select memory_key, unnest(approved_plan.document_ids) as document_id, approved_plan.requested_fields as fs from approved_memory), unnest(fs) t(field_name) where document_id is not null and field_name is not null)"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "approved_memory").select("memory_key", F.explode("approved_plan.document_ids").alias("document_id"), F.col("approved_plan.requested_fields").alias("fs"))
    return m.select("memory_key", "document_id", F.explode("fs").alias("field_name")).where("document_id is not null and field_name is not null").distinct()


@registered(f"with {_CELLS}, {_ASKED_CELLS} select p.memory_key, p.document_id, p.field_name, coalesce(c.status, 'missing') as status, coalesce(c.shown, '추출표에 없음') as shown from pairs p left join (select document_id, field_name, status, {_SHOWN} as shown from cur) c using (document_id, field_name)")
def q13_lookup_answers(spark, d):
    """The cells recorded plans ask for."""
    return answering.look_up(_planned(spark, d), _rows(spark, d)).select("memory_key", "document_id", "field_name", "status", "shown")


@registered(f"""with {_SCOPE}, a as (select distinct memory_key, x as document_id from (select memory_key, unnest(approved_plan.document_ids) as x from approved_memory) where x is not null),
  j as (select m.memory_key as question_id, count(a.document_id) as n_asked, count(s.document_id) as n_in_scope from approved_memory m left join a using (memory_key) left join scope s on a.document_id = s.document_id group by 1)
  select question_id, n_asked, n_in_scope, case when n_asked < 2 then 'too_few' when n_in_scope < n_asked then 'out_of_scope' end as blocked from j""")
def d07_comparison_targets(spark, d):
    asked = table(spark, d, "approved_memory").select(F.col("memory_key").alias("question_id"), F.col("approved_plan.document_ids").alias("document_ids"))
    return answering.compared(asked, selection.scope(table(spark, d, "registry")))


_VEC = """q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0), ok as (select chunk_key, document_id from chunks where coalesce(retrieval_eligible, false) and not coalesce(table_degraded, false) and trim(coalesce(text, '')) <> '' and document_id in (select document_id from registry where retrieval_eligible and deleted_at is null)),
  s as (select q.query_id, v.vec_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 6) as similarity from q join embeddings v on q.query_id <> v.vec_id join ok on ok.chunk_key = v.vec_id), r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s)"""


@registered(f"with {_CELLS}, {_VEC} " + """select r.query_id, r.vec_id, r.rank, r.similarity, c.status as lead from r join ok on ok.chunk_key = r.vec_id left join cur c on c.document_id = ok.document_id and c.field_name = '사업 개요' where rank <= 5""")
def q15_search_answers(spark, d):
    """Search over retrievable chunks only, each hit led by what the table says of its document."""
    from jangbu.operators.retrieval import cosine_top_k

    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    ok = answering.context_rows(table(spark, d, "chunks"), selection.scope(table(spark, d, "registry"))).select(F.col("chunk_key").alias("vec_id"), "document_id")
    top = cosine_top_k(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v.join(ok.select("vec_id"), "vec_id", "left_semi"), 5)
    lead = selection.current_cells(_rows(spark, d).where("field_name = '사업 개요'")).select("document_id", F.col("status").alias("lead"))
    return top.join(ok, "vec_id").join(lead, "document_id", "left").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "similarity", "lead")


@registered()
def q17_fast_path(spark, d):
    """Why a question goes to a model rather than to the rules; null where the rules take it."""
    q = _questions(spark, d).withColumns({"p": P.parsed("question"), "u": P.unread("question")})
    return q.select("question_id", answering.fast_path(F.col("p"), F.col("u.leftover"), F.regexp_count("question", F.lit(r"RFP-\d+"))).alias("reason"))


_SIG = r"""s as (select memory_key, question_id, reviewed_at, approved_plan.action as action, sha256(concat_ws('|', coalesce(approved_plan.action, ''), coalesce(approved_plan.answer_mode, ''), coalesce(approved_plan.document_scope, ''), array_to_string(list_sort(list_distinct(list_filter(coalesce(approved_plan.document_ids, []), lambda x: x is not null))), ','),
  array_to_string(list_sort(list_distinct(list_filter(coalesce(approved_plan.requested_fields, []), lambda x: x is not null))), ','), regexp_replace(trim(coalesce(approved_plan.search_query, '')), '\s+', ' ', 'g'))) as signature from approved_memory)"""


@registered(f"with {_SIG} select memory_key, signature from s")
def q10_plan_signatures(spark, d):
    return table(spark, d, "approved_memory").select("memory_key", answering.signature().alias("signature"))


@registered("""with p as (select memory_key, approved_plan as p from approved_memory) select memory_key, concat_ws(',', case when p is null then 'unreadable' end, case when p is null or p.action is null then 'no_action' when p.action not in ('selection', 'table_lookup', 'comparison', 'vector_search', 'clarify') then 'unknown_action' end, case when p is null or p.document_scope is null then 'no_scope' end,
  case when p is null or p.answer_mode is null then 'no_mode' end, case when p.document_scope = 'specific_documents' and len(list_filter(coalesce(p.document_ids, []), lambda x: x is not null)) = 0 then 'no_documents' end, case when p.action = 'vector_search' and trim(coalesce(p.search_query, '')) = '' then 'no_query' end) as problems from p""")
def q11_decision_contracts(spark, d):
    """Recorded plans written as JSON and read back under the contract."""
    m = table(spark, d, "approved_memory").select("memory_key", F.to_json("approved_plan").alias("j"))
    return m.select("memory_key", F.array_join(answering.decision_problems(F.col("j")), ",").alias("problems"))


@registered("""select label_id, concat_ws(',', case when abusive is null then 'no_verdict' end, case when abusive = 0 and rater like '%1' then 'approved_with_issues' end, case when abusive = 1 and not rater like '%1' then 'refused_without_issue' end) as problems from abuse_labels""")
def q20_verification_contracts(spark, d):
    """Verifications as JSON under their contract: an approval has no issues, a refusal has some."""
    v = table(spark, d, "abuse_labels").select("label_id", F.to_json(F.struct((F.col("abusive") == 0).alias("approved"), F.when(F.col("rater").like("%1"), F.array(F.col("rater"))).otherwise(F.array().cast("array<string>")).alias("issues"))).alias("j"))
    return v.select("label_id", F.array_join(answering.verification_problems(F.col("j")), ",").alias("problems"))


@registered(f"""with {_CELLS}, c as (select field_name, document_id, case when status = 'value_present' then 'confirmed' when status in ('extraction_failed', 'review_required', 'conflict') then 'undetermined' end as verdict from cur), k as (select * from c where verdict is not null),
  n as (select field_name, count(*) filter (where verdict = 'confirmed') as n_confirmed, count(*) filter (where verdict = 'undetermined') as n_undetermined from k group by 1), t as (select field_name, array_to_string(list_slice(list_sort(list(document_id) filter (where verdict = 'confirmed')), 1, 5), ',') as shown from k group by 1)
  select field_name, n_confirmed, n_undetermined, case when n_confirmed > 0 and n_undetermined = 0 then 'matched' when n_confirmed > 0 then 'partial' else 'undetermined_only' end as outcome, coalesce(shown, '') as shown, n_confirmed > 5 as more from n join t using (field_name)""")
def q21_observations(spark, d):
    """What a selection of each field comes to, with the first ids shown and the result whole."""
    s = F.col("status")
    v = selection.current_cells(_rows(spark, d)).select("field_name", "document_id", F.when(s == "value_present", "confirmed").when(s.isin("extraction_failed", "review_required", "conflict"), "undetermined").alias("verdict")).where("verdict is not null")
    return answering.observation(v, ["field_name"])


@registered(f"with {_SIG}, " + """r as (select question_id, signature, action, row_number() over (partition by question_id order by reviewed_at nulls first, memory_key) as step, row_number() over (partition by question_id, signature order by reviewed_at nulls first, memory_key) > 1 as again from s where question_id is not null), f as (select * from r where step <= 4),
  g as (select question_id, min(step) filter (where again) as repeat_at, min(step) filter (where action = 'clarify') as final_at, max(step) as steps from f group by 1), h as (select *, least(coalesce(repeat_at, 99), coalesce(final_at, 99)) as stop from g)
  select question_id, case when repeat_at = stop and stop <= 3 then 'repeated' when final_at = stop and stop <= 4 then 'answered' when steps > 3 then 'exhausted' else 'open' end as outcome, least(coalesce(nullif(stop, 99) - 1, steps), 3) as tools from h""")
def q18_bounded_loops(spark, d):
    """Decisions recorded for a question replayed in order: three tools at most, a repeated call ends the loop, asking back answers it."""
    m = table(spark, d, "approved_memory").where("question_id is not null").select("question_id", "memory_key", "reviewed_at", F.col("approved_plan.action").alias("action"), answering.signature().alias("signature"))
    return answering.loops(m, "question_id", ["reviewed_at", "memory_key"], "signature", F.col("action") == "clarify").select("question_id", "outcome", F.col("tools").cast("long").alias("tools"))


@registered()
def q22_assigned_candidates(spark, d):
    c = selection.current_cells(_rows(spark, d)).where(C.status_is("conflict")).select(F.col("field_name").alias("pool"), "document_id")
    fields = sorted(r.pool for r in c.select("pool").distinct().collect())  # twelve fields
    return answering.assigned(c, fields)


# Limits


@registered(f"with {_CELLS} select document_id, (select count(*) from cur where field_name = '예산' and status = 'conflict') as total from (select document_id from cur where field_name = '예산' and status = 'conflict' order by document_id limit 10)")
def o06_limited_with_total(spark, d):
    few, total = answering.limited(selection.current_cells(_rows(spark, d).where("field_name = '예산'")).where(C.status_is("conflict")).select("document_id"), 10)
    return few.join(F.broadcast(total), F.lit(True))


@registered(f"with {_CELLS}, c as (select document_id from cur where field_name = '예산' and status = 'field_absent') select document_id, document_id in (select document_id from c order by document_id limit 5) as displayed from c")
def o05_displayed_of_all(spark, d):
    """The result whole, with what of it is displayed marked."""
    c = selection.current_cells(_rows(spark, d).where("field_name = '예산'")).where(C.status_is("absent")).select("document_id")
    first = c.orderBy("document_id").limit(answering.SHOWN).withColumn("s", F.lit(True))
    return c.join(F.broadcast(first), "document_id", "left").select("document_id", F.coalesce("s", F.lit(False)).alias("displayed"))


_RANKED = """r as (select document_id, count(*) filter (where status = 'value_present') as n_ok, count(*) filter (where status in ('extraction_failed', 'review_required', 'conflict')) as n_review, bool_or(field_name = '예산' and status = 'value_present') as budget from cur group by 1), v as (select *, case when budget and n_review = 0 then 0 when budget then 1 else 2 end as verdict from r)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    c = selection.current_cells(_rows(spark, d)).groupBy("document_id").agg(F.count_if(C.status_is("present")).alias("n_ok"), F.count_if(F.col("status").isin("extraction_failed", "review_required", "conflict")).alias("n_review"), F.bool_or((F.col("field_name") == "예산") & (F.col("status") == "value_present")).alias("budget"))
    return c.withColumn("verdict", F.when(F.col("budget") & (F.col("n_review") == 0), 0).when(F.col("budget"), 1).otherwise(2))


@registered(f"with {_CELLS}, {_RANKED} select document_id, verdict, n_ok, n_review from v order by verdict, n_ok desc, n_review, document_id limit 100")
def o02_ordered_documents(spark, d):
    """The hundred best documents by verdict, confirmed cells, cells to review, id."""
    return _ranked(spark, d).orderBy("verdict", F.desc("n_ok"), "n_review", "document_id").limit(100).select("document_id", "verdict", "n_ok", "n_review")


@registered(f"with {_CELLS}, {_RANKED} select document_id, verdict from (select *, row_number() over (partition by verdict order by n_ok desc, document_id) as k from v) where k <= 5 and verdict < 2")
def o04_best_of_verdicts(spark, d):
    """Five documents each of the two better verdicts."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("verdict").orderBy(F.desc("n_ok"), "document_id")
    return _ranked(spark, d).where("verdict < 2").withColumn("k", F.row_number().over(w)).where("k <= 5").select("document_id", "verdict")


# Index


@registered()
def r07_grounded_prompts(spark, d):
    """Prompts of all items from the chunks of their location's section, numbered."""
    c = table(spark, d, "chunks").where("document_id is not null").select("document_id", F.try_element_at("section_path", F.lit(-1)).alias("section"), "chunk_key", F.struct("chunk_key", F.concat_ws(" | ", "document_id", "location_label").alias("source"), "text").alias("s"))
    e = table(spark, d, "evaluation_items").select("item_key", "question", F.col("location.document").alias("document_id"), F.col("location.section").alias("section"))
    g = e.join(c, ["document_id", "section"], "left").groupBy("item_key").agg(F.first("question").alias("question"), F.array_sort(F.collect_list("s")).alias("s"))
    return g.select("item_key", answering.grounded_prompt(F.coalesce("question", F.lit("")), F.col("s")).alias("prompt"))


@registered("""select count(*) as n, 0::bigint as n_over, count(*) - (select count(*) from chunks) as n_lost from chunks""")
def r06_batches(spark, d):
    """Chunks dealt into batches of a hundred for embedding: every one in one batch, none over its size."""
    b = answering.batches(table(spark, d, "chunks"), "chunk_key")
    over = b.groupBy("batch").agg(F.count("*").alias("k")).where("k > 100").agg(F.count("*").alias("n_over"))
    n = b.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(over), F.lit(True)).select("n", "n_over", (F.col("n") - F.lit(table(spark, d, "chunks").count())).alias("n_lost"))


# Names in questions


@registered()
def d04_unknown_organisations(spark, d):
    """Words of questions that end like an organisation's name and belong to no known one."""
    return resolve.unknown_organisations(_questions(spark, d), table(spark, d, "buyer_orgs").select(F.col("official_name").alias("name")).unionByName(table(spark, d, "identity_records").select(F.col("buyer_org").alias("name"))))


@registered()
def d06_titles_in_order(spark, d):
    """Projects whose name's words stand in a question in their order, every delivered name being asked for."""
    i = table(spark, d, "identity_records")
    return resolve.titles_in_order(i.select(F.col("record_id").alias("question_id"), F.concat_ws(" ", "buyer_org", "project_name", F.lit("예산은?")).alias("question")), i)


@registered()
def v11_resolution_sweep(spark, d):
    """Every document asked for by true and made-up phrasings of its names: outcomes counted."""
    return resolve.sweep(table(spark, d, "identity_records"))
