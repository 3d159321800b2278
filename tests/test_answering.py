import re
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from jangbu.operators import answering, contracts, grading, index, reports, resolve, selection
from jangbu.plans import parse as P

ROWS = "row_id long, document_id string, field_name string, status string, answer_raw string, answer_normalized string, active string"


def table(spark):
    data = [
        (1, "d1", "예산", "value_present", "3억원", "300000000", "true"), (2, "d1", "지역제한", "value_present", "가온 권역 본점 업체", None, "true"), (3, "d1", "컨소시엄 요건", "value_present", "공동수급 허용", None, None),
        (4, "d2", "예산", "conflict", "1억원 또는 2억원", None, "true"), (5, "d2", "지역제한", "value_present", "전국", None, "true"), (6, "d2", "컨소시엄 요건", "value_present", "공동수급 불허", None, "true"),
        (7, "d3", "예산", "value_present", "50,000,000원", "50000000", "true"), (8, "d3", "지역제한", "field_absent", None, None, "true"), (9, "d3", "예산", "value_present", "9억원", "900000000", "true"), (10, "d4", "예산", "value_present", "5억", "500000000", "false"), (11, None, "예산", None, None, None, None),
    ]
    return spark.createDataFrame(data, ROWS)


def test_questions_to_answers(spark):
    docs = spark.createDataFrame([("d1",), ("d2",), ("d3",), ("d4",)], "document_id string")
    ask = lambda q, **k: {r.document_id: r.verdict for r in answering.answer_selection(q, table(spark), docs, **k).collect()}
    assert ask("예산이 1억원 이상인 사업을 모두 찾아줘") == {"d1": "confirmed", "d2": "undetermined", "d4": "undetermined"}
    assert ask("예산이 1억원 이상이 아닌 사업을 찾아줘") == {"d3": "confirmed", "d2": "undetermined", "d4": "undetermined"}
    assert ask("컨소시엄이 가능한 사업") == {"d1": "confirmed", "d3": "undetermined", "d4": "undetermined"}
    assert ask("지역제한이 걸린 사업") == {"d1": "confirmed", "d3": "undetermined", "d4": "undetermined"}
    assert ask("예산이 1억원 이상 또는 지역제한이 없는 사업") == {} and ask("예산이 궁금한 사업") == {}
    deadlines = spark.createDataFrame([("d1", datetime(2024, 1, 1)), ("d1", datetime(2024, 7, 1)), ("d2", datetime(2023, 1, 1))], "document_id string, deadline timestamp_ntz")
    got = {r.document_id: r.note for r in answering.answer_selection("예산이 1억원 이상인 사업", table(spark), docs, deadlines).collect()}
    assert got == {"d1": None, "d4": "마감일 미상"}
    assert answering.answer_selection("예산이 1억원 이상인 사업", table(spark).limit(0), docs.limit(0)).count() == 0


def test_parser_reports_what_it_does_not_read():
    p = P.parse("예산이 1,500,000원 이상이고 컨소시엄이 필수가 아닌 사업을 찾아줘")
    assert [(c.field, c.operator, c.negated) for c in p.conditions] == [("예산", ">=", False), ("컨소시엄 요건", "required", True)] and p.executable
    assert P.parse("지역제한이 없는 것이고 지역제한이 있는 사업").unresolved and not P.parse("지역제한이 없는 것이고 지역제한이 있는 사업").executable
    assert P.parse("예산이 5억원 이상이고 예산이 1억원 이하인 사업").unresolved
    assert P.parse("안녕하세요, 지역제한이 없는 사업을 찾아줘").background == ["안녕하세요"]
    assert P.parse("지역제한이 없는 사업이고 실적이 없는 업체").unresolved
    assert P.segments("예산이 1,000,000원 이상, 배점이 있는") == ["예산이 1,000,000원 이상", "배점이 있는"]
    assert P.is_selection("예산이 1억원 이상인 사업을 모두 찾아줘") and not P.is_selection("RFP-00000001의 예산이 1억원 이상인 사업") and not P.is_selection("예산은 얼마인가요")
    assert P.mentions("예산과 제출 서류, 필수 제출 서류") == [(0, 2, "예산"), (4, 9, "필수 제출 서류"), (11, 19, "필수 제출 서류")]
    assert P.literal_values("사업분야가 '교육'인 사업") == ["교육"]


def test_grades(spark):
    ev = "array<struct<kind:string,field:string,status:string,value:string,source:string,location:struct<document:string,section:string,ref_no:string,line:int>>>"
    absent = [("table", "지역제한", "field_absent", None, None, ("D", None, None, None))]
    schema = f"item_key long, task_type string, answer_type string, answer_raw string, answer_normalized string, document_id string, field_tag string, answer_source string, evidence {ev}"
    items = [
        (1, "qa", "value", "5억원", None, "D", "major", "table", None), (2, "qa", "value", "해당 없음", None, "D", "major", "table", absent), (3, "qa", "value", "해당 없음", None, "D", "major", "table", absent), (4, "qa", "unanswerable", None, None, None, "critical", None, None),
        (5, "extraction", "list", "가, 나", None, "D", None, None, None), (6, "qa", "summary", "제안서, 제안서 요약본", None, "D", None, None, None), (7, "selection", "document_set", None, None, " d ", None, None, None), (8, "qa", "value", "5억원", None, "D", None, None, None), (9, "qa", "value", "x", None, "D", None, None, None),
    ]
    responses = [
        (1, "500,000,000원", None, [], False, None), (2, "문서에 지역제한 항목이 기재되어 있지 않습니다", None, [], False, None), (3, "문서에 기재되어 있지 않으므로 전국 업체가 참여 가능합니다", None, [], False, None), (4, "", None, [], True, None),
        (5, None, ["나", "가"], [], False, None), (6, "제안서 요약본", None, [], False, None), (7, None, None, ["D", "E"], False, None), (8, "5억원", None, [], False, "timeout"),
    ]
    i = spark.createDataFrame(items, schema)
    r = spark.createDataFrame(responses, "item_key long, answer string, items array<string>, selected_document_ids array<string>, abstained boolean, failure string")
    got = {x.item_key: (x.score, x.final_status) for x in grading.score_items(i, r).collect()}
    assert got == {
        1: (1.0, "PASS"), 2: (1.0, "PASS"), 3: (0.0, "FAIL-content"), 4: (1.0, "PASS"), 5: (1.0, "PASS"), 6: (0.5, "PENDING_THRESHOLD"), 7: (0.85, "PENDING_THRESHOLD"), 8: (0.0, "FAIL-system"), 9: (0.0, "FAIL-format+content"),
    }
    s = grading.score_items(i, r)
    z = reports.zero_split(s).collect()[0]
    assert (z.n_items, z.system_zero, z.content_zero) == (9, 1, 2)
    assert grading.score_items(i.limit(0), r).count() == 0
    cache = spark.createDataFrame([("k1", "a"), ("k1", "b"), (None, "c")], "cache_key string, value string")
    assert rows(grading.cached(spark.createDataFrame([("k1",), ("k2",), (None,)], "cache_key string"), cache)) == sorted([("k1", True, "b"), ("k2", False, None), (None, False, None)], key=repr)


def test_diagnosis_and_layers(spark):
    cols = ["retrieval_recall", "faithfulness", "extraction_accuracy", "selection_score", "doc_selection_accuracy", "task_score", "extract_score", "score_dropped"]
    data = [(0.5, 0.9, None, None, None, 0.9, None, False), (0.9, 0.9, None, None, None, 0.1, None, False), (None, None, 0.5, 0.9, None, None, None, None), (0.9, 0.9, 0.95, 0.9, 0.9, 0.9, 0.9, True), (None,) * 8]
    v = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "i int, " + ", ".join(f"{c} double" for c in cols[:-1]) + ", score_dropped boolean")
    got = {r.i: list(r.findings) for r in reports.diagnose(v).collect()}
    assert got == {0: ["retrieval"], 1: ["faithful_but_wrong"], 2: ["circularity"], 3: ["corpus_or_items_moved"], 4: ["unclear"]}
    outcomes = spark.createDataFrame([("a", 0), ("b", 2), ("c", 0)], "layer string, n_failed long")
    assert [r.state for r in reports.layers(outcomes, ["a", "b", "c", "d"]).orderBy("place").collect()] == ["pass", "FAIL", "skipped", "skipped"]


def test_plans(spark):
    plan = answering.PLAN
    data = [(1, "q", 1, ("selection", "list", "all", ["b", "a", None], ["f"], " x  y ")), (2, "q", 2, ("selection", "list", "all", ["a", "b", "a"], ["f"], "x y")), (3, "r", 1, ("clarify", None, None, None, None, None)), (4, "s", 1, None)]
    df = spark.createDataFrame(data, f"k long, question_id string, at long, approved_plan struct<{plan.replace(' ', ':').replace(',:', ',')}>")
    sig = {r.k: r.s for r in df.select("k", answering.signature().alias("s")).collect()}
    assert sig[1] == sig[2] != sig[3]
    loops = answering.loops(df.withColumn("s", answering.signature()), "question_id", ["at"], "s", F.col("approved_plan.action") == "clarify")
    assert {r.question_id: (r.outcome, r.tools) for r in loops.collect()} == {"q": ("repeated", 1), "r": ("answered", 0), "s": ("open", 1)}
    texts = spark.createDataFrame([('{"action":"fly","document_scope":"specific_documents","answer_mode":"x"}',), ("no json",), (None,), ('{"action":"clarify","document_scope":"all","answer_mode":"x"}',)], "t string")
    assert [list(r.p) for r in texts.select(answering.decision_problems(F.col("t")).alias("p")).collect()][0] == ["unknown_action", "no_documents"] and [list(r.p) for r in texts.select(answering.decision_problems(F.col("t")).alias("p")).collect()][3] == []
    pools = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b"), ("z", "a"), ("z", "b")], "pool string, document_id string")
    assert [r.document_id for r in answering.assigned(pools, ["x", "y", "z"]).collect()] == ["a", "b", None]


def test_batches_hold_everything_once(spark):
    b = answering.batches(spark.range(1000).withColumnRenamed("id", "k"), "k", 30)
    sizes = [r["count"] for r in b.groupBy("batch").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 30 and b.select("batch", "place").distinct().count() == 1000


@pytest.mark.parametrize("most", [0, 1000])
def test_names_met_on_rare_grams(spark, monkeypatch, most):
    import random

    monkeypatch.setattr(resolve, "GROUP", most)

    r = random.Random(2)
    word = lambda n: "".join(r.choice("가나다라마") for _ in range(n))
    keys, texts = [word(r.randint(2, 7)) for _ in range(60)], [word(r.randint(0, 40)) for _ in range(80)] + [None]
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    t = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {(x.i, x.key) for x in resolve.contained(t, k, "i", "t").collect()}
    assert got == {(i, x) for i, s in enumerate(texts) if s for x in set(keys) if len(x) >= 4 and x in s} and got
    q = spark.createDataFrame([(1, "가온시 체육회와 나래군 도서관협의센터의 예산"), (2, None)], "question_id long, question string")
    names = spark.createDataFrame([("나래군 도서관협의센터",), (None,)], "name string")
    assert resolve.unknown_organisations(q, names).count() == 0
    assert [r.word for r in resolve.unknown_organisations(q, names.limit(0)).collect()] == ["도서관협의센터"]
    i = spark.createDataFrame([("d", "2024년 「나래」 재난관제 구축"), ("e", "다른 이름 사업"), ("f", None)], "document_id string, project_name string")
    q = spark.createDataFrame([(1, "2024년도 나래의 재난관제를 구축하는 건"), (2, "재난관제 나래 구축 2024년")], "question_id long, question string")
    assert rows(resolve.titles_in_order(q, i)) == [("d", 1)]


def test_contracts(spark):
    base = spark.createDataFrame([("a", 1), ("b", None)], "id string, v int")
    merged, unknown = contracts.replaced(base, spark.createDataFrame([("b", 5), ("z", 1)], "id string, v int"), "id", "v")
    assert rows(merged) == sorted([("a", False, 1), ("b", True, 5)]) and rows(unknown) == [("z",)]
    report = contracts.contract_report({"x": base, "y": base.limit(0), "r": base, "gone": None}, review=("r",))
    assert {r.name: r.state for r in report.collect()} == {"x": "FAIL", "y": "PASS", "r": "REVIEW", "gone": "SKIP"}
    assert {r.name: r.state for r in contracts.contract_report({"x": base, "gone": None}, final=True).collect()}["gone"] == "FAIL"
    items = spark.createDataFrame([(1, "한글로 쓴 아주 긴 질문 하나 더", None), (2, "짧다", "또 하나의 충분히 긴 정답이다")], "item_key long, question string, answer_raw string")
    docs = spark.createDataFrame([(7, "앞 한글로  쓴 아주 긴 질문 하나, 더! 뒤"), (8, None), (9, "짧다")], "doc_id long, text string")
    assert rows(contracts.leaked(items, docs, "doc_id", "text")) == [(7, 1)]
    p = contracts.provenance_problems(spark.createDataFrame([("a", "v1"), ("a", "v1"), ("b", None), ("c", "unknown")], "k string, x string"), ["x"], ["k"])
    assert {r.k: (list(r.problems), r.reproducible) for r in p.collect()} == {"a": ([], True), "b": (["no_x"], False), "c": (["unknown_x"], False)}


def test_index(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    m = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "vec_id long, chunk_id string")
    assert rows(index.loaded(v, m)) == [("a", 2, 1), ("b", 1, 2)]
    a = index.alignment(v, m, "vec_id", "embedding").collect()[0]
    assert (a.n_vectors, a.n_rows, a.n_without_row, a.n_without_vector, a.n_dimensions) == (3, 3, 1, 1, 2)
    data = [("v1", "v1", 1, None), (None, "v2", 1, None), ("v1", "v2", 1, None), (None, None, 0, "s"), (None, None, 0, None)]
    df = spark.createDataFrame(data, "d string, r string, n int, s string")
    assert [x.l for x in df.select(index.lineage(F.col("d"), F.col("r"), F.col("n"), F.col("s")).alias("l")).collect()] == ["declared:v1", "records:v2", "conflict", "settings:s", "unknown"]
    assert selection.id_lists(spark.createDataFrame([("a", True, None, None), ("a", False, None, None), ("b", None, None, "x"), (None, True, None, None)], "document_id string, retrieval_eligible boolean, deleted_at timestamp, duplicate_of_document_id string")).where("list = 'included'").count() == 1


def test_many_names_do_not_pass_the_driver(spark, monkeypatch):
    """d02: more keys than an automaton is built of meet the texts in the workers."""
    monkeypatch.setattr(resolve, "_found", lambda *_: pytest.fail("keys were gathered"))
    n = 25_000
    word = F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "가나다라마바사아자차")
    keys = spark.range(n).select(word.alias("key"))
    texts = spark.createDataFrame([(1, "앞가가나다라마뒤"), (2, "가가가가가 가가"), (3, "가나다라마바 가가"), (4, None), (5, "가")], "i long, t string")
    assert rows(resolve.contained(texts, keys, "i", "t")) == [(1, "가가나다라마"), (3, "가나다라마바")]


def test_titles_do_not_pass_the_driver(spark):
    """d06: no table is broadcast, however small it looks."""
    i = spark.createDataFrame([("d", "2024년 「나래」 재난관제 구축"), ("e", "다른 이름 사업"), ("f", None), ("g", "나래 재난관제")], "document_id string, project_name string")
    q = spark.createDataFrame([(1, "2024년도 나래의 재난관제를 구축하는 건"), (2, "재난관제 나래 구축 2024년"), (3, None), (4, "사업 다른 이름")], "question_id long, question string")
    found = resolve.titles_in_order(q, i)
    assert rows(found) == [("d", 1), ("g", 1)]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_question_does_not_meet_all_documents_of_its_organisation(spark):
    """v11: outcomes are those of whole sets of documents, of which only the ends are kept."""
    import random

    r = random.Random(9)
    org, project = [f"기관이름{c}" for c in "가나다라"], [f"사업명칭{c}" for c in "가나다라마바사"]
    keys = {(k, key, f"d{d}") for d in range(9) for k, names in (("org", org), ("project", project)) for key in r.sample(names, r.randint(0, 2))} | {("project", org[0], "d3"), ("org", project[6], "d8"), ("org", "기관이름하", "d0")}
    asked = [(i, " ".join(r.sample(org, r.randint(0, 2)) + r.sample(project, r.randint(0, 2)))) for i in range(150)] + [(998, "기관이름하"), (999, None)]
    want = {}
    for i, q in asked:
        docs = lambda kind: {d for k, key, d in keys if k == kind and q and key in q}  # noqa: B023, E731
        o, p = docs("org"), docs("project")
        b = o & p
        outcome = "none" if not o | p else "org_and_project" if len(b) == 1 else "ambiguous" if b else "conflict" if o and p else "project" if len(p) == 1 else "ambiguous" if p else "org" if len(o) == 1 else "ambiguous"
        want[i] = (outcome, next(iter({"org_and_project": b, "project": p, "org": o}.get(outcome, [None]))))
    got = resolve.resolve(spark.createDataFrame(asked, "question_id long, question string"), spark.createDataFrame(sorted(keys), "kind string, key string, document_id string"))
    assert {x.question_id: (x.outcome, x.document_id) for x in got.collect()} == want and len({x for x, _ in want.values()}) == 6
    # 3,000 questions about one organisation of 3,000 documents: nine million rows if they met
    many = spark.range(3_000).select(F.lit("org").alias("kind"), F.lit("기관이름가").alias("key"), F.col("id").cast("string").alias("document_id"))
    plan = resolve.resolve(spark.range(3_000).select(F.col("id").alias("question_id"), F.lit("기관이름가의 예산").alias("question")), many)
    assert [(x.outcome, x.n) for x in plan.groupBy("outcome").agg(F.count("*").alias("n")).collect()] == [("ambiguous", 3_000)]
    assert not re.search(r"Aggregate \[question_id#\d+L?, document_id#", plan._jdf.queryExecution().optimizedPlan().toString())
