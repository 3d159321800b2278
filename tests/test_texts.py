import pytest

from jangbu.functions import amounts, answers, names


@pytest.mark.parametrize(("f", "x", "want"), [
    (names.shown, " 가 \n  나 ", "가 나"), (names.shown, None, ""),
    (names.organisation_key, "(재) 다솔도  테크노파크", "다솔도테크노파크"), (names.organisation_key, "ＡＢＣ 주식회사", "abc"),
    (names.project_key, "제2차 사업 (재공고)", "2차사업재공고"), (names.unbracketed, "가 (나 (다) 라) 「마바」 사", "가 마바 사"), (names.unbracketed, "가 (나", "가 (나"),
    (names.is_generic, "구축사업용역", True), (names.is_generic, "재난관제구축", False), (names.is_generic, "", False),
    (names.possessive_folded, "AI 기반의 영상 시스템", "AI 기반 영상 시스템"), (names.possessive_folded, "제안서 심의 위원회", "제안서 심의 위원회"), (names.possessive_folded, "의정부시 의료원", "의정부시 의료원"), (names.possessive_folded, "통합의", "통합의"),
    (names.rounds, "기능개선 사업(2차)", [2]), (names.rounds, "3차원 설계 용역", []), (names.rounds, "1차사업", [1]),
    (names.asked_rounds, "기능개선 사업(2차)의 예산은?", [2]), (names.asked_rounds, "2차 공고인 사업의 예산은?", []), (names.asked_rounds, "재공고 2차 사업의 예산은?", []), (names.asked_rounds, "제2차 사업은?", [2]), (names.asked_rounds, "공고(2차) 사업", []), (names.asked_rounds, "사업(2차) 회의", [2]), (names.asked_rounds, "앞서 말한 2차 질문", []),
    (answers.scored, "시․공간 Ⅳ단계, ＡＢ", "시 공간 4단계 ab"), (answers.scored, "6 개 월", "6 개월"), (answers.without_ending, "계약일로부터 6개월입니다.", "계약일로부터 6개월"), (answers.without_ending, "가", "가"), (answers.without_ending, "이", "이"),
    (answers.absence, "없음", "confirmed"), (answers.absence, "확인할 수 없습니다", "not_verified"), (answers.absence, "없음(확인할 수 없음)", "not_verified"), (answers.absence, "없다고 단정할 수 없습니다", "not_verified"), (answers.absence, "원문에 해당 항목 자체가 없음(값이 없다는 뜻으로 단정할 수 없음)", "confirmed"), (answers.absence, "지역 제한 없음", "confirmed"), (answers.absence, "3억원", "other"),
    (answers.field_absence, "문서에 지역제한이 기재되어 있지 않습니다", "stated"), (answers.field_absence, "문서에 기재되어 있지 않으므로 전국 업체가 참여 가능합니다", "inferred"), (answers.field_absence, "확인되지 않습니다", "not_verified"), (answers.field_absence, "지역 제한 없음", "other"), (answers.field_absence, "", "other"),
    (answers.stated_date, "2024년 5월 3일까지", "2024-05-03"), (answers.stated_date, "2024. 5", "2024-05"), (answers.stated_date, "없음", None),
    (answers.stated_time, "오후 4시", "16:00"), (answers.stated_time, "2024-05-03 오전 12시 30분", "00:30"), (answers.stated_time, "16:05", "16:05"), (answers.stated_time, "2024-05-03", None),
    (answers.ratio_pair, "기술 80점 가격 20점", [80, 20]), (answers.ratio_pair, "기술 80점 가격 30점", []),
    (answers.comparison_key, "2024-5-3", "DATE:2024-05-03"), (answers.comparison_key, "금 5억원", "AMT:500000000"), (answers.comparison_key, "서울 본점", "서울 본점"), (answers.comparison_key, None, ""),
    (answers.list_units, ["1. 가", "가. 나", "2. 다", "- 라"], ["가 가. 나", "다 - 라"]), (answers.list_units, ["가", "나"], ["가", "나"]), (answers.list_units, ["- 가", "- 나"], ["가", "나"]),
    (answers.verdict, 'x {"verdict": "pass", "score": 0.5} y', (True, 0.5, "json")), (answers.verdict, "No.", (False, None, "word")), (answers.verdict, "", (None, None, "none")), (answers.verdict, "{broken} 네", (True, None, "word")),
    (answers.evidence_marks, "값은 3억이다 [근거 1, 3] [used: 2]", ("값은 3억이다", [1, 2, 3])), (answers.model_family, "GPT-5-mini", "openai"), (answers.model_family, "own", "own"),
    (answers.list_json, "1. 가나\n2. 다라\n\n- 마", '["가나", "다라", "마"]'),
])
def test_values(f, x, want):
    assert f(x) == want


def test_pairs():
    assert answers.periods_differ("착수일부터 12개월", "1년") is False and answers.periods_differ("6개월", "7개월") is True and answers.periods_differ("6개월", "90일") is True
    assert answers.periods_differ("2024-01-01 ~ 2024-12-31", "2024년 12월 31일까지") is False and answers.periods_differ("없음", "6개월") is None
    assert answers.as_list('["가", null, " 나 "]') == ["가", "나"] and answers.as_list(None, "가\n\n나") == ["가", "나"] and answers.as_list("[깨진", None) == ["[깨진"]
    assert answers.residual("예산은 5억원입니다", "5억원") == "예산은 입니다"
    assert names.without_organisation("서민금융원 채팅 상담", "(재)서민금융원") == "채팅상담" and names.without_organisation("채팅", "서민금융원") == ""
    assert names.file_alias("기관_자동분석 시스.md", "기관", "자동분석 시스템 구축") == "자동분석 시스템" and names.file_alias("다른_x.md", "기관", "x") == "" and names.file_alias("기관_자동분석.md", "기관", "자동분석 시스템") == "자동분석"
    assert amounts.conditions("5억원 이내 (부가세 포함)") == {"이내", "vat_included"}
    assert amounts.stated_amounts("총 5억원, 10,000달러, 사업 3건") == [(500_000_000, "5억", False), (10_000, "10,000", True)]


def test_budget_column(spark):
    df = spark.createDataFrame([("3억원 이내",), ("1억원 또는 2억원",), ("1,000달러",), (None,)], "t string")
    got = [r.b for r in df.select(amounts.budget("t").alias("b")).collect()]
    assert (got[0].krw, list(got[0].conditions)) == (300_000_000, ["이내"]) and got[1].krw is None and list(got[1].amounts) == [100_000_000, 200_000_000] and got[2].foreign and got[3].amounts is None
