from decimal import Decimal

import pytest

from jangbu.operators import units

LOC = "struct<document_id:string,heading:string>"
SCHEMA = f"row_id long, field_name string, answer_raw string, answer_normalized string, representative_location {LOC}, value string, alias string"
WON = {"4900만원 범위 내": 49_000_000, "금사억이천일백만원整 (￦421,000,000)": 421_000_000, "총 1,582,000천원 (1차년도 727,720천원, 2차년도 854,280천원)": 1_582_000_000, "KRW 5.228 billion": 5_228_000_000,
       "４，６９８，０００천원": 4_698_000_000, "53억1천527만 원": 5_315_270_000, "금육천삼백만원정": 63_000_000, "4.05162억": 405_162_000, "합계 551 [금액 단위 백만원]": 551_000_000, "176 million KRW": 176_000_000,
       "26억2천408만3,000원(부가세 포함)": 2_624_083_000, "1조1237억1000만원": 1_123_710_000_000, "금천만원": 10_000_000, "￦ 76,000,000": 76_000_000, "금 3억2천600만원": 326_000_000}
SPAN = {"계약일로부터 1년 6개월": (18, None), "반년": (6, None), "2.5년": (30, None), "1년 반": (18, None), "24M": (24, None), "P1Y6M": (18, None), "30個月": (30, None), "석 달": (3, None), "40주": (None, 280), "within 24 months": (24, None), "계약 체결 후 6 weeks": (None, 42), "270 일 이내": (None, 270), "P42D": (None, 42), "2024.12.31까지": (None, None)}


def test_amounts_and_spans(spark):
    data = [(i, units.BUDGET, t, None, None, "x", "y") for i, t in enumerate(WON)] + [(1000 + i, units.PERIOD, t, None, None, "x", "y") for i, t in enumerate(SPAN)]
    got = {r.row_id: r for r in units.quantities(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, (text, won) in enumerate(WON.items()):
        assert got[i].raw_won == Decimal(won), text
    for i, (text, (months, days)) in enumerate(SPAN.items()):
        r = got[1000 + i]
        assert (r.raw_months and int(r.raw_months), r.raw_days and int(r.raw_days)) == (months, days), text


@pytest.mark.parametrize(("heading", "unit"), [("사업예산 - 천원", "천"), ("다. 사업비 (단위 : 백만원)", "백만"), ("4. 소요예산", None), (None, None), ("예산(원)", "원")])
def test_units_of_headings(heading, unit):
    assert units.unit_note(heading, units.BUDGET) == unit


def test_disagreeing(spark):
    data = [
        (1, units.BUDGET, "5,000", "5000000", ("d", "예산 (단위: 천원)"), "", ""),  # unit in the heading: agrees
        (2, units.BUDGET, "5,000", "5000", ("d", "예산 (단위: 천원)"), "", ""),
        (3, units.BUDGET, "5,000 [단위: 원]", "5000", ("d", "예산 (단위: 천원)"), "", ""),  # the answer's own unit counts first
        (4, units.BUDGET, None, "5000", None, "", ""),
        (5, units.BUDGET, "", "5000", None, "", ""),
        (6, units.PERIOD, "6", "P6M", ("d", "과업기간(개월)"), "", ""),
        (7, units.PERIOD, "6개월", "180일", None, "", ""),  # months and days are not compared
        (8, units.PERIOD, "6주", "42 days", None, "", ""),
        (9, units.PERIOD, "6주", "40 days", None, "", ""),
        (9_000, units.PERIOD, "6주", "40 days", None, "", ""),  # a repeated row
        (10, "공고일", "1원", "2원", None, "", ""),
        (11, units.BUDGET, "가" * 50_000, "1", None, "", ""),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(r.row_id for r in units.disagreeing(df).collect()) == [2, 9, 9_000]
    assert units.disagreeing(df.limit(0)).count() == 0
