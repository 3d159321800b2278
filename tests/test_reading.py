import pytest

from jangbu.operators import chunking, extraction


def test_outer_rows_keep_nested_tables():
    inner = "<table><tr><td>x</td></tr></table>"
    t = f"<table><tr><th>가</th><th>나</th></tr><tr><td>1</td><td>{inner}</td></tr><tr><td>2<td>3</table>"
    assert [c for *_, c in chunking.outer_rows(t)] == [["가", "나"], ["1", inner], ["2", "3"]]
    assert chunking.outer_tables(f"a{t}b{inner}") == [(1, 1 + len(t)), (2 + len(t), 2 + len(t) + len(inner))]
    parts = chunking.table_parts(t)
    assert len(parts.header) == 1 and len(parts.body) == 2 and parts.head == "<table>"
    assert chunking.table_parts("no table") is None


def test_split_table_repeats_the_header():
    inner = "<table><tr><td>x</td></tr></table>"
    rows = "".join(f"<tr><td>{i}</td><td>{inner if i == 3 else 'y' * 20}</td></tr>" for i in range(12))
    t = f"<table><tr><th>가</th><th>나</th></tr>{rows}</table>"
    parts = chunking.split_table(t, 200)
    assert len(parts) > 2 and all(p.startswith("<table><tr><th>가") and p.endswith("</table>") for p in parts)
    assert sum(len(chunking.outer_rows(p)) - 1 for p in parts) == 12 and sum(inner in p for p in parts) == 1
    pipe = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'z' * 10} |" for i in range(20))
    parts = chunking.split_table(pipe, 120)
    assert all(p.startswith("| a | b |\n|---|---|\n") and len(p) <= 120 for p in parts) and sum(p.count("z" * 10) for p in parts) == 20


def test_pack():
    assert chunking.pack(["aa", "bb", "cc"], 6, 0) == ["aa\n\nbb", "cc"]
    assert chunking.pack(["aa", "b" * 9, "cc"], 6, 2) == ["aa", "b" * 9, "cc"]
    assert chunking.pack(["aaaa", "bb"], 8, 2) == ["aaaa\n\nbb"] and chunking.pack(["aaaa", "bbb"], 8, 1) == ["aaaa", "a\n\nbbb"]
    assert chunking.pack([], 8, 2) == []


def test_headings_are_not_lost():
    text = "# 가\n## 나\n## 다\n글이다.\n# 라\n## 마"
    rows = chunking.chunks_of("d", None, text, 800, 0)
    whole = "\n".join(f"{r[2]}\n{r[-1]}" for r in rows)
    assert all(h in whole for h in "가나다라마")
    assert chunking.chunks_of("d", None, "# 가", 800, 0)[0][-1] == "# 가"


TEXT = """# 사업 안내
목차
1. 사업 개요 ........ 3
2. 사업 예산 ........ 4
## 1. 사업 개요
사업 목적: 노후한 시스템을 새로 구축한다
## 2. 조건
○ 총 사 업 비 : 5억원(부가세 포함)
○ 사업기간
 - 계약일로부터 12개월
| 구분 | 내용 |
| 지역제한 | 가온 권역 본점 업체 |
| 제출방식 | 조달 창구 온라인 제출 |
공동수급: 3개사 이내로 허용한다
평가배점 : 기술 80점 가격 20점
제출서류 : 별도 공고문 참조
참가자격 : 「국가계약법」 제12조
공고일: 비공개
붙임 1 서식
사업기간 : 6개월
"""


def test_document_rows():
    rows = {r[0]: r for r in extraction.rows_of(TEXT)}
    assert len(rows) == 12
    assert rows["예산"][1:4] == ("value_present", "5억원(부가세 포함)", 8) and rows["예산"][4] == ["사업 안내", "2. 조건"]
    assert rows["사업기간"][1] == "value_present" and "12개월" in rows["사업기간"][2]  # the attachment's period does not count
    assert rows["지역제한"][1:3] == ("value_present", "가온 권역 본점 업체") and rows["지역제한"][5] == "table"
    assert rows["컨소시엄 요건"][1] == "value_present" and rows["평가 배점"][1] == "value_present"
    assert rows["필수 제출 서류"][1] == "external_reference" and rows["공고일"][1] == "not_disclosed" and rows["참가 자격(면허·실적)"][1] == "review_required"
    assert rows["과업 범위"][1] == "field_absent" and rows["사업 개요"][1] == "value_present"
    twice = {r[0]: r for r in extraction.rows_of("예산: 5억원\n예산 : 6억원\n사업기간: 1년\n사업기간: 12개월")}
    assert twice["예산"][1] == "conflict" and twice["사업기간"][1] == "value_present"


@pytest.mark.parametrize(("text", "target", "only"), [("별도 공고문 참조", "공고문", True), ("제안요청서를 참고", "제안요청서", True), ("온라인 제출", "", False), ("신청서 1부와 서약서 2부를 내며 나머지 서류는 공고문 참조", "공고문", False), (None, "", False)])
def test_references(text, target, only):
    assert extraction.external_only(text) == only
    assert (target in extraction.external_target(text)) if target else extraction.external_target(text) == ""


def test_extract_operator(spark):
    df = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, status string")
    got = extraction.extract(df).collect()
    assert len(got) == 24 and {r.doc_id for r in got} == {1, 3} and all(r.status == "field_absent" for r in got if r.doc_id == 3)
    assert extraction.extract(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(f"담당 부서: 총무과 {i}\n예산: 1억원",) for i in range(4)], "text string")
    assert [r.label for r in extraction.new_labels(labels).collect()] == ["담당 부서"]
