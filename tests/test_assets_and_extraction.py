import pytest
from conftest import rows
from pyspark.sql import functions as F

from jangbu.functions.columns import compact
from jangbu.operators import diffs, extract
from jangbu.sources import assets


def test_assets(tmp_path):
    for v in ("table_v2", "table_v10", "table_v9"):
        (tmp_path / v).mkdir()
    assert assets.latest(tmp_path, "table_v*").name == "table_v9"
    with pytest.raises(FileNotFoundError):
        assets.latest(tmp_path, "none*")
    assert assets.layered({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}}, required=("a.x", "b.z")) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    with pytest.raises(KeyError):
        assets.layered({"a": {"x": None}}, required=("a.x",))
    for name, text in (("p", "1"), ("q", "1"), ("r", "2")):
        (tmp_path / name).write_text(text)
    assert assets.one_truth([tmp_path / "no", tmp_path / "p", tmp_path / "q"]).name == "p"
    with pytest.raises(ValueError):
        assets.one_truth([tmp_path / "p", tmp_path / "r"])


def test_upsert(spark):
    base = spark.createDataFrame([("A B", 1, "x"), ("c", 2, "y")], "name string, n int, kept string")
    new = spark.createDataFrame([("ab", None), ("D", 4)], "name string, n int")
    assert rows(diffs.upsert(base, new, compact(F.col("name"))).select("name", "n", "kept")) == sorted([("x", 1, "ab"), ("y", 2, "c"), (None, 4, "D")], key=repr)


def test_extraction(spark):
    text = "# 예산\r\n○ 예산: 5억원\n사업기간은 6개월로 한다.\n사업 기간 : 12개월\n지역제한: 별도 공고를 따른다\n제출 방식 항목은 비공개\n평가 배점은 원문에 값이 없어 확인이 필요하다.\n\n  \n"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, status string")
    got = {(r.doc_id, r.field_name): (r.status, r.answer_raw, r.line_no) for r in extract.table(docs).collect()}
    assert len(got) == 2 * len(extract.LABELS)
    assert got[1, "예산"] == ("value_present", "5억원", 2)
    assert got[1, "사업기간"][0] == "conflict" and got[1, "사업기간"][2] == 3
    assert got[1, "지역제한"][0] == "external_reference" and got[1, "제출 방식"][0] == "not_disclosed" and got[1, "평가 배점"][0] == "field_absent"
    assert got[1, "공고일"] == ("field_absent", None, None) and got[3, "예산"][0] == "field_absent"
