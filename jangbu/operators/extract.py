"""Fields of documents extracted into a long table: label hits over lines, a representative, a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels a field is announced by.
LABELS = {
    "사업 개요": "사업\\s?개요|사업\\s?목적", "사업분야": "사업\\s?분야", "공고일": "공고\\s?일", "사업기간": "사업\\s?기간|과업\\s?기간", "예산": "총\\s?사업비|예산|사업\\s?예산|소요\\s?예산", "참가 자격(면허·실적)": "참가\\s?자격", "지역제한": "지역\\s?제한", "컨소시엄 요건": "공동\\s?수급|컨소시엄",
    "평가 배점": "배점|평가\\s?기준", "제출 방식": "제출\\s?방식|제출\\s?방법", "필수 제출 서류": "제출\\s?서류", "과업 범위": "과업\\s?범위",
}
EXTERNAL = "별도|붙임|첨부|참조|따른다|따르며"
UNDISCLOSED = "비공개|공개하지"
ABSENT = "원문에 값이 없|해당\\s?없|없음"


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line`` of every line that is not blank, numbered from 1."""
    e = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n", -1)).alias("i", "line"))
    return e.where(F.length(F.replace("line", F.lit(" "), F.lit(""))) > 0).select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line")


def _value(pattern: str) -> Column:
    """Text behind a label and what joins it to its value."""
    return F.trim(F.regexp_replace(F.regexp_extract("line", f"(?:{pattern})(.*)$", 1), "^(?:\\s*(?:[:：|\\-]|은|는|이|가|에는|항목은|항목)\\s*)+", ""))


def hits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, field_name, line_no, value, heading`` of every line that names a field; a label in a heading has no value of its own."""
    each = F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(f).alias("field_name"), _value(p).alias("value"))) for f, p in LABELS.items()))
    named = lines(documents, key, text).where(F.col("line").rlike("|".join(LABELS.values())))  # one alternation before the twelve patterns
    return named.select(key, "line_no", F.col("line").startswith("#").alias("heading"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("h")).select(key, "h.field_name", "line_no", "h.value", "heading")


def status(value: Column) -> Column:
    return F.when(value.isNull() | (value == ""), "field_absent").when(value.rlike(ABSENT), "field_absent").when(value.rlike(UNDISCLOSED), "not_disclosed").when(value.rlike(EXTERNAL), "external_reference").otherwise("value_present")


def table(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, field_name, status, answer_raw, line_no, n_hits`` for every document and field.

    The representative is the first hit with a value outside headings, else the
    first hit.  A field with several different values is in ``conflict``; one
    without a hit is absent.  One map-side aggregation, no sorting of lines.
    """
    h = hits(documents, key, text).withColumn("plain", ~F.col("heading") & (F.col("value") != "") & (status(F.col("value")) == "value_present"))
    best = h.groupBy(key, "field_name").agg(
        F.min(F.struct((~F.col("plain")).alias("o"), "heading", "line_no", "value")).alias("b"),
        F.count("*").alias("n_hits"),
        F.countDistinct(F.when(F.col("plain"), F.col("value"))).alias("n_values"),
    )
    want = documents.where(F.col(text).isNotNull()).select(key, F.explode(F.array(*map(F.lit, LABELS))).alias("field_name"))
    j = want.join(best, [key, "field_name"], "left")
    return j.select(key, "field_name", F.when(F.col("n_values") > 1, "conflict").otherwise(status(F.col("b.value"))).alias("status"), F.col("b.value").alias("answer_raw"), F.col("b.line_no").alias("line_no"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
