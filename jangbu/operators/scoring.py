"""Scores of answers against gold: sets, lists, values, comparisons, abstention."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jangbu.functions.amounts import graded_amount

#: Longest gold text that may be met by containment, and most text that may stand beside a matched value.
CONTAINED, RESIDUAL = 60, 20
_DATE = re.compile(r"((?:19|20)\d{2})\s*[-./년]\s*(\d{1,2})(?:\s*[-./월]\s*(\d{1,2}))?")
_AMOUNT = re.compile(r"[\d,.]+\s*(?:조|억|천만|백만|만|천)?[\d,.천백십만억\s]*원|[\d,]{5,}")
_CONDITIONS = ("이내", "이상", "이하", "초과", "미만")


def normal(text: str) -> str:
    """Text as scored: one width, lower case, punctuation as blanks, single blanks."""
    import unicodedata

    return re.sub(r"\s+", " ", re.sub(r"[^\w%]+", " ", unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text)).lower())).strip()


def _date(text: str) -> tuple[str, tuple[int, int]] | None:
    m = _DATE.search(text)
    return None if m is None else ("-".join([m[1], m[2].zfill(2), *([m[3].zfill(2)] if m[3] else [])]), m.span())


def match_short(gold: str | None, answer: str | None) -> tuple[bool, str]:
    """Whether an answer states the gold value, and by which rule: exact, date, amount, contained, none.

    A gold date or amount decides alone: what states another one, other
    conditions, or more amounts than the gold does not match.
    """
    if not gold or not answer:
        return False, "none"
    g, a = normal(gold), normal(answer)
    if g == a or g.replace(" ", "") == a.replace(" ", ""):
        return True, "exact"
    if (d := _date(gold)) is not None:
        e = _date(answer)
        rest = "" if e is None else answer[: e[1][0]] + answer[e[1][1] :]
        return e is not None and e[0] == d[0] and len(normal(rest)) <= RESIDUAL, "date"
    amount = graded_amount(gold)
    if amount is not None and re.search(r"\d", gold):
        spans = [m for m in _AMOUNT.finditer(answer) if graded_amount(m[0]) is not None]
        values = {graded_amount(m[0]) for m in spans}
        if values:
            same = {c for c in _CONDITIONS if c in gold} == {c for c in _CONDITIONS if c in answer}
            rest = answer
            for m in reversed(spans):
                rest = rest[: m.start()] + rest[m.end() :]
            return values == {amount} and same and len(normal(rest)) <= RESIDUAL, "amount"
        return False, "amount"
    if len(gold) <= CONTAINED and re.search(rf"(?:^| ){re.escape(g)}(?:은|는|이|가|을|를|의|에|로|으로|와|과|입니다|이다)?(?: |$)", a):
        return True, "contained"
    return False, "none"


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("why", T.StringType())]))
def match_short_udf(gold: pd.Series, answer: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([match_short(g, a) for g, a in zip(gold, answer, strict=True)], columns=["ok", "why"])


def match_list(gold: list[str], answer: list[str]) -> tuple[int, int, int]:
    """Matched, missing and extra items; each item is used once, the longest first."""
    left = sorted((normal(x) for x in answer if normal(x)), key=lambda x: (-len(x), x))
    want = sorted((normal(x) for x in gold if normal(x)), key=lambda x: (-len(x), x))
    hit = 0
    for w in want:
        m = next((x for x in left if x.replace(" ", "") == w.replace(" ", "")), None) or next((x for x in left if w in x or x in w), None)
        if m is not None:
            left.remove(m)
            hit += 1
    return hit, len(want) - hit, len(left)


@F.pandas_udf(T.DoubleType())
def list_score(gold: pd.Series, answer: pd.Series) -> pd.Series:
    """1 if a list is met without missing and extra items, else 0; null lists are empty ones."""
    as_list = lambda x: [] if x is None else [y for y in x if y is not None]
    return pd.Series([float(match_list(as_list(g), as_list(a))[1:] == (0, 0)) for g, a in zip(gold, answer, strict=True)])


def set_score(gold: Column, answer: Column) -> Column:
    """0.7 recall + 0.3 precision of two arrays; for an empty gold 1 if nothing was returned, else 0."""
    empty = F.array().cast("array<string>")
    g, a = F.array_distinct(F.coalesce(gold, empty)), F.array_distinct(F.coalesce(answer, empty))
    hit = F.size(F.array_intersect(g, a))
    return F.when(F.size(g) == 0, (F.size(a) == 0).cast("double")).otherwise(0.7 * hit / F.size(g) + 0.3 * hit / F.greatest(F.size(a), F.lit(1)))


def abstention(should: Column, did: Column, clarified: Column, critical: Column) -> Column:
    """Kind of (non-)abstention: ok, hallucination, clarification_ok, critical_abstain, over_refusal, or answered."""
    return F.when(should & did, "ok").when(should, "hallucination").when(did & clarified, "clarification_ok").when(did & critical, "critical_abstain").when(did, "over_refusal").otherwise("answered")
