"""Quantities recorded in different units, brought to common units.

A multi-pattern automaton finds unit aliases; the scanner pairs each with the
number it stands beside (longest alias wins, the field decides between senses,
as ``M`` for months or millions).  Terms leave the scanner as ``number@alias``
and are priced by a broadcast join with the conversion-factor table, so adding
a unit is adding a row.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUDGET, PERIOD = "예산", "사업기간"

# Unit aliases (lower case, NFKC) by the unit they mean.
MONEY_ALIASES = {
    "원": 1, "won": 1, "krw": 1, "₩": 1, "원정": 1,
    "십": 10, "백": 100, "천": 1_000, "만": 10_000, "억": 100_000_000, "조": 1_000_000_000_000,
    "십만": 100_000, "백만": 1_000_000, "천만": 10_000_000, "십억": 1_000_000_000, "백억": 10_000_000_000, "천억": 100_000_000_000,
    "십조": 10_000_000_000_000, "백조": 100_000_000_000_000, "천조": 1_000_000_000_000_000,
    "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000, "trillion": 1_000_000_000_000,
    "k": 1_000, "mn": 1_000_000, "m": 1_000_000, "bn": 1_000_000_000, "b": 1_000_000_000,
}
MONTH_ALIASES = {"개월": 1, "개월간": 1, "월": 1, "월간": 1, "달": 1, "달간": 1, "個月": 1, "箇月": 1, "ヶ月": 1, "月": 1, "month": 1, "months": 1, "mo": 1, "mos": 1, "m": 1, "반년": 6, "반": 6, "분기": 3, "년": 12, "년간": 12, "개년": 12, "年": 12, "year": 12, "years": 12, "yr": 12, "yrs": 12, "y": 12}
DAY_ALIASES = {"일": 1, "일간": 1, "일수": 1, "日": 1, "day": 1, "days": 1, "d": 1, "주": 7, "주간": 7, "주일": 7, "週": 7, "week": 7, "weeks": 7, "wk": 7, "wks": 7, "w": 7, "보름": 15}

SMALL, LARGE = ("십", "백", "천"), ("만", "억", "조")
DIGITS = {c: i for i, c in enumerate("영일이삼사오육칠팔구")} | {"공": 0, "零": 0} | {c: i + 1 for i, c in enumerate("一二三四五六七八九")} | {c: i + 1 for i, c in enumerate("壹貳參四五六七八九")}
PLACES = {"십": 10, "백": 100, "천": 1000, "十": 10, "百": 100, "千": 1000, "拾": 10, "만": 10**4, "억": 10**8, "조": 10**12, "萬": 10**4, "億": 10**8, "兆": 10**12}
NATIVE = {"한": 1, "두": 2, "세": 3, "석": 3, "네": 4, "넉": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10}

_NUM = re.compile(r"\d[\d,]*(?:\.\d+)?")
_HANGUL_NUM = re.compile("[" + "".join({*DIGITS, *PLACES}) + "]{2,}")
_NATIVE_NUM = re.compile("(" + "|".join(sorted(NATIVE, key=len, reverse=True)) + r")\s*(?=달|해|주)")
_DATE = re.compile(r"\d{4}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}\s*[.일]?")
_TOTAL = re.compile(r"(총|합계|총액|총계|total|sum)[^0-9]{0,12}$")
_JOINED = re.compile(r"(?<=[십백천만억조])\s+(?=[십백천만억조원])|(?<=[십백천만억조원])\s+(?=정\b)")
_ISO = re.compile(r"^\s*p(?:(\d+(?:\.\d+)?)y)?(?:(\d+(?:\.\d+)?)m)?(?:(\d+(?:\.\d+)?)w)?(?:(\d+(?:\.\d+)?)d)?\s*$")


def conversion_factors(spark: SparkSession) -> DataFrame:
    """The factor table: ``field_name, alias, dimension, factor`` (about 60 rows, fixed)."""
    rows = [(BUDGET, a, "won", f) for a, f in MONEY_ALIASES.items()]
    rows += [(PERIOD, a, "months", f) for a, f in MONTH_ALIASES.items()]
    rows += [(PERIOD, a, "days", f) for a, f in DAY_ALIASES.items()]
    return spark.createDataFrame(rows, "field_name string, alias string, dimension string, factor long")


@lru_cache(maxsize=4)
def _automaton(field: str):
    import ahocorasick

    a = ahocorasick.Automaton()
    for alias in MONEY_ALIASES if field == BUDGET else {**MONTH_ALIASES, **DAY_ALIASES}:
        a.add_word(alias, alias)
    a.make_automaton()
    return a


def _fold(text: str) -> str:
    t = unicodedata.normalize("NFKC", text).lower().replace("￦", "₩").replace("千", "천").replace("百", "백").replace("萬", "만").replace("億", "억").replace("圓", "원")
    return _JOINED.sub("", t)


def _hangul_value(run: str) -> int | None:
    """The integer a run of number words spells, or None if it does not spell one."""
    total = part = digit = 0
    for c in run:
        if c in DIGITS:
            if digit:
                return None
            digit = DIGITS[c]
        elif PLACES[c] < 10**4:
            part += (digit or 1) * PLACES[c]
            digit = 0
        else:
            total += (part + digit or 1) * PLACES[c]
            part = digit = 0
    return total + part + digit


def _aliases(text: str, field: str) -> dict[int, str]:
    """Longest alias starting at each position, Latin ones only as whole words."""
    found: dict[int, str] = {}
    for end, alias in _automaton(field).iter(text):
        start = end - len(alias) + 1
        if alias[0].isascii():
            if end + 1 < len(text) and text[end + 1].isascii() and text[end + 1].isalpha() or start and text[start - 1].isascii() and text[start - 1].isalpha():
                continue
        if len(alias) > len(found.get(start, "")):
            found[start] = alias
    return found


_NOTE = re.compile(r"단위|기준|[(\[]|\s-\s")


def unit_note(text: str | None, field: str) -> str | None:
    """The unit a text names without a number: ``(단위: 천원)``, ``[일수]``, ``사업비 - 백만원``; None if it names none."""
    if not text:
        return None
    t = _fold(text)
    hits = _aliases(t, field)
    for m in _NOTE.finditer(t):
        i = m.end()
        while i < len(t) and not (i in hits):
            if t[i] not in " :：=단위금액기준(":
                break
            i += 1
        if i in hits:
            alias = hits[i]
            j = i + len(alias)
            rest = t[j:].lstrip()
            if field == BUDGET and rest[:1] == "원":  # a scale and its currency
                rest = rest[1:].lstrip()
            if not rest or rest[0] in ")]}" or not rest[0].isalnum():
                return alias
    return None


def scan(text: str | None, field: str, note: str | None) -> str:
    """The stated quantity as ``number@alias`` terms joined by ``;`` (empty if none).

    Of several quantities the one marked as total counts, else the first; numbers
    without a unit count only where no number has one, and take ``note``.
    """
    if text is None:
        return ""
    t = _DATE.sub(" ", _fold(text))
    if field == PERIOD and (m := _ISO.match(t)) and any(m.groups()):
        return ";".join(f"{v}@{u}" for v, u in zip(m.groups(), ("년", "개월", "주", "일"), strict=True) if v)
    hits = _aliases(t, field)
    numbers: dict[int, tuple[int, str]] = {m.start(): (m.end(), m[0].replace(",", "")) for m in _NUM.finditer(t)}
    if field == BUDGET:
        for m in _HANGUL_NUM.finditer(t):
            if m.start() and t[m.start() - 1].isdigit() or not any(c in PLACES for c in m[0]) or not any(c in DIGITS for c in m[0]) and not t[: m.start()].rstrip().endswith("금"):  # bare places are a unit, '백만원', but after 금
                continue
            if t[m.end() : m.end() + 1] == "원" and (v := _hangul_value(m[0])):
                numbers[m.start()] = (m.end(), str(v))
                for k in range(m.start(), m.end()):
                    hits.pop(k, None)
    else:
        for m in _NATIVE_NUM.finditer(t):
            numbers[m.start()] = (m.end(), str(NATIVE[m[1]]))
    groups: list[tuple[bool, bool, list[tuple[str, str]]]] = []  # total?, has a unit?, terms
    at, order = 0, sorted(numbers)
    last_end = -2
    for i in order:
        if i < at:
            continue
        end, number = numbers[i]
        j = end
        while j < len(t) and t[j] == " ":
            j += 1
        alias = hits.get(j, "")
        stop = j + len(alias) if alias else end
        if alias in ("krw", "won", "₩", "원", "원정") or not alias:
            before = t[:i].rstrip()
            if not alias and field == BUDGET and (before.endswith("krw") or before.endswith("₩")):
                alias = "krw"
        elif field == BUDGET:  # 'million krw', '백만원': the currency adds nothing
            k = stop
            while k < len(t) and t[k] == " ":
                k += 1
            if hits.get(k) in ("원", "원정", "krw", "won"):
                stop = k + len(hits[k])
        joined = bool(groups) and groups[-1][1] and bool(alias) and not t[last_end:i].strip(" ") and i - last_end <= 1
        if joined and groups[-1][2][-1][1] in ("원", "krw", "won", "₩"):
            joined = False
        if joined:
            groups[-1][2].append((number, alias))
        else:
            groups.append((bool(_TOTAL.search(t[:i])), bool(alias), [(number, alias)]))
        at = last_end = stop
        if field == PERIOD and alias in ("년", "년간") and t[stop:].lstrip()[:1] == "반":
            groups[-1][2].append(("1", "반"))
    if field == PERIOD and not any(g[1] for g in groups):
        for word in ("반년", "보름"):
            if word in t:
                return f"1@{word}"
    with_unit = [g for g in groups if g[1]]
    chosen = next((g for g in with_unit if g[0]), with_unit[0] if with_unit else None)
    if chosen is None:
        if not groups or note is None:
            return ""
        plain = next((g for g in groups if g[0]), groups[0])
        return f"{plain[2][0][0]}@{note}"
    terms = chosen[2]
    out = []
    for k, (number, alias) in enumerate(terms):
        if field == BUDGET and alias in SMALL and k + 1 < len(terms):
            nxt = next((a for _, a in terms[k + 1 :] if a in LARGE), None)
            alias += nxt or ""
        out.append(f"{number}@{alias}")
    return ";".join(out)


@F.pandas_udf(T.StringType())
def _terms(field: pd.Series, raw: pd.Series, heading: pd.Series, plain: pd.Series) -> pd.Series:
    out = []
    for f, r, h, p in zip(field, raw, heading, plain, strict=True):
        if r is None or f not in (BUDGET, PERIOD):
            out.append("")
        elif p:  # normalised side: money without a unit is won, nothing else is known
            out.append(scan(r, f, "원" if f == BUDGET else None))
        else:
            out.append(scan(r, f, unit_note(r, f) or unit_note(h, f)))
    return pd.Series(out)


def quantities(rows: DataFrame) -> DataFrame:
    """Both answers of every budget and period row in common units.

    In: ``row_id, field_name, answer_raw, answer_normalized,
    representative_location.heading``.  Out: ``row_id, field_name`` and, per
    side, ``raw_won, raw_months, raw_days, norm_won, norm_months, norm_days``
    (DECIMAL, null where the side states none).  Null, empty and unreadable
    answers give nulls; repeated rows are kept apart by ``row_id``; rows of
    other fields and extra columns are left out.
    """
    spark = rows.sparkSession
    wanted = rows.where(F.col("field_name").isin(BUDGET, PERIOD)).select("row_id", "field_name", "answer_raw", "answer_normalized", F.col("representative_location.heading").alias("heading"))
    scanned = wanted.select(
        "row_id",
        "field_name",
        _terms("field_name", "answer_raw", "heading", F.lit(False)).alias("raw"),
        _terms("field_name", "answer_normalized", "heading", F.lit(True)).alias("norm"),
    )
    term = scanned.select("row_id", "field_name", F.explode(F.array(F.struct(F.lit("raw").alias("side"), F.col("raw").alias("terms")), F.struct(F.lit("norm").alias("side"), F.col("norm").alias("terms")))).alias("s")).select(
        "row_id", "field_name", "s.side", F.explode_outer(F.split("s.terms", ";")).alias("term")
    )
    term = term.select("row_id", "field_name", "side", F.expr("try_cast(split_part(term, '@', 1) as decimal(24,6))").alias("coef"), F.split_part("term", F.lit("@"), F.lit(2)).alias("alias"))
    priced = term.join(F.broadcast(conversion_factors(spark)), ["field_name", "alias"], "left").withColumn("value", F.expr("coef * cast(factor as decimal(16,0))"))
    sums = [F.sum(F.when((F.col("side") == s) & (F.col("dimension") == d), F.col("value"))).alias(f"{s}_{d}") for s in ("raw", "norm") for d in ("won", "months", "days")]
    return priced.groupBy("row_id", "field_name").agg(*sums)


def disagreeing(rows: DataFrame) -> DataFrame:
    """``row_id`` of rows whose two answers, both present, state different quantities.

    Months and days are not compared with each other: a period counts only if
    both answers use the same of them.
    """
    q = quantities(rows.where(F.col("answer_raw").isNotNull() & F.col("answer_normalized").isNotNull()))
    won = F.col("raw_won") != F.col("norm_won")
    same = F.col("raw_months").isNull().eqNullSafe(F.col("norm_months").isNull()) & F.col("raw_days").isNull().eqNullSafe(F.col("norm_days").isNull())
    zero = F.lit(0)
    span = same & ((F.coalesce("raw_months", zero) != F.coalesce("norm_months", zero)) | (F.coalesce("raw_days", zero) != F.coalesce("norm_days", zero)))
    return q.where(F.when(F.col("field_name") == BUDGET, won).otherwise(span)).select("row_id")
