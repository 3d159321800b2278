"""Amounts written in digits, Korean numerals and units: one grammar of terms, read under two policies.

A text is cut into numbers, numerals, units and anything else.  Numbers and units
in a row are an expression; its value adds up section by section, a section being
what stands before one of the great units.  Queries take what they find
(``query_amount``), grading takes only texts that state an amount and nothing
else (``graded_amount``).
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from decimal import Decimal

from jangbu.functions.arrow import vectorised

# Numerals, units, and words beside an amount that do not change it.
NUMERALS = {c: i for i, c in enumerate("영일이삼사오육칠팔구")}
SMALL = {"십": 10, "백": 100, "천": 1000}
GREAT = {"만": 10**4, "억": 10**8, "조": 10**12}
CONDITIONS = ("이내", "이상", "이하", "초과", "미만")
FOREIGN = ("달러", "USD", "US$", "$", "유로", "EUR", "€", "엔화", "엔", "JPY", "¥", "위안", "CNY", "파운드", "GBP", "£")
_TOKEN = re.compile(r"(?P<number>\d[\d,]*(?:\.\d+)?)|(?P<numeral>[영일이삼사오육칠팔구])|(?P<unit>[십백천만억조])|(?P<won>[원₩￦금정]|KRW)|(?P<blank>\s+)|(?P<other>.)", re.S)
_REMARK = re.compile(r"\([^()]*\)")
_BESIDE = re.compile(r"이내|이상|이하|초과|미만|VAT|부가(?:가치)?세|포함|별도|약|총", re.I)


@dataclass
class Expression:
    """Numbers and units that stand together: where, what kinds of tokens, and the value."""

    start: int
    end: int
    value: Decimal
    units: bool
    digits: int  # most digits of the integer part of a number in it
    numerals: bool


def expressions(text: str, numerals: bool = False) -> list[Expression]:
    """Amount expressions of a text in order; Korean numerals count only where asked for."""
    out: list[Expression] = []
    total = section = Decimal(0)
    pending: Decimal | None = None
    digits, units, spelled, start, end = 0, False, False, -1, -1

    def close() -> None:
        nonlocal total, section, pending, digits, units, spelled, start
        if start >= 0 and (units or pending is not None):
            out.append(Expression(start, end, total + section + (pending or 0), units, digits, spelled))
        total = section = Decimal(0)
        pending, digits, units, spelled, start = None, 0, False, False, -1

    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m[0]
        if kind == "number":
            if pending is not None:
                close()
            pending = Decimal(s.replace(",", ""))
            digits = max(digits, len(s.replace(",", "").split(".")[0]))
        elif kind == "numeral" and numerals:
            pending, spelled = (pending or 0) * 10 + NUMERALS[s], True
        elif kind == "unit" and (start >= 0 or numerals):
            units = True
            if s in SMALL:
                section += (1 if pending is None else pending) * SMALL[s]
            else:
                total += ((section + (pending or 0)) or 1) * GREAT[s]
                section = Decimal(0)
            pending = None
        elif kind == "blank" and start >= 0 and units:
            continue
        else:
            close()
            continue
        start, end = (m.start() if start < 0 else start), m.end()
    close()
    return out


def query_amount(text: str | None) -> float | None:
    """Won in a text, for queries: the first expression with a unit, else the number of most digits; remarks in brackets do not count.  None without a number."""
    if not text:
        return None
    found = expressions(_REMARK.sub(" ", text))
    if not found:
        return None
    return float(next((e for e in found if e.units), max(found, key=lambda e: e.digits)).value)


def graded_amount(text: str | None) -> int | None:
    """Won a text states and nothing else, for grading; None as soon as another word stands in it."""
    if not text:
        return None
    t = re.sub(r"[\s,원금정₩￦]", "", _BESIDE.sub("", _REMARK.sub("", text)))
    found = expressions(t, numerals=True)
    if len(found) != 1 or (found[0].start, found[0].end) != (0, len(t)) or not (found[0].units or found[0].digits or found[0].numerals):
        return None
    return int(found[0].value.to_integral_value())


def stated_amounts(text: str | None) -> list[tuple[int, str, bool]]:
    """Amounts of money in a text with where they are said and whether in a foreign currency: digits followed by a currency, or by units."""
    t = unicodedata.normalize("NFKC", text or "")
    out = []
    for e in expressions(t):
        after, before = t[e.end :].lstrip(), t[max(0, e.start - 4) : e.start].rstrip()
        foreign = any(after.upper().startswith(f) for f in FOREIGN) or any(before.upper().endswith(f) for f in FOREIGN)
        if foreign or after.startswith(("원", "KRW")) or before.endswith(("₩", "금")):
            out.append((int(e.value.to_integral_value()), t[e.start : e.end], foreign))
    return out


def conditions(text: str | None) -> frozenset[str]:
    """What bounds an amount: 이내, 이상, 이하, 초과, 미만, and tax that is included or comes on top."""
    t = unicodedata.normalize("NFKC", text or "").lower()
    tax = r"(?:부가\s*가?\s*치?\s*세|vat|세액|세금)\s*"
    return frozenset([c for c in CONDITIONS if c in t] + [f"vat_{name}" for name, word in (("included", "포함"), ("excluded", "별도")) if re.search(tax + word, t)])


@vectorised("double")
def query_amount_udf(s: str) -> float | None:
    return query_amount(s)


@vectorised("long")
def graded_amount_udf(s: str) -> int | None:
    return graded_amount(s)


@vectorised("struct<amounts:array<long>,krw:long,foreign:boolean,conditions:array<string>>")
def budget(text: str) -> tuple:
    """A budget in parts: the amounts stated, the won it comes to where exactly one is stated, whether a foreign currency is named, and its conditions."""
    said = stated_amounts(text)
    home = list(dict.fromkeys(v for v, _, foreign in said if not foreign))
    return home, home[0] if len(home) == 1 else None, any(f for *_, f in said), sorted(conditions(text))
