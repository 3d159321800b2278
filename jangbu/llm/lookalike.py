"""Visually identical text brought to one form.

Tokens of a text walk a trie of known spellings under a weighted edit automaton
whose zero-cost moves are look-alike letters and characters nobody sees; a token
that arrives at a spelling takes it.  Characters of one script that are taken for
each other (l, I and 1) cost next to nothing there, where a table could not tell
which is meant.  Every other token is normalised by the table of classes.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("аАВеЕіІјЈКкМНоОрРсСТуУхХѕЅԁһԛԝӏӀԌԚԜҺ", "aABeEiIjJKkMHoOpPcCTyYxXsSdhqwlIGQWH", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρυχκϲϳϹͿ", "ABEZHIKMNOPTYXoviapuxkcjCJ", strict=True))
OTHERS = dict(zip("օսոհցՕՏԼɑɡıℓᴀᴄᴏᴠᴡᴢꓐꓚꓓꓰꓗꓡꓟꓠꓳꓑꓢꓔꓦꓪꓫꓬꓮ", "ounhgOSLagilacovwzBCDEKLMNOPSTVWXYA", strict=True))
LETTERS = CYRILLIC | GREEK | OTHERS
HYPHENS = "‐‑‒–—―−﹣－⁃➖⸺"
DOTS = "․．"
UNSEEN = "͏ᅟᅠㅤﾠ᠎"


@lru_cache(maxsize=65_536)
def look(ch: str) -> str:
    """The class of one decomposed character: what a reader takes it for; empty if it is not seen."""
    if ch in LETTERS:
        return LETTERS[ch]
    if ch.isascii() and ch.isprintable():
        return ch
    if ch in HYPHENS:
        return "-"
    if ch in DOTS:
        return "."
    kind = unicodedata.category(ch)
    if ch in "\t\n\r" or kind in ("Zs", "Zl", "Zp"):
        return " "
    o = ord(ch)
    if kind in ("Cf", "Cc") or ch in UNSEEN or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return ""
    if 0xFF01 <= o <= 0xFFEE or 0x1D400 <= o <= 0x1D7FF or 0x2100 <= o <= 0x214F or 0x2160 <= o <= 0x217F:  # widths, styled letters, numerals
        return "".join(look(c) for c in unicodedata.normalize("NFKD", ch) if c != ch)
    return ch


_PLAIN = re.compile(r"[ -~가-힣]*")


def by_table(text: str) -> str:
    """Every character by its class, accents kept and composed, blanks single, none at the ends."""
    if _PLAIN.fullmatch(text):  # characters that are their own class
        return " ".join(filter(None, text.split(" ")))
    folded = "".join(map(look, unicodedata.normalize("NFD", text)))
    return re.sub(" +", " ", unicodedata.normalize("NFC", folded)).strip()


# Characters of one script that are taken for each other; which one is meant only a known spelling can tell.
CONFUSED = ("l", "I", "1", "|"), ("O", "0")
#: Costs of moves in the automaton: look-alikes and unseen characters 0, confused characters ``NEAR``, any other edit 1.
NEAR = 0.05
_GROUP = {c: k for k, group in enumerate(CONFUSED) for c in group}


class SpellingTrie:
    """Known spellings, walked by a weighted edit automaton.

    ``nearest(token, most)`` gives the spelling of the cheapest path of at most
    ``most`` and its cost, ties to the spelling added first; None if there is
    none.  ``walk`` gives the spelling alone.
    """

    def __init__(self, spellings: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.spelling: list[str | None] = [None]
        for s in spellings:
            at = 0
            for c in unicodedata.normalize("NFD", s):
                for k in look(c):
                    if k not in self.next[at]:
                        self.next[at][k] = len(self.next)
                        self.next.append({})
                        self.spelling.append(None)
                    at = self.next[at][k]
            if self.spelling[at] is None:
                self.spelling[at] = s

    def walk(self, token: str, most: float = 0) -> str | None:
        found = self.nearest(token, most)
        return found and found[0]

    def nearest(self, token: str, most: float = 0) -> tuple[str, float] | None:
        states = self._inserted({0: 0.0}, most)
        for c in unicodedata.normalize("NFD", token):
            for k in look(c):
                new: dict[int, float] = {}
                for at, cost in states.items():
                    for label, to in self.next[at].items():
                        _least(new, to, cost + _move(label, k), most)
                    _least(new, at, cost + 1, most)
                states = self._inserted(new, most)
                if not states:
                    return None
        ends = [(cost, at) for at, cost in states.items() if self.spelling[at] is not None]
        return (self.spelling[min(ends)[1]], min(ends)[0]) if ends else None

    def _inserted(self, states: dict[int, float], most: float) -> dict[int, float]:
        queue = [x for x in states.items() if x[1] + 1 <= most]
        for at, cost in queue:
            for to in self.next[at].values():
                if cost + 1 <= most and cost + 1 < states.get(to, most + 1):
                    states[to] = cost + 1
                    queue.append((to, cost + 1))
        return states


def _move(label: str, k: str) -> float:
    if label == k:
        return 0.0
    return NEAR if label in _GROUP and _GROUP[label] == _GROUP.get(k) else 1.0


def _least(states: dict[int, float], at: int, cost: float, most: float) -> None:
    if cost <= most and cost < states.get(at, most + 1):
        states[at] = cost


_BLANKS = re.compile(r"([\s ᠎\u2000-\u200a\u202f\u205f　_()（）＿]+)")


def canonical(text: str, trie: SpellingTrie) -> str:
    """``text`` with every token that looks like a known spelling in that spelling, confused characters included; the others, and what stands between, by the table."""
    out = []
    for k, part in enumerate(_BLANKS.split(text)):
        known = trie.walk(part, 1 - NEAR) if part and k % 2 == 0 else None
        out.append(known or part)
    return by_table("".join(out))


def visible_edits(text: str, trie: SpellingTrie, most: float) -> float | None:
    """Edits a reader can see between the tokens of ``text`` and the known spellings nearest to them; None where a token is more than ``most`` from any."""
    total = 0.0
    for part in _BLANKS.split(text)[::2]:
        if by_table(part):
            near = trie.nearest(part, most)
            if near is None:
                return None
            total += int(near[1])
    return total


#: Edits up to which a token is compared with a known spelling.
MOST_EDITS = 2.0


def _forms(edits: bool):
    """Forms of the source and of the registered name, and the visible edits where asked for; nulls for null."""

    @F.pandas_udf(T.StructType([T.StructField("source_form", T.StringType()), T.StructField("registered_form", T.StringType()), T.StructField("visible_edits", T.DoubleType())]))
    def forms_of(source: pd.Series, registered: pd.Series) -> pd.DataFrame:
        out = []
        for s, r in zip(source, registered, strict=True):
            if s is None or r is None:
                out.append((None, None, None))
                continue
            trie = SpellingTrie([t for t in _BLANKS.split(r)[::2] if t])
            form, own = canonical(s, trie), by_table(r)
            out.append((form, own, 0.0 if form == own else visible_edits(s, trie, MOST_EDITS) if edits else None))
        return pd.DataFrame(out, columns=["source_form", "registered_form", "visible_edits"])

    return forms_of.asNondeterministic()  # so that no filter on the result is pushed below it and runs it twice


def named(identity_records: DataFrame, registry: DataFrame) -> DataFrame:
    """``record_id, batch_no, source, registered`` of every record whose document the registry names; a row for each of several registered names."""
    clean = registry.where("document_id is not null and output_filename is not null").select("document_id", F.col("output_filename").alias("registered")).distinct()
    records = identity_records.where("document_id is not null and source_filename_nfc is not null").select("record_id", "batch_no", "document_id", F.col("source_filename_nfc").alias("source"))
    return records.join(clean, "document_id").select("record_id", "batch_no", "source", "registered")


def forms(identity_records: DataFrame, registry: DataFrame) -> DataFrame:
    """``record_id, batch_no, source, registered, source_form, registered_form, visible_edits`` of every record whose document the registry names.

    Records without document or file name, and documents the registry does not
    hold or gives no name, are left out; a document with several registered names
    gives a row per name.  The tokens of a document's registered name are the
    vocabulary its source names are walked through.  ``visible_edits`` is 0 where
    the names look the same, else the edits of the tokens against the nearest
    registered ones (0 also where only their order or number differs), null where
    one is over ``MOST_EDITS`` from all.  Equal names of plain characters do not reach Python.
    """
    both = named(identity_records, registry)
    plain = (F.col("source") == F.col("registered")) & F.col("source").rlike("^[!-~가-힣]+( [!-~가-힣]+)*$")
    f = both.withColumn("f", _forms(True)(F.when(~plain, F.col("source")), F.when(~plain, F.col("registered"))))
    own = lambda c, same: F.coalesce(F.col("f")[c], same).alias(c)
    return f.select("record_id", "batch_no", "source", "registered", own("source_form", F.col("source")), own("registered_form", F.col("registered")), F.when(F.col("f.source_form").isNull(), 0.0).otherwise(F.col("f.visible_edits")).alias("visible_edits"))


def mismatches(identity_records: DataFrame, registry: DataFrame) -> DataFrame:
    """``record_id, batch_no`` of records whose file name differs from the registered one and looks the same."""
    differing = named(identity_records, registry).where("source <> registered")
    f = differing.withColumn("f", _forms(False)("source", "registered"))
    return f.where("f.source_form = f.registered_form").select("record_id", "batch_no").distinct()


def manifest(identity_records: DataFrame, registry: DataFrame, data_manifest: DataFrame) -> DataFrame:
    """``batch_no, recorded, filename_normalization_mismatches``: the count each manifest batch should state, 0 if none."""
    n = mismatches(identity_records, registry).groupBy("batch_no").agg(F.count("*").alias("n"))
    return data_manifest.select("batch_no", F.col("filename_normalization_mismatches").alias("recorded")).join(n, "batch_no", "left").select("batch_no", "recorded", F.coalesce("n", F.lit(0)).alias("filename_normalization_mismatches"))
