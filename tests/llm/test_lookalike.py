import unicodedata

import pytest
from conftest import rows

from jangbu.llm import lookalike
from jangbu.llm.lookalike import SpellingTrie, by_table


@pytest.mark.parametrize(("a", "b", "same"), [
    ("RFР 1차.hwр", "RFP 1차.hwp", True), ("공고문．ｈｗｐｘ", "공고문.hwpx", True), ("ΙSР", "ISP", True), ("Réѕumé", "Résumé", True), (unicodedata.normalize("NFD", "한글 Café"), "한글 Café", True), ("a‑b−c‐d", "a-b-c-d", True),
    ("a　b c d", "a b c d", True), ("﻿a​b­.md ", "ab.md", True), ("Resume", "Résumé", False), ("가 나", "가나", False), ("v1", "v2", False), ("가_나", "가 나", False), ("시스템", "시스뎀", False), ("", "", True),
])
def test_look(a, b, same):
    assert (by_table(a) == by_table(b)) == same
    trie = SpellingTrie([t for t in b.split() if t])
    assert (lookalike.canonical(a, trie) == lookalike.canonical(b, trie)) == same


def test_automaton_costs():
    trie = SpellingTrie(["보안관제", "보안관리", "RFP"])
    assert trie.walk("RFР") == "RFP" and trie.walk("보안​관제") == "보안관제"
    assert trie.walk("보안관") is None and trie.walk("RF") is None and trie.walk("RFP", 1) == "RFP"
    assert trie.walk("RF", 1) == "RFP" and trie.walk("RFFP", 1) == "RFP" and trie.walk("RXP", 1) == "RFP" and trie.walk("XXP", 1) is None


def test_operator(spark):
    registry = spark.createDataFrame([("d1", "가 RFP.hwp", "x"), ("d1", "가 RFP.hwp", "x"), ("d2", None, "x"), (None, "n", "x"), ("d3", "b.md", "x")], "document_id string, output_filename string, registered string")
    records = spark.createDataFrame([(1, 1, "d1", "가 RFР.hwp"), (2, 1, "d1", "가 RFP.hwp"), (3, 1, "d1", "가RFP.hwp"), (4, 2, "d1", "가 RFP.ｈｗｐ"), (5, 2, "d2", "x"), (6, 2, None, "n"), (7, 2, "d3", None), (8, 2, "d3", ""), (9, 2, "d3", "b" * 40_000)], "record_id long, batch_no long, document_id string, source_filename_nfc string")
    assert rows(lookalike.mismatches(records, registry)) == [(1, 1), (2, 4)]
    manifest = spark.createDataFrame([(1, 0), (2, None), (3, 7)], "batch_no long, filename_normalization_mismatches int")
    assert rows(lookalike.manifest(records, registry, manifest)) == sorted([(1, 1, 0), (2, 1, None), (3, 0, 7)], key=repr)
    assert lookalike.mismatches(records.limit(0), registry.limit(0)).count() == 0


def test_spelling_decides_where_the_table_cannot():
    trie = SpellingTrie(["1단계", "2024", "Internal"])
    assert lookalike.canonical("l단계 2O24 lnternaI", trie) == "1단계 2024 Internal"
    assert by_table("l단계") == "l단계" and lookalike.canonical("l단계", SpellingTrie(["3단계"])) == "l단계"
    assert lookalike.canonical("l단계", SpellingTrie(["l단계", "1단계"])) == "l단계"  # a spelling of its own


def test_automaton_against_plain_edit_distance():
    import random

    def distance(a, b):
        row = [float(j) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [float(i)]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + lookalike._move(y, x), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    r = random.Random(3)
    word = lambda: "".join(r.choice("ab1l") for _ in range(r.randint(1, 5)))
    for _ in range(300):
        words, token = list(dict.fromkeys(word() for _ in range(4))), word()
        least = min(distance(token, w) for w in words)
        near = SpellingTrie(words).nearest(token, 2)
        assert (near is None) == (least > 2) and (near is None or abs(near[1] - least) < 1e-9 and abs(distance(token, near[0]) - least) < 1e-9)


def test_visible_edits(spark):
    registry = spark.createDataFrame([("d", "가나 RFP 1차.hwp")], "document_id string, output_filename string")
    names = ["가나 RFP 1차.hwp", "가나 RFР l차.hwp", "가나 RFPs 1차.hwp", "다른 이름", None, ""]
    records = spark.createDataFrame([(i, 1, "d", n) for i, n in enumerate(names)], "record_id long, batch_no long, document_id string, source_filename_nfc string")
    got = {r.record_id: (r.source_form == r.registered_form, r.visible_edits) for r in lookalike.forms(records, registry).collect()}
    assert got == {0: (True, 0.0), 1: (True, 0.0), 2: (False, 1.0), 3: (False, None), 5: (False, 0.0)}
