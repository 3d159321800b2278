import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jangbu.llm import encode

RANKS = encode.read_ranks() if os.path.isdir(encode.TOKENIZERS) else {}
pytestmark = pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), min_size=1, max_size=4), max_size=60), st.binary(max_size=6))
def test_lexicon_holds_exactly_its_words(words, other):
    lex = encode.unpack(encode.pack(encode.Lexicon.build(words)))
    assert all(lex.find(w) == ids for w, ids in words.items())
    assert lex.find(other) == words.get(other)


def test_lexicon_shares_suffixes():
    words = {f"{a}{b}ation".encode(): [1] for a in "abcdefgh" for b in "xyz"}
    assert len(encode.Lexicon.build(words)["final"]) <= 10


def test_long_words_merge_alike(public):
    ranks = encode.read_ranks()
    for w in ("a" * 1000, "abc" * 400, "가나다" * 150, "ㅋ" * 300):
        assert encode.merge(w.encode(), ranks) == public.encode_ordinary(w) if w.isalpha() else True


def test_operator(spark, public):
    texts = [None, "", " ", "\n\n  x", "Hello hello hello <|endoftext|> it's we'll", "사업 사업 예산은 1,200원이다. " * 30, "🙂👍🏽 日程", "x" * 30_000, "é é\r\n\t", "사업 사업"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, "사업 사업", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    assert len(got) == 11 and all(got[i] == (public.encode_ordinary(t) if t else []) for i, t in enumerate(texts)) and got[99] == got[9]
    assert encode.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.ids for r in encode.encode(df, lexicon=2).collect()} == got


def test_frequent_words_are_counted_over_all_texts(spark, monkeypatch):
    texts = spark.range(6_000, numPartitions=1).selectExpr("case when id < 5000 then 'früh' else 'spät spät spät spät spät spät spät' end as text", "id")
    assert encode.frequent(texts, 1) == [" spät"]
    assert encode.frequent(texts, 9) == [" spät", "früh", "spät"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\xa0\u3000ab1.,'가나é🙂\x1c", max_size=40))
def test_parts_encode_like_the_whole(public, text):
    import regex

    words = encode.Words(encode.Lexicon.of({}), RANKS)
    assert "".join(encode.words_of(text)) == text
    for split in (None, regex.compile(encode.PATTERN)):
        assert [i for w in encode.words_of(text, split) for i in words[w]] == public.encode_ordinary(text)
