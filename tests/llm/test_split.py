import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jangbu.llm import split

TEXT = st.lists(st.sampled_from([*"가나 .\n|다é", "́", "\r\n", "</tr>", "## ", "다. ", "‍"]), max_size=900).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(5, 120), st.integers(0, 200))
def test_round_trip(text, limit, overlap):
    ps = split.pieces(text, limit, overlap)
    o = min(overlap, limit - 1)
    assert all(b - a <= limit for a, b in ps)
    assert text[: ps[0][1]] + "".join(text[a + o : b] for a, b in ps[1:]) == text
    assert all(c == b - o for (_, b), (c, _) in zip(ps, ps[1:], strict=False))


def test_natural_boundaries():
    text = "\n\n".join(f"문단 {i} " + "말 " * 20 for i in range(8))
    assert all(text[:b].endswith("\n\n") for _, b in split.pieces(text, 120, 0)[:-1])
    table = "<table>" + "".join(f"<tr><td>{i}</td><td>{'x' * 30}</td></tr>" for i in range(20)) + "</table>"
    assert all(table[:b].endswith("</tr>") for _, b in split.pieces(table, 200, 0)[:-1])
    prose = "문장이 끝났다. " * 60
    assert all(prose[:b].endswith("다. ") for _, b in split.pieces(prose, 100, 0)[:-1])


def test_operator(spark):
    schema = "chunk_key long, source_document_title string, section_path array<string>, chunking_version string, text string, limit int, part int"
    data = [(1, "t" * 10, ["s", None], "c", "x " * 500, 0, 0), (2, None, None, "c", "", 0, 0), (3, "t", [], "c", None, 0, 0), (4, "t", [], "none", "x" * 999, 0, 0), (5, None, [], "c", "y" * 299, 0, 0), (6, None, [], "c", "y" * 300, 0, 0), (7, None, [], "c", "y" * 300, 0, 0), (8, None, [], None, "y", 0, 0), (9, "t" * 500, None, "c", "z" * 201, 0, 0)]
    chunks = spark.createDataFrame(data, schema)
    tags = spark.createDataFrame([("c", 300, 30, "x"), ("d", None, 5, "x")], "chunking_version string, chunk_size int, chunk_overlap int, text string")
    assert sorted(r.chunk_key for r in split.oversize(chunks, tags).collect()) == [1, 6, 7, 9]
    got = {}
    for r in split.split(chunks, tags).orderBy("chunk_key", "part").collect():
        got.setdefault(r.chunk_key, []).append(r)
    assert sorted(got) == [1, 2, 5, 6, 7, 9] and got[2][0].text == ""
    for k, rs in got.items():
        assert [r.part for r in rs] == list(range(1, rs[0].of + 1))
        assert rs[0].text + "".join(r.text[30:] for r in rs[1:]) == next(d[4] for d in data if d[0] == k)
    assert split.split(chunks.limit(0), tags).count() == 0


def _strings(text, limit, overlap):
    return [text[a:b] for a, b in split.pieces(text, limit, overlap)]


def test_first_part_shorter_than_the_overlap():
    text = "가" * 49 + "\n\n" + "나" * 108 + "\n\n" + "다" * 100
    got = _strings(text, 200, 80)
    assert all(0 < len(p) <= 200 for p in got)
    assert got[0] + "".join(p[80:] for p in got[1:]) == text
    assert all(p[-80:] == q[:80] for p, q in zip(got, got[1:], strict=False))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(5, 120), st.integers(0, 119))
def test_strings_hold_the_whole_text(text, limit, overlap):
    got, o = _strings(text, limit, overlap), split.shared(limit, overlap)
    assert got[0] + "".join(p[o:] for p in got[1:]) == text
    assert all(len(p) > o for p in got[:-1]) and all(p[len(p) - o :] == q[:o] for p, q in zip(got, got[1:], strict=False))
    assert len(text) <= limit or all(got)


def test_sections_stay_below_their_heading():
    part = lambda name, n: f"## {name}\n\n" + "글자 " * n + "\n\n"
    text = "# 첫째\n\n" + part("가나", 20) + part("다라", 20) + "# 둘째\n\n" + part("마바", 20) + part("사아", 20)
    got = _strings(text, 170, 0)
    assert [p.split("\n", 1)[0] for p in got] == ["# 첫째", "# 둘째"]
    # a heading is never the last thing in a piece
    assert not any(p.rstrip().rsplit("\n", 1)[-1].startswith("#") for p in _strings(text, 100, 0))


def test_most_cuts_are_natural():
    import random

    r = random.Random(5)
    text = "\n\n".join(" ".join("낱말" * r.randint(1, 4) for _ in range(r.randint(5, 40))) + "." for _ in range(60))
    ends = [b for _, b in split.pieces(text, 300, 30)[:-1]]
    assert sum(text[:b].endswith("\n\n") for b in ends) >= 0.8 * len(ends)
