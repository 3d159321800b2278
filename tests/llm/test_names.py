import random

import numpy as np
import pytest
from conftest import rows

from jangbu.llm import names

ORGS = [(1, "가온시 도시철도공사", "Gaon Metro Corporation", "도시철도공사", "가온시"), (2, "재단법인 다솔도 테크노파크", "Dasol Technopark", "테크노파크", "다솔도"), (3, "잔디광역시 환경관리공단", "Jandi Environment Agency", "환경관리공단", "잔디광역시"), (4, "너울도 대학교 산학협력단", "Neoul University Industry Foundation", "대학교 산학협력단", "너울도")]


@pytest.mark.parametrize(("typed", "org"), [("가온 시 도시철도공사", 1), ("도시철도공사, 가온시", 1), ("가온시도시철도공사 총무과", 1), ("가온시 도시철도공사장", 1), ("㈶다솔도 테쿠노파크", 2), ("(재)다솔도TP", 2), ("잔디시 환경관리공단", 3), ("잔디광역시 환경관리단공", 3), ("The Jandi Environment Agency", 3), ("너울도 대학교 산단", 4), ("잔디광역시 도시철도공사", None), ("다솔도 환경관리공단", None), ("체육회", None), ("", None), ("가", None)])
def test_organisations(typed, org):
    assert names.Organisations(ORGS).meant(typed) == org


@pytest.mark.parametrize(("name", "key"), [("2024년 루코디저더미 연구성과시스템 구축 용역", ("2024", "", "루코디저더미연구성과시스템구축")), ("(재공고) '24년 「루코디저더미」 연구성과 구축(2단계) 위탁용역", ("2024", "2", "루코디저더미연구성과구축")), ("<재입찰> 루코디-저더미 연구성과 구축 Ⅱ단계, (2024)", ("2024", "2", "루코디저더미연구성과구축")), ("2024년도 제1단계 사업", ("2024", "1", "사업"))])
def test_project_keys(name, key):
    assert names.project_key(name) == key


def test_average_linkage_against_one_merge_at_a_time(spark):
    r = random.Random(2)
    n = {i: r.randint(1, 4) for i in range(24)}
    sim = {(a, b): r.random() for a in n for b in n if a < b and r.random() < 0.4}
    clusters = {i: [i] for i in n}
    while True:
        mean = lambda x, y: sum(sim.get((min(p, q), max(p, q)), 0) * n[p] * n[q] for p in clusters[x] for q in clusters[y]) / (sum(n[p] for p in clusters[x]) * sum(n[q] for q in clusters[y]))  # noqa: B023, E731
        best = max(((mean(x, y), x, y) for x in clusters for y in clusters if x < y), default=(0, 0, 0))
        if best[0] < 0.5:
            break
        clusters[best[1]] += clusters.pop(best[2])
    want = sorted(sorted(c) for c in clusters.values())
    got = {}
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a long, b long, similarity double")
    for x in names.average_linkage(edges, spark.createDataFrame(list(n.items()), "node long, n long"), 0.5).collect():
        got.setdefault(x.cluster, []).append(x.node)
    assert sorted(sorted(c) for c in got.values()) == want
    lone = names.average_linkage(edges.limit(0), spark.createDataFrame([(1, 1)], "node long, n long"))
    assert rows(lone) == [(1, 1)]


def test_links(spark):
    schema = "record_id long, document_id string, buyer_org string, project_name string, linked_id long, core string"
    data = [
        (1, "a", "가온시 도시철도공사", "2024년 루코디저더미 연구성과시스템 구축 용역", 0, ""), (2, "b", "가온 시 도시철도공사", "'24년 「루코디저더미」 연구성과 구축 위탁용역", 0, ""), (3, "c", "", "2023년 루코디저더미 연구성과시스템 구축 용역", 0, ""),
        (4, "d", None, "2024년 루코디저더미 연구성과시스템 구축 2단계 용역", 0, ""), (5, "e", "없는 기관", "2024년 나버지다저루 홈페이지플랫폼 유지관리 용역", 0, ""), (6, "b", "도시철도공사(가온시)", "2024 루코디저더머 연구성과시스템 구축", 0, ""),
        (7, "a", None, None, 0, ""), (8, None, None, "2024 루코디저더미 연구성과시스템 구축", 0, ""), (9, "g", "가온시 도시철도공사", "2024년 루코디저더미 연구성과시스템 구축 용역", 0, ""), (10, "h", "x" * 5_000, "!!!", 0, ""),
    ]
    orgs = spark.createDataFrame(ORGS, "org_id long, official_name string, english_name string, org_type string, region string")
    got = {tuple(x) for x in names.links(spark.createDataFrame(data, schema), orgs).select("field_name", "record_id", "linked_id").collect()}
    assert got == {("buyer_org", 2, 1), ("buyer_org", 6, 1), ("project_name", 1, 2), ("project_name", 1, 6), ("project_name", 2, 9), ("project_name", 6, 9)}
    assert names.links(spark.createDataFrame([], schema), orgs.limit(0)).count() == 0


def test_many_spellings_of_one_project_leave_its_name_its_own(spark):
    r = random.Random(7)
    made_up = lambda: "".join(r.choice("가나다라마바사자카타파하거너더러머버서저") for _ in range(7))
    topics, systems, actions = ("연구성과", "교통정보", "예산회계", "전자도서관"), ("시스템", "플랫폼", "데이터베이스"), ("구축", "유지관리", "기능개선")
    others = [f"{made_up()}{r.choice(topics)}{r.choice(systems)}{r.choice(actions)}" for _ in range(400)]
    own, tail = "쿠호묘쳐푸휴뇨", "연구성과플랫폼구축"
    hot = {own + tail}
    while len(hot) < 300:
        k = r.randrange(len(own + tail))
        x = own + tail
        hot.add(x[:k] + chr(r.randrange(0xAC00, 0xD7A4)) + x[k + r.choice((0, 1)) :])
    core = {x.project_name: x.core for x in names.project_names(spark.createDataFrame([(x,) for x in [*others, *hot]], "project_name string"), frozenset()).collect()}
    assert core[own + tail] == own
    assert all(core[x].startswith(own) and len(core[x]) <= 9 for x in hot if x.startswith(own))
    spelt_wrong = [x for x in hot if not x.startswith(own)]
    assert len(spelt_wrong) > 100
    # all of the name is compared, not the stretch around the error
    assert all(5 <= len(core[x]) <= 8 and x.startswith(core[x]) for x in spelt_wrong)
    # and other names lose their ordinary wording as before
    assert sum(core[x] == x[:7] for x in others) > 0.9 * len(others)


def test_classes_count_the_links(spark):
    texts = ["2023년 가나다라 재난관제 사업", "2023 가나다라 재난관제 사업", "2023년 가나다라 재난관제", "2024년 가나다라 재난관제 사업", "2023년 마바사아 도서관 사업", " ", None]
    data = [(i, None if i == 20 else f"d{i % 5}", texts[i % 7]) for i in range(24)]
    df = spark.createDataFrame(data, "record_id long, document_id string, project_name string")
    pairs = names.project_links(df).collect()
    n = {}
    for a, b in pairs:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    got = {r.record_id: r.n_links for r in names.project_classes(df).collect()}
    assert got == {k: n.get(k, 0) for k, d, t in data if d and t and t.strip()} and sum(got.values()) == 2 * len(pairs) > 0
    assert names.project_classes(df.limit(0)).count() == 0


def test_similar_cores_are_all_pairs_whatever_the_blocks(spark, monkeypatch):
    from collections import Counter
    from math import log, sqrt

    r = random.Random(5)
    syllables = "가나다라마바사자카타파하거너더"
    base = ["".join(r.choice(syllables) for _ in range(r.choice((2, 5, 6, 7, 8)))) for _ in range(40)]
    cores = {(y, p, b if r.random() < 0.3 else b[:k] + r.choice(syllables + "1a") + b[k + r.choice((0, 1)) :]) for y in ("2023", "") for p in ("", "2") for b in base for k in (r.randrange(len(b)), r.randrange(len(b)))} | {("2023", "", "가"), ("2023", "", "가나다라마바사아" * 3)}
    data = [(i * 7919 - 400_000, *c) for i, c in enumerate(sorted(cores))]
    df = Counter(g for *_, c in data for g in names.grams(c))
    vector = {i: {g: log(1 + len(data) / df[g]) for g in names.grams(c)} for i, _, _, c in data}
    norm = {i: sqrt(sum(w * w for w in v.values())) for i, v in vector.items()}
    want = {}
    for a, ya, pa, ca in data:
        for b, yb, pb, cb in data:
            if a < b and (ya, pa) == (yb, pb):
                cosine = sum(w * vector[b].get(g, 0) for g, w in vector[a].items()) / norm[a] / norm[b]
                similarity = (1 - names._apart(*sorted((ca, cb), key=len)) / names.APART + cosine) / 2
                if cosine >= names.COSINE and similarity > 0:
                    want[a, b] = similarity
    nodes = spark.createDataFrame(data, "node long, year string, phase string, core string")
    for block in (30_000, 17):
        monkeypatch.setattr(names, "BLOCK", block)
        near = names.similar_cores(nodes)
        got = {(x.a, x.b): x.similarity for x in near.collect()}
        assert got.keys() == want.keys() and len(want) > 100
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
        # the pairs are no rows of any shuffle
        assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]
    assert names.similar_cores(nodes.limit(0)).count() == 0

    gram = sorted(df, key=lambda g: names.packed_grams([g])[1][0])
    packed, weight = (np.array(x) for x in ([names.packed_grams([g])[1][0] for g in gram], [log(1 + len(data) / df[g]) for g in gram]))
    cores = [c for *_, c in data]
    for first in (len(cores), 30):
        parts = []
        for at_once in (2_000_000, 50):
            monkeypatch.setattr(names, "AT_ONCE", at_once)
            parts.append([(i, j) for a, b, _ in names.close_rows(cores, first, packed, weight) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        assert parts[0] == parts[1] and len(parts[0]) > 20 and all(i < j and i < first and (j >= first or first == len(cores)) for i, j in parts[0])


def test_costs_worked_out_together():
    r = random.Random(3)
    made_up = lambda: "".join(r.choice("가각간나난다1a") for _ in range(r.choice((1, 4, 5, 6, 7))))
    pairs = [(made_up(), made_up()) for _ in range(3_000)]
    assert names.apart_many(*map(list, zip(*pairs, strict=True))).tolist() == [names._apart(*sorted(p, key=len)) for p in pairs]
