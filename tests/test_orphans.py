import random
from datetime import datetime, timedelta

from conftest import rows

from jangbu.operators import orphans

ELOC = "struct<document:string,section:string,ref_no:string,line:int>"
ITEMS = f"item_key long, document_id string, location {ELOC}, evidence array<struct<kind:string,location:{ELOC}>>, created_at timestamp_ntz, period string, bit int"
MEMORY = "memory_key long, approved_plan struct<document_ids:array<string>>, reviewed_at timestamp_ntz, at string"
REGISTRY = "document_id string, registered_at timestamp_ntz, deleted_at timestamp_ntz, held_from string"


def made(spark, seed):
    r = random.Random(seed)
    t0 = datetime(2023, 1, 1)
    when = lambda: t0 + timedelta(hours=r.randrange(24 * 400))
    ids = [f"RFP-{i}" for i in range(12)]
    spelled = lambda: r.choice([None, "", " ", "NO-1", *ids, f" {r.choice(ids).lower()}\t"])
    loc = lambda: r.choice([None, (spelled(), None, None, None)])
    registry = [(i, s, r.choice([None, s + timedelta(days=r.randrange(200))]), "x") for i in ids[:9] for _ in range(2) for s in [when()]] + [(None, t0, None, "x"), ("RFP-9", None, None, "x")]
    items = [(k, spelled(), loc(), r.choice([None, [], [("c", loc()), None]]), r.choice([None, when(), when(), when()]), "p", 1) for k in range(80)]
    memory = [(k, r.choice([None, (None,), ([],), ([spelled(), None, "RFP-1", "RFP-1"],)]), when(), "a") for k in range(40)]
    return registry, items, memory


def brute(registry, items, memory):
    refs = set()
    for key, doc, loc, ev, at, *_ in items:
        refs |= {("evaluation_items", key, "document_id", doc, at), ("evaluation_items", key, "location.document", loc and loc[0], at)}
        refs |= {("evaluation_items", key, "evidence.location.document", e[1][0], at) for e in ev or [] if e and e[1]}
    for key, plan, at, _ in memory:
        refs |= {("approved_memory", key, "approved_plan.document_ids", d, at) for d in (plan and plan[0]) or []}
    refs = {(a, b, c, d.strip().upper(), t) for a, b, c, d, t in refs if d and d.strip()}
    held = lambda d, t: t is not None and any(i and i.strip().upper() == d and s and s <= t and (e is None or t < e) for i, s, e, _ in registry)
    return sorted(((d, c, b, a) for a, b, c, d, t in refs if not held(d, t)), key=repr)


def test_against_brute_force(spark):
    for seed in range(2):
        registry, items, memory = made(spark, seed)
        got = orphans.dangling(spark.createDataFrame(items, ITEMS), spark.createDataFrame(memory, MEMORY), spark.createDataFrame(registry, REGISTRY))
        assert rows(got.select("document_id", "field_name", "row_key", "source_table")) == brute(registry, items, memory)


def test_empty_tables(spark):
    e, m, r = (spark.createDataFrame([], s) for s in (ITEMS, MEMORY, REGISTRY))
    assert orphans.dangling(e, m, r).count() == 0
    item = spark.createDataFrame([(1, "a", None, None, datetime(2024, 1, 5), "", 0)], ITEMS)
    assert rows(orphans.report(orphans.dangling(item, m, r))) == [("document_id", 1, 1, "2024-01", "evaluation_items")]


def test_dictionary_numbers_are_dense_within_ranges(spark):
    d = orphans.dictionary(spark.range(5000).selectExpr("cast(id as string) as document_id")).collect()
    assert len({(r.key_range, r.bit) for r in d}) == 5000 and all(0 <= r.bit < orphans.BITS for r in d)
