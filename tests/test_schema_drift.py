import json
from datetime import datetime

from jangbu.operators import schema_drift

SCHEMA = "file_id long, producer string, run_no long, file_name string, raw_json string, delivered_at timestamp_ntz, n int, doc string"


def files(spark, texts):
    return spark.createDataFrame([(i, p, r, "f", t, datetime(2024, 1, 1, i % 24), 1, "d") for i, (p, r, t) in enumerate(texts)], SCHEMA)


def test_changes_and_table(spark):
    j = lambda **x: json.dumps(x, ensure_ascii=False)
    texts = [
        ("p", 1, j(generated_at="2024-01-01T00:00:00Z", row_count=5, corpus_dir="/a")),
        ("p", 2, "﻿" + j(generatedAt=1704067200, row_count=None, corpus_dir={"root": "/a", "name": "b"})),
        ("p", 3, '{"generatedAt": 17040'),  # cut off: no run
        ("p", 4, j(generatedAt=1704067200, row_count="1,234", meta={"note": "x"}, corpus_dir=["/a", "/b"])),
        ("p", 4, '{"cut": '),
        ("p", 5, j(generatedAt="2024-01-02", note="y", versions={"schema": {"major": 1, "minor": 2}, "extraction": 4}, unknown=1)),
        ("p", 6, j(generatedAt="2024-01-02", note="y", versions={"schema": "1.2"}, row_count=7)),
        (None, 1, j(note="x")), ("q", None, j(note="x")), ("q", 1, None), ("q", 2, "[1]"), ("q", 3, ""),
    ]
    got = {tuple(r) for r in schema_drift.changes(files(spark, texts)).select("run_no", "field_name", "change").collect()}
    assert got == {
        (2, "generated_at", "renamed"), (2, "generated_at", "retyped"), (2, "corpus_dir", "retyped"), (4, "row_count", "retyped"), (4, "note", "added"), (4, "corpus_dir", "retyped"),
        (5, "generated_at", "retyped"), (5, "note", "renamed"), (5, "row_count", "removed"), (5, "corpus_dir", "removed"), (5, "schema_version", "added"), (5, "extraction_version", "added"),
        (6, "schema_version", "retyped"), (6, "extraction_version", "removed"), (6, "row_count", "added"),
    }
    t = {r.run_no: r for r in schema_drift.table(files(spark, texts)).collect()}
    assert sorted(t) == [1, 2, 4, 5, 6]
    assert [t[k].generated_at for k in (1, 2, 5)] == [datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 2)]
    assert [t[k].corpus_dir for k in (1, 2, 4, 5)] == ["/a", "/a/b", "/a;/b", None]
    assert (t[4].row_count, t[5].schema_version, t[5].extraction_version) == (1234, "1.2", "v4")


def test_empty(spark):
    assert schema_drift.changes(files(spark, [("p", 1, "{}")])).count() == 0
    assert schema_drift.table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fields_at_any_depth(spark):
    texts = [
        ("p", 1, {"row_count": 5, "build": {"info": {"generated_at": "2024-01-01T00:00:00Z", "corpus": {"path": {"root": "/a", "note": "n"}}}}}),
        ("p", 2, {"a": {"counts": {"rows": 5}}, "build": {"info": {"generated_at": 1704067200, "corpus": {"path": "/a"}}}}),
        ("p", 3, {"a": {"b": {"c": {"d": {"row_count": 5}}}}, "list": [{"note": "x"}]}),
    ]
    f = files(spark, [(p, r, json.dumps(x)) for p, r, x in texts])
    got = {tuple(r) for r in schema_drift.changes(f).select("run_no", "field_name", "change").collect()}
    assert got == {(2, "row_count", "renamed"), (2, "generated_at", "retyped"), (2, "corpus_dir", "retyped"), (3, "row_count", "renamed"), (3, "generated_at", "removed"), (3, "corpus_dir", "removed")}
    assert [r.row_count for r in schema_drift.table(f).orderBy("run_no").collect()] == [5, 5, 5]


def test_stretches_change_nothing(spark, monkeypatch):
    import random

    r = random.Random(4)
    texts = []
    for p in "pq":
        for run in sorted(r.sample(range(1, 90), 40)):
            doc = {}
            for name in ("note", "row_count", "generator"):
                if r.random() < 0.8:
                    doc[name if r.random() < 0.9 else name.upper() + "_"] = r.choice([None, "x", 5, ["a"]])
            texts.append((p, run, json.dumps(doc)))
    f = files(spark, texts)
    whole = {tuple(x) for x in schema_drift.changes(f).collect()}
    monkeypatch.setattr(schema_drift, "SEGMENT", 3)
    assert {tuple(x) for x in schema_drift.changes(f).collect()} == whole and len(whole) > 50


def test_unknown_fields(spark):
    f = files(spark, [("p", 1, '{"note": "x", "colour": "red", "deep": {"er": {"size": 3}}}'), ("p", 4, '{"colour": null}'), ("q", 1, '{"note": "x"}')])
    got = {tuple(r) for r in schema_drift.unknown_fields(f).collect()}
    assert got == {("p", "colour", 2, 1, 4, "string"), ("p", "deep/er/size", 1, 1, 1, "number")}
