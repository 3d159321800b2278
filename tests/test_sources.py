import json
import time
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from jangbu.sources import readers, sinks
from jangbu.streaming import twins


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t": null}\n')
    assert rows(readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id long, t string")) == [(1, "x"), (2, None)]
    (tmp_path / "cut.jsonl").write_text('{"id": 1}\n{"id": ')
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "cut.jsonl"), "id long").collect()
    (tmp_path / "b.json").write_text(json.dumps({"id": 1}, indent=2) + "\n" + json.dumps({"id": 2}))
    assert rows(readers.json_stream(spark, str(tmp_path / "b.json"), "id long")) == [(1,), (2,)]
    (tmp_path / "t.json").write_text(json.dumps({"rows": [{"id": 1}, {"id": 3}], "other": 1}))
    assert rows(readers.rows_of(spark, str(tmp_path / "t.json"), "id:long")) == [(1,), (3,)]
    (tmp_path / "c.csv").write_text('﻿document_id,name\nb,"x, ""y"""\na,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "c.csv"), ["document_id"], "document_id").collect()] == [("a", None), ("b", 'x, "y"')]
    assert readers.table_by_suffix(spark, str(tmp_path / "c.csv"), "id:long", ["name"]).count() == 2
    with pytest.raises(ValueError, match="lacks z"):
        readers.csv(spark, str(tmp_path / "c.csv"), ["z"])
    (tmp_path / "d.csv").write_text("k,v\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="twice"):
        readers.decisions(spark, str(tmp_path / "d.csv"), ["k"])
    (tmp_path / "VERSION.txt").write_text("corpus : v2\nno colon\ntime: 10:30\n")
    assert rows(readers.versions(spark, str(tmp_path / "VERSION.txt"))) == [("corpus", "v2"), ("time", "10:30")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/ok.md").write_text("한글")
    (tmp_path / "raw/bad.md").write_bytes(b"\xff\xfe\x00")
    assert readers.undecodable(spark, str(tmp_path / "raw")).count() == 1 and readers.whole_texts(spark, str(tmp_path / "raw")).count() == 2


def test_publishing_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.publish(spark.range(3), path)
    sinks.publish(spark.range(5), path, spark.range(0))
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError, match="not published"):
        sinks.publish(spark.range(9), path, spark.range(1))
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int")
    sinks.refresh_documents(docs, str(tmp_path / "parts"))
    sinks.refresh_documents(spark.createDataFrame([("b", 3)], "document_id string, v int"), str(tmp_path / "parts"))
    assert rows(spark.read.parquet(str(tmp_path / "parts"))) == [("a", 1), ("b", 3)]
    sinks.one_file(docs, str(tmp_path / "one"), ["v"])
    assert len(list((tmp_path / "one").glob("*.json"))) == 1


def test_cache(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "p string, q string").withColumn("cache_key", sinks.cache_key(F.col("p"), F.col("q")))
    keys = [r.cache_key for r in df.collect()]
    assert keys[0] == keys[2] != keys[1]
    have, miss = sinks.cached(df, df.where("q = ''").select("cache_key", F.lit(1).alias("v")))
    assert have.count() == 1 and miss.count() == 2


def run(df, tmp_path, mode="append", **kw):
    q = df.writeStream.format("memory").queryName(f"q{time.time_ns()}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{time.time_ns()}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(q.name)


def test_streams(spark, tmp_path):
    turns = [("s", 1, None), ("s", 2, "d1"), ("s", 3, None), ("s", 4, "d2"), ("t", 1, None)]
    spark.createDataFrame(turns, "session_id string, turn long, document_id string").write.parquet(str(tmp_path / "turns"))
    got = run(twins.active_documents(spark.readStream.schema("session_id string, turn long, document_id string").parquet(str(tmp_path / "turns"))), tmp_path)
    assert rows(got.select("session_id", "turn", "active_document")) == sorted([(None, "s", 1), ("d1", "s", 2), ("d1", "s", 3), ("d2", "s", 4), (None, "t", 1)], key=repr)
    events = [(datetime(2024, 1, 1, h, m), "a", 1.0) for h in range(4) for m in (0, 30)]
    spark.createDataFrame(events, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events"))
    n = run(twins.counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "events"))), tmp_path, "complete")
    assert [r.n for r in n.orderBy("start").collect()] == [2, 2, 2, 2]
    write = twins.merge_into(str(tmp_path / "merged"))
    for batch in ([("a", 1), ("b", 1)], [("b", 2)], [("b", 2)]):
        write(spark.createDataFrame(batch, "document_id string, v int"), 0)
    assert rows(spark.read.parquet(str(tmp_path / "merged"))) == [("a", 1), ("b", 2)]


def test_streams_of_files_and_of_folders(spark, tmp_path):
    """t03: a table that is a folder of files is streamed like one that is a file."""
    from datetime import datetime

    from jangbu.assets import t03_streamed_refresh

    data = [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 2, 1)), ("b", None), (None, datetime(2024, 3, 1))]
    df = spark.createDataFrame(data, "document_id string, registered_at timestamp_ntz")
    df.repartition(2).write.parquet(str(tmp_path / "folder/registry.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file/registry.parquet")
    for d in ("folder", "file"):
        got = {(r.document_id, r.registered_at) for r in t03_streamed_refresh(spark, str(tmp_path / d)).collect()}
        assert got == {("a", datetime(2024, 2, 1)), (None, datetime(2024, 3, 1))}
