"""Readers with fixed schemas; a record that does not fit fails the read, it is never guessed at."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; a cut-off or misfit line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """``file, line_no, line`` of the lines that are no JSON object of the schema.

    Lines of a file are numbered by the task that reads it whole; only files with
    a bad line are read that way.
    """
    kind = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = spark.read.schema(whole).option("columnNameOfCorruptRecord", "_bad").json(path).select("*", F.input_file_name().alias("file")).cache()
    try:
        files = [r.file for r in parsed.where("_bad is not null").select("file").distinct().limit(1000).collect()]  # the first thousand bad files
    finally:
        parsed.unpersist()
    if not files:
        return spark.createDataFrame([], "file string, line_no long, line string")
    lines = spark.read.text(files, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    bad = F.from_json("line", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_none"})
    probe = F.try_parse_json("line")
    return lines.where((F.trim("line") != "") & (probe.isNull() | bad.isNull())).select("file", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def checked_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """``jsonl`` after a check of every line: the first bad one is named with its file and number."""
    for r in bad_lines(spark, path, schema).orderBy("file", "line_no").limit(1).collect():
        raise ValueError(f"{r.file} line {r.line_no}: {r.line[:80]}")
    return jsonl(spark, path, schema)


def unknown_keys(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``key, n`` of the members of JSON lines that the schema does not name."""
    known = T.DataType.fromDDL(schema).names
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("key"))
    return keys.where(~F.col("key").isin(*known)).groupBy("key").agg(F.count("*").alias("n"))


def strict_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines of exactly the schema's members: an unknown one, or a null in a required one, fails."""
    if extra := [r.key for r in unknown_keys(spark, path, schema).limit(10).collect()]:
        raise ValueError(f"{path} has unknown members {', '.join(sorted(extra))}")
    df = jsonl(spark, path, schema)
    lacking = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)).collect()[0].asDict() if required else {}
    if any(lacking.values()):
        raise ValueError(f"{path} lacks values: {lacking}")
    return df


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines or pretty-printed JSON objects one after another, per file.

    Each file is read whole by one task; what is no JSON between objects fails.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for b in batches:
            out = []
            for text in b["value"]:
                at, text = 0, text.removeprefix("﻿")
                while True:
                    while at < len(text) and text[at].isspace():
                        at += 1
                    if at >= len(text):
                        break
                    obj, at = decoder.raw_decode(text, at)
                    out.append(json.dumps(obj, ensure_ascii=False))
            yield pd.DataFrame({"json": out})

    raw = spark.read.text(path, wholetext=True)
    return raw.mapInPandas(split, "json string").select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def rows_of(spark: SparkSession, path: str, schema: str, member: str = "rows") -> DataFrame:
    """Rows under one member of a JSON document, e.g. ``{"rows": [...]}``."""
    whole = spark.read.schema(f"{member} array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.inline(member))


def csv(spark: SparkSession, path: str, required: list[str], sort: str | None = None) -> DataFrame:
    """Quoted CSV with a header, with or without a byte-order mark; every column a string; missing columns fail."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.orderBy(sort) if sort else df


def table_by_suffix(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """An extraction table from CSV or JSON, by the file's ending."""
    return csv(spark, path, required) if path.endswith(".csv") else rows_of(spark, path, schema)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``name, value`` of a ``name : value`` text; lines without a colon are left out."""
    line = spark.read.text(path).where(F.col("value").contains(":"))
    parts = F.split("value", ":", 2)
    return line.select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("value"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of every file below a folder."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def undecodable(spark: SparkSession, path: str) -> DataFrame:
    """``path, n_bytes`` of files that are not valid UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("length").alias("n_bytes"))


def decisions(spark: SparkSession, path: str, keys: list[str], reviewed: str | None = None, accepted: tuple[str, ...] = ("approved",)) -> DataFrame:
    """A frozen decision list; a key named twice fails, and a decision that was not reviewed where ``reviewed`` names the column that says so."""
    df = csv(spark, path, keys)
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path} decides {tuple(twice[0])[: len(keys)]} twice")
    if reviewed and (open_ := df.where(~F.coalesce(F.col(reviewed).isin(*accepted), F.lit(False))).select(*keys).limit(1).collect()):
        raise ValueError(f"{path}: {tuple(open_[0])} was not reviewed")
    return df


def table_problems(rows: DataFrame, statuses: tuple[str, ...], keys: tuple[str, ...] = ("document_id", "field_name"), active: Column | None = None) -> DataFrame:
    """``problem, n`` of a field table: rows without a key, unknown statuses, values where the status has none, several active rows of one cell; all four are reported, also with 0."""
    n = rows.agg(
        F.count_if(F.col(keys[0]).isNull() | F.col(keys[1]).isNull()).alias("no_key"), F.count_if(~F.coalesce(F.col("status").isin(*statuses), F.lit(False))).alias("unknown_status"), F.count_if((F.col("status") == "field_absent") & F.col("answer_normalized").isNotNull()).alias("value_without_status")
    )
    now = rows if active is None else rows.where(active)
    twice = now.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("several_active"))
    return n.join(F.broadcast(twice), F.lit(True)).unpivot([], ["no_key", "unknown_status", "value_without_status", "several_active"], "problem", "n")
