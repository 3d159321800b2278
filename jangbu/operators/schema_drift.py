"""Files whose fields drift over runs: one typed table, and every change.

A column-lifespan catalogue: every readable file is exploded into its fields,
``lag`` finds where a field's presence breaks, the running sum of the breaks
numbers its islands, and starts, endings, moves and type changes are read off the
islands.  Files are read as VARIANT, so no schema is guessed or merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jangbu.runtime import cut

# Field, kind it is cast to, names it goes by (folded: lower case, only letters and digits; parent/child where the child's name alone would not do).
ALIASES = (
    ("generated_at", "instant", "generatedat generated createdat created buildtime builtat buildat releasedat generationtime timestamp 생성시각 생성일시 작성시각"),
    ("corpus_dir", "place", "corpusdir corpuspath corpusroot corpusfolder corpuslocation inputfolder inputdir inputpath 코퍼스경로 코퍼스위치 paths/corpus corpus/dir corpus/path"),
    ("schema_version", "version", "schemaversion schemaver 스키마버전 versions/schema version/schema schema/version"),
    ("extraction_version", "version", "extractionversion extractionver extractorversion 추출버전 versions/extraction version/extraction extraction/version"),
    ("row_count", "count", "rowcount rows nrows numrows totalrows 행수 counts/rows"),
    ("document_count", "count", "documentcount doccount ndocs ndocuments numdocs documents docs 문서수 counts/documents counts/docs"),
    ("generator", "text", "generator tool builtby program generatedby createdby 생성도구 생성기"),
    ("table_sha256", "text", "tablesha256 sha256 tabledigest tablehash digest checksum fingerprint 지문 table/sha256"),
    ("decisions_applied", "count", "decisionsapplied decisions ndecisions 적용결정수"),
    ("supersedes", "text", "supersedes replaces supersededversion 대체버전"),
    ("note", "text", "note notes comment remark remarks memo 비고"),
)


def alias_table(spark: SparkSession) -> DataFrame:
    """``alias, field_name, kind`` (under 100 rows, fixed)."""
    return spark.createDataFrame([(a, f, k) for f, k, names in ALIASES for a in names.split()], "alias string, field_name string, kind string")


def _fold(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def _kind(v: str) -> Column:
    """JSON type of a variant: string, number, array, object, boolean, or null."""
    s = F.expr(f"schema_of_variant({v})")
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("BIGINT") | s.startswith("DECIMAL") | s.startswith("DOUBLE") | s.startswith("FLOAT"), "number")
    )


def runs(files: DataFrame) -> DataFrame:
    """One row per producer and run that has a readable file: ``producer, run_no, n, next_run_no, doc``.

    Readable is a JSON object, with or without a byte-order mark.  Of several
    readable deliveries of a run the last one counts.  Files without producer,
    run number or text, cut-off files and other JSON are left out.
    """
    parsed = files.where("producer is not null and run_no is not null").select("producer", "run_no", "delivered_at", "file_id", F.regexp_replace("raw_json", "^[\\s﻿]+", "").alias("raw_json"))
    readable = parsed.where(F.expr("schema_of_variant(try_parse_json(raw_json)) like 'OBJECT%'"))
    last = readable.groupBy("producer", "run_no").agg(F.max_by("raw_json", F.struct("delivered_at", "file_id")).alias("raw_json"))
    numbers = _numbered(last.select("producer", "run_no"))
    return last.join(numbers, ["producer", "run_no"]).select("producer", "run_no", "n", "next_run_no", F.expr("try_parse_json(raw_json)").alias("doc"))


#: Runs of a producer that one task orders at a time; a producer may have any number of them.
SEGMENT = 1024


def _numbered(runs: DataFrame) -> DataFrame:
    """``producer, run_no, n, next_run_no``: a producer's runs counted from 1, in stretches of ``SEGMENT`` run numbers and then over the stretches, so that no task sorts all runs of one producer."""
    keyed = runs.withColumn("seg", F.floor(F.col("run_no") / SEGMENT))
    inside = Window.partitionBy("producer", "seg").orderBy("run_no")
    over = Window.partitionBy("producer").orderBy("seg")
    part = keyed.groupBy("producer", "seg").agg(F.count("*").alias("k"), F.min("run_no").alias("first"))
    part = part.select("producer", "seg", (F.sum("k").over(over) - F.col("k")).alias("upto"), F.lead("first").over(over).alias("following"))
    own = keyed.select("producer", "run_no", "seg", F.row_number().over(inside).alias("r"), F.lead("run_no").over(inside).alias("next"))
    return own.join(part, ["producer", "seg"]).select("producer", "run_no", (F.col("upto") + F.col("r")).cast("int").alias("n"), F.coalesce("next", "following").alias("next_run_no"))


def _items(run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of every level of objects, outside arrays and outside objects that are a field themselves: those an alias names, and the others that are no object."""
    spark = run.sparkSession
    names = alias_table(spark)
    whole, leaf = F.broadcast(names.withColumnsRenamed({"field_name": "f1", "kind": "k1", "alias": "a1"})), F.broadcast(names.withColumnsRenamed({"field_name": "f2", "kind": "k2", "alias": "a2"}))
    level = run.select("producer", "run_no", "n", "next_run_no", F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("parent"), F.col("doc").alias("inside"))
    named = other = None
    while True:
        items = level.lateralJoin(spark.tvf.variant_explode(F.col("inside").outer())).select("producer", "run_no", "n", "next_run_no", F.concat_ws("/", "up", "key").alias("path"), _fold(F.col("key")).alias("alias"), "parent", "value")
        known = items.join(whole, F.concat_ws("/", "parent", "alias") == F.col("a1"), "left").join(leaf, F.col("alias") == F.col("a2"), "left")
        found = known.where("f1 is not null or f2 is not null").drop("alias", "parent")
        rest = known.where(F.col("f1").isNull() & F.col("f2").isNull())
        unknown = rest.where(F.coalesce(_kind("value"), F.lit("null")) != "object").select("producer", "run_no", "path", _kind("value").alias("json_type"))
        named, other = (found, unknown) if named is None else (named.unionByName(found), other.unionByName(unknown))
        # below a field that is an object itself (corpus_dir: {root, name}) nothing is looked for
        level = cut(rest.where(_kind("value") == "object").select("producer", "run_no", "n", "next_run_no", F.col("path").alias("up"), F.col("alias").alias("parent"), F.col("value").alias("inside")))
        if level.isEmpty():
            return named, other


def fields(run: DataFrame) -> DataFrame:
    """``producer, run_no, n, next_run_no, field_name, kind, path, json_type, value`` of every known field of every run.

    ``json_type`` is null for a null value.  A run that names a field twice counts
    its first path in alphabetical order.
    """
    named, _ = _items(run)
    flat = named.select("producer", "run_no", "n", "next_run_no", F.coalesce("f1", "f2").alias("field_name"), F.coalesce("k1", "k2").alias("kind"), "path", _kind("value").alias("json_type"), F.expr("try_variant_get(value, '$', 'string')").alias("value"))
    keys = ["producer", "run_no", "n", "next_run_no", "field_name", "kind"]
    return flat.groupBy(*keys).agg(F.min(F.struct("path", "json_type", "value")).alias("x")).select(*keys, "x.*")


def unknown_fields(files: DataFrame) -> DataFrame:
    """``producer, path, n_runs, first_run, last_run, json_types`` of the fields no alias names: what the table does not hold, for the alias list to be drawn up from."""
    _, other = _items(runs(files))
    return other.groupBy("producer", "path").agg(F.countDistinct("run_no").alias("n_runs"), F.min("run_no").alias("first_run"), F.max("run_no").alias("last_run"), F.array_join(F.array_sort(F.collect_set("json_type")), ",").alias("json_types"))


def changes(files: DataFrame) -> DataFrame:
    """``producer, run_no, field_name, change``: ``added``, ``removed``, ``renamed`` or ``retyped``, against the producer's previous readable run.

    A field with a null value is present and has no type; ``retyped`` compares
    with the last value that was not null since the field was last added.  A
    producer's first readable run reports nothing.
    """
    f = _lives(fields(runs(files)).select("producer", "run_no", "n", "next_run_no", "field_name", "path", "json_type"))
    said = lambda cond, run, what: F.when(cond, F.struct(run.alias("run_no"), F.lit(what).alias("change")))
    run_no, gone = F.col("run_no"), F.coalesce(F.col("after") > F.col("n") + 1, F.lit(True)) & F.col("next_run_no").isNotNull()
    found = F.array(
        said(F.col("starts") & (F.col("n") > 1), run_no, "added"),
        said(gone, F.col("next_run_no"), "removed"),
        said(~F.col("starts") & (F.col("path") != F.col("old_path")), run_no, "renamed"),
        said(F.col("json_type") != F.col("old_type"), run_no, "retyped"),
    )
    return f.select("producer", "field_name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("producer", "c.run_no", "field_name", "c.change")


def _lives(f: DataFrame) -> DataFrame:
    """Rows of fields with ``before, old_path, after, starts, old_type``: the field's previous and next run, its previous path, whether its life starts here, and its last type that was not null in this life.

    Lag and islands are worked out within stretches of ``SEGMENT`` runs, and what
    a stretch hands on to the next over the stretches, so that a producer's hot
    field is no single task.
    """
    key = ["producer", "field_name", "seg"]
    f = cut(f.withColumn("seg", F.floor(F.col("n") / SEGMENT)))
    w = Window.partitionBy(*key).orderBy("n")
    f = f.withColumns({"lag_n": F.lag("n").over(w), "lag_path": F.lag("path").over(w), "lead_n": F.lead("n").over(w)})
    f = f.withColumn("island", F.sum(F.coalesce(F.col("lag_n") < F.col("n") - 1, F.lit(False)).cast("int")).over(w))
    life = Window.partitionBy(*key, "island").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumns({"own_type": F.last("json_type", ignorenulls=True).over(life), "islands": F.max("island").over(Window.partitionBy(*key))})
    at_end = F.when((F.col("island") == F.col("islands")) & F.col("json_type").isNotNull(), F.struct("n", "json_type"))
    part = f.groupBy(*key).agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.max_by("path", "n").alias("last_path"), (F.max("islands") > 0).alias("broken"), F.max(at_end)["json_type"].alias("type_at_end"))
    over = Window.partitionBy("producer", "field_name").orderBy("seg")
    part = part.withColumns({"prev_n": F.lag("last_n").over(over), "prev_path": F.lag("last_path").over(over), "next_n": F.lead("first_n").over(over)})
    part = part.withColumn("joined", F.coalesce(F.col("prev_n") == F.col("first_n") - 1, F.lit(False)))
    part = part.withColumn("life", F.sum((F.col("broken") | ~F.col("joined")).cast("int")).over(over))
    part = part.withColumn("type_end", F.last("type_at_end", ignorenulls=True).over(Window.partitionBy("producer", "field_name", "life").orderBy("seg")))
    part = part.withColumn("prev_type", F.lag("type_end").over(over)).select(*key, "prev_n", "prev_path", "next_n", "joined", "prev_type")
    j = f.join(part, key)
    first = F.col("lag_n").isNull()
    j = j.withColumns({"before": F.coalesce("lag_n", "prev_n"), "old_path": F.when(first, F.col("prev_path")).otherwise(F.col("lag_path")), "after": F.coalesce("lead_n", "next_n"), "old_type": F.coalesce("own_type", F.when((F.col("island") == 0) & F.col("joined"), F.col("prev_type")))})
    return j.withColumn("starts", F.coalesce(F.col("before") < F.col("n") - 1, F.lit(True)))


def _cast(kind: str) -> Column:
    """Text of a value of ``kind`` brought to one notation."""
    v = F.col("value")
    zoned = F.expr("convert_timezone(current_timezone(), 'UTC', cast(try_cast(value as timestamp) as timestamp_ntz))")
    if kind == "instant":
        us = F.when(v.rlike(r"^\d{10}$"), v.cast("long") * 1_000_000).when(v.rlike(r"^\d{13}$"), v.cast("long") * 1000)
        stamp = F.coalesce(F.expr("timestampadd(MICROSECOND, us, timestamp_ntz'1970-01-01 00:00:00')"), F.when(v.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & v.contains(":"), zoned).otherwise(F.expr("try_cast(value as timestamp_ntz)")))
        return us, stamp  # the caller names the first column us
    if kind == "count":
        return F.expr("try_cast(replace(value, ',', '') as bigint)")
    if kind == "version":
        major = F.get_json_object("value", "$.major")
        return F.when(F.col("json_type") == "object", F.concat_ws(".", major, F.get_json_object("value", "$.minor"))).when(v.rlike(r"^\d+$") & (F.col("field_name") == "extraction_version"), F.concat(F.lit("v"), v)).otherwise(v)
    if kind == "place":
        one = F.concat_ws("/", F.get_json_object("value", "$.root"), F.get_json_object("value", "$.name"))
        return F.regexp_replace(F.when(F.col("json_type") == "object", one).when(F.col("json_type") == "array", F.array_join(F.from_json("value", "array<string>"), ";")).otherwise(v), r"\\", "/")
    return v


def table(files: DataFrame) -> DataFrame:
    """Every readable run in one table with one type per field.

    ``generated_at`` TIMESTAMP_NTZ (UTC), counts BIGINT, the rest STRING: a
    place given in parts is joined with ``/``, a list of places with ``;``, a
    version given in parts with ``.``.  Values that cannot be cast are null.
    """
    f = fields(runs(files))
    us, stamp = _cast("instant")
    f = f.withColumn("us", us).withColumns({"as_instant": stamp, "as_count": _cast("count"), "as_version": _cast("version"), "as_place": _cast("place")})
    source = {"instant": "as_instant", "count": "as_count", "version": "as_version", "place": "as_place", "text": "value"}
    return f.groupBy("producer", "run_no").agg(*(F.max(F.when(F.col("field_name") == name, F.col(source[kind]))).alias(name) for name, kind, _ in ALIASES))
