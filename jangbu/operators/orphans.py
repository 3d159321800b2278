"""References to documents the registry does not hold at the time of the reference.

Keys are dictionary-encoded; per key range and month one bitmap says which keys
are referenced and another which keys the registry holds during the whole month.
References AND-NOT held leaves the keys that may dangle; only those go through
the exact interval check.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from jangbu.runtime import cut

#: Bits of one bitmap (Spark's bitmap functions are fixed to 4 kB); least number of hash ranges the dictionary is numbered in, and keys a range is meant to hold.
BITS = 32_768
RANGES, KEYS = 64, 1_000_000


def normal_id(c: Column) -> Column:
    """Trimmed of white space of any kind, upper case, null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def references(evaluation_items: DataFrame, approved_memory: DataFrame) -> DataFrame:
    """Every document reference: ``source_table, row_key, field_name, document_id, at``, distinct.

    Null, empty and blank ids are no references; null structs and arrays give
    none; an id repeated in one row and field counts once.
    """
    e = evaluation_items.select(
        F.lit("evaluation_items").alias("source_table"),
        F.col("item_key").alias("row_key"),
        F.col("created_at").alias("at"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("document_id").alias("field_name"), F.col("document_id").alias("id")), F.struct(F.lit("location.document").alias("field_name"), F.col("location.document").alias("id"))),
                F.transform(F.coalesce("evidence.location.document", F.array().cast("array<string>")), lambda x: F.struct(F.lit("evidence.location.document").alias("field_name"), x.alias("id"))),
            )
        ).alias("r"),
    )
    m = approved_memory.select(
        F.lit("approved_memory").alias("source_table"),
        F.col("memory_key").alias("row_key"),
        F.col("reviewed_at").alias("at"),
        F.explode(F.transform(F.coalesce("approved_plan.document_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("approved_plan.document_ids").alias("field_name"), x.alias("id")))).alias("r"),
    )
    both = e.unionByName(m).select("source_table", "row_key", F.col("r.field_name").alias("field_name"), normal_id(F.col("r.id")).alias("document_id"), "at")
    return both.where(F.col("document_id").isNotNull()).distinct()


def holdings(registry: DataFrame) -> DataFrame:
    """``document_id, held_from, held_to`` of every registry row that has an id and a start; ``held_to`` null while it is held."""
    return registry.select(normal_id(F.col("document_id")).alias("document_id"), F.col("registered_at").alias("held_from"), F.col("deleted_at").alias("held_to")).where("document_id is not null and held_from is not null").distinct()


def dictionary(ids: DataFrame) -> DataFrame:
    """``document_id, key_range, bit``: a dense number for every distinct id.

    Numbered within hash ranges of about ``KEYS`` ids, so no step sorts all keys at
    once, and by id order, so a lost executor's part is numbered the same again.
    """
    d = ids.select("document_id").distinct()
    ranges = max(RANGES, d.count() // KEYS)
    d = d.withColumn("h", F.pmod(F.xxhash64("document_id"), F.lit(ranges)))
    n = F.row_number().over(Window.partitionBy("h").orderBy("document_id")) - 1
    return d.withColumn("n", n).select("document_id", (F.col("h") + ranges * F.floor(F.col("n") / BITS)).alias("key_range"), (F.col("n") % BITS).cast("long").alias("bit"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _and_not(referenced: pd.Series, held: pd.Series) -> pd.Series:
    """Bit numbers set in ``referenced`` and not in ``held``."""
    out = []
    for r, h in zip(referenced, held, strict=True):
        bits = np.frombuffer(r, np.uint8)
        if h is not None:
            bits = bits & ~np.frombuffer(h, np.uint8)
        byte = np.flatnonzero(bits)
        sub = np.unpackbits(bits[byte][:, None], axis=1, bitorder="little")
        k, b = np.nonzero(sub)
        out.append((byte[k] * 8 + b).astype(np.int32))
    return pd.Series(out)


def _month(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def suspects(refs: DataFrame, held: DataFrame) -> DataFrame:
    """``document_id, period``: keys referenced in a month that the registry does not hold throughout that month."""
    asked = cut(refs.where("at is not null").select("document_id", _month("at").alias("period")).distinct())
    lo, hi = asked.agg(F.min("period")).scalar(), asked.agg(F.max("period")).scalar()
    codes = cut(dictionary(asked))
    # months a holding covers from their first to their last instant, within those asked about
    first = _month("held_from") + F.when(F.col("held_from") <= F.date_trunc("month", "held_from"), 0).otherwise(1)
    full = (
        held.select("document_id", F.greatest(first, lo).alias("a"), F.least(F.coalesce(_month("held_to") - 1, hi), hi).alias("b"))
        .where("a <= b")
        .select("document_id", F.explode(F.sequence("a", "b")).alias("period"))
    )
    marks = asked.withColumn("side", F.lit(1)).unionByName(full.withColumn("side", F.lit(0))).join(codes, "document_id")
    bitmap = lambda side: F.expr(f"bitmap_construct_agg(bit) filter (where side = {side})")
    maps = marks.groupBy("key_range", "period").agg(bitmap(1).alias("referenced"), bitmap(0).alias("held")).where("bitmap_count(referenced) > 0")
    left = maps.select("key_range", "period", F.explode(_and_not("referenced", "held")).alias("bit"))
    return left.withColumn("bit", F.col("bit").cast("long")).join(codes, ["key_range", "bit"]).select("document_id", "period")


def dangling(evaluation_items: DataFrame, approved_memory: DataFrame, registry: DataFrame) -> DataFrame:
    """Every reference no registry row holds at its time: ``source_table, row_key, field_name, document_id, at``.

    A reference without a time cannot be held by any row and dangles.  Registry
    rows without a start hold nothing.
    """
    refs, held = cut(references(evaluation_items, approved_memory)), holdings(registry)
    maybe = refs.withColumn("period", _month("at")).join(suspects(refs, held), ["document_id", "period"], "left_semi").drop("period")
    timeless = refs.where("at is null")
    found = maybe.alias("r").join(held.alias("h"), F.expr("r.document_id = h.document_id and h.held_from <= r.at and (h.held_to is null or r.at < h.held_to)"), "left_anti")
    return found.unionByName(timeless)


def report(found: DataFrame) -> DataFrame:
    """Dangling references per table, field and month (``yyyy-MM``, null for references without a time)."""
    return found.groupBy("source_table", "field_name", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n_references"), F.countDistinct("document_id").alias("n_documents"))
