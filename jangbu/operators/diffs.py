"""Two states of one thing compared or merged: full outer diffs, overlays, refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys and ``change``: ``added``, ``removed``, or ``changed`` where any value differs (null equals null); equal keys are left out."""
    o = old.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("_o"))
    n = new.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("_n"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    j = o.join(n, keys, "full_outer")
    return j.select(*keys, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~same, "changed").alias("change")).where("change is not null")


def overlay(base: DataFrame, decisions: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """``base`` with ``value`` replaced where a decision names its key, and the decisions that are in error: no such key, or nothing changed."""
    d = decisions.select(*keys, F.col(value).alias("_new"))
    merged = base.join(d, keys, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")
    error = d.join(base.select(*keys, value), keys, "left").where(F.col(value).isNull() | F.col(value).eqNullSafe(F.col("_new"))).select(*keys)
    return merged, error


def refresh(kept: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``kept`` without the keys that ``new`` delivers, and all of ``new``."""
    return kept.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_soft(index: DataFrame, document: DataFrame, key: str = "document_id") -> DataFrame:
    """``index`` with the delivered documents' old rows set inactive, and the new rows appended as active."""
    named = document.select(key).distinct().withColumn("_d", F.lit(True))
    old = index.join(named, key, "left").withColumn("active", F.col("active") & F.col("_d").isNull()).drop("_d")
    return old.unionByName(document.withColumn("active", F.lit(True)))


def upsert(base: DataFrame, delivered: DataFrame, key: Column) -> DataFrame:
    """``base`` with delivered rows merged in by ``key``, an expression both sides have the columns of.

    A delivered value that is not null wins; columns only ``base`` has are kept, of
    new rows null.  Of several delivered rows of one key the caller keeps one.
    """
    b, d = base.withColumn("_key", key), delivered.withColumn("_key", key)
    shared = [c for c in base.columns if c in delivered.columns]
    j = b.alias("b").join(d.alias("d"), F.col("b._key") == F.col("d._key"), "full_outer")
    return j.select(*((F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")) if c in shared else F.col(f"b.{c}")).alias(c) for c in base.columns))
