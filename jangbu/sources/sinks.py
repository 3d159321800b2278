"""Sinks that publish all or nothing, and cache keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jangbu.runtime import cut


def _filesystem(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish(df: DataFrame, path: str, violations: DataFrame | None = None) -> None:
    """Write beside ``path`` and swap; with any row in ``violations`` nothing changes and the first ones are raised.

    The old output is kept until the new one is in place, and put back if the swap fails.
    """
    if violations is not None and (bad := violations.limit(5).collect()):
        raise ValueError(f"not published: {bad}")
    fs, target, make = _filesystem(df, path)
    fresh, old = make(f"{path}.new-{uuid.uuid4().hex}"), make(f"{path}.old-{uuid.uuid4().hex}")
    df.write.parquet(fresh.toString())
    existed = fs.exists(target)
    if existed and not fs.rename(target, old):
        raise OSError(f"{path} cannot be replaced")
    if not fs.rename(fresh, target):
        if existed:
            fs.rename(old, target)
        raise OSError(f"{path} cannot be written")
    if existed:
        fs.delete(old, True)


def refresh_documents(df: DataFrame, path: str, key: str = "document_id") -> None:
    """Replace only the partitions of the delivered keys: one folder a key, for some hundreds of keys; ``refresh_buckets`` is for many."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def refresh_buckets(df: DataFrame, path: str, key: str = "document_id", newest: str | None = None, buckets: int = 64) -> None:
    """Replace the delivered keys in a table of ``buckets`` hash buckets; only the buckets they fall into are rewritten.

    With ``newest`` the rows of a key's greatest value stay, whichever side they
    are on, so that a late batch does not replace a newer one and a repeated one
    changes nothing.  Null keys are one key.  A reader sees a column ``bucket``.
    """
    spark = df.sparkSession
    new = cut(df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    fs, target, _ = _filesystem(df, path)
    if fs.exists(target):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(*touched))
        if newest is None:
            new = cut(old.join(new.select(key).distinct().withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left_anti").unionByName(new))
        else:
            both = old.unionByName(new)
            top = both.groupBy(key).agg(F.max(newest).alias("_top")).withColumnRenamed(key, "_k")
            kept = both.join(top, F.col(key).eqNullSafe(F.col("_k"))).where(F.col(newest).eqNullSafe(F.col("_top"))).drop("_k", "_top")
            new = cut(kept.dropDuplicates())
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def ordered_files(df: DataFrame, path: str, order: list[str], kind: str = "csv") -> None:
    """A table as files whose names and rows follow ``order``: the same table gives the same files, of any size."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").format(kind).option("header", True).option("ignoreNullFields", False).save(path)


def one_file(df: DataFrame, path: str, order: list[str], kind: str = "json") -> None:
    """A small result as one file in a fixed order."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").format(kind).save(path)


def cache_key(*inputs: Column) -> Column:
    """SHA-256 over the inputs' canonical JSON: equal inputs, equal key; null differs from empty."""
    return F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)


def cached(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """What the cache holds of ``wanted``, and what it does not."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")
