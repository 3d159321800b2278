"""Lines found in chunks: interval joins that answer with the narrowest chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def narrowest(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, interval_id: str, point_id: str, width: int = 64) -> DataFrame:
    """``point_id, interval_id``: for every point the narrowest interval of its key that holds it, null if none does.

    Ties go to the later start, then to the smaller id.  Intervals are laid over
    buckets of ``width`` lines, so that a key with very many of them is no nested
    loop; the winner is taken by a partial aggregation, not by sorting.
    """
    b = lambda c: F.floor(F.col(c) / width).cast("int")
    spread = intervals.where(F.col(start) <= F.col(end)).select(key, interval_id, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(b(start), b(end))).alias("_b"))
    held = points.select(key, point_id, F.col(point).alias("_p"), b(point).alias("_b")).join(spread, [key, "_b"]).where("_p between _s and _e")
    best = held.groupBy(point_id).agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("w"), (-F.col("_s")).alias("s"), F.col(interval_id).alias("id"))).alias("x"))
    return points.select(point_id).join(best, point_id, "left").select(point_id, F.col("x.id").alias(interval_id))


def covering(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Every point with every interval of its key that holds it; intervals without a sound start and end hold nothing.

    As in ``narrowest`` both sides meet in buckets of ``width`` lines.
    """
    b = lambda c: F.floor(F.col(c) / width).cast("int")
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(b(start), b(end))))
    return points.withColumn("_b", b(point)).join(spread, [key, "_b"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_b")


def in_section(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gold locations met by candidate locations of the same document and section: by line where both have one, else by reference number."""
    g, c = gold.alias("g"), candidates.alias("c")
    on = (F.col("g.document_id") == F.col("c.document_id")) & (F.col("g.section") == F.col("c.section"))
    hit = F.when(F.col("g.line").isNotNull() & F.col("c.line").isNotNull(), F.col("g.line").between(F.col("c.line"), F.coalesce("c.line_end", "c.line"))).otherwise(F.col("g.ref_no") == F.col("c.ref_no"))
    return g.join(c, on).where(hit).select("g.gold_id", "c.candidate_id")


def lookup(chunks: DataFrame) -> DataFrame:
    """``document_id, location_label, chunk_key, n, n_of_document``: the first chunk under each label of a document, how many stand there, and how many the document has."""
    at = chunks.where("document_id is not null").groupBy("document_id", "location_label").agg(F.min("chunk_key").alias("chunk_key"), F.count("*").alias("n"))
    return at.join(at.groupBy("document_id").agg(F.sum("n").alias("n_of_document")), "document_id")
