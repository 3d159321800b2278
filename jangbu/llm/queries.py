"""Registered queries of the text operators, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jangbu.llm import abuse, encode, leaks, lookalike, names, split
from jangbu.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversize(table(spark, d, "chunks"), table(spark, d, "index_tags"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split(table(spark, d, "chunks"), table(spark, d, "index_tags"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.links(table(spark, d, "identity_records"), table(spark, d, "buyer_orgs"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.project_classes(table(spark, d, "identity_records"), table(spark, d, "buyer_orgs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.mismatches(table(spark, d, "identity_records"), table(spark, d, "registry")).select("record_id")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.forms(table(spark, d, "identity_records"), table(spark, d, "registry")).select("record_id", "source_form", "registered_form", "visible_edits")


def p6_manifest(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.manifest(table(spark, d, "identity_records"), table(spark, d, "registry"), table(spark, d, "data_manifest"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p9_by_item(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "heldout_items")
    found = leaks.leaks(table(spark, d, "documents"), items)
    n = found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max(F.col("n_found") / F.col("n_words")).alias("largest_share"))
    return items.select("item_id", "split").join(F.broadcast(n), "item_id", "left").select("item_id", "split", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "largest_share")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents")).where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_pieces, p5_found, p5_classes, p6_found, p6_forms, p6_manifest, p8_ids, p9_found, p9_by_item, p10_found, p10_scores, p10_rates)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            select c.chunk_key from chunks c join index_tags t using (chunking_version)
            where length(c.text) > greatest(t.chunk_size - length(concat_ws(' > ', c.source_document_title, array_to_string(c.section_path, ' > '))) - 1, 200)""",
    }
