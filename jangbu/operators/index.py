"""A vector index and its tag: loading, validation, lineage, forced contexts."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a tag by the setting they must equal.
TAG_OF = {"chunk_size": "chunk_size", "chunk_overlap": "chunk_overlap", "chunk_unit": "chunk_unit", "embedding_model": "embedding_model", "embedding_provider": "embedding_provider", "preprocess_version": "preprocess_version", "corpus_version": "corpus_version", "registry_version": "document_registry_version", "extraction_version": "index_source_extraction_version"}


def loaded(vectors: DataFrame, metadata: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vectors with their metadata and ``dimension``; a vector without a row is left out, as is a row without a vector."""
    return vectors.join(metadata, key).withColumn("dimension", F.size(vector)).drop(vector)


def alignment(vectors: DataFrame, metadata: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: vectors, rows, those on one side only, and how many dimensions there are; an index is whole where both are equal and the dimension is one."""
    v, m = vectors.select(key, F.size(vector).alias("_d")), metadata.select(key, F.lit(True).alias("_m"))
    return v.join(m, key, "full_outer").agg(F.count("_d").alias("n_vectors"), F.count("_m").alias("n_rows"), F.count_if(F.col("_m").isNull()).alias("n_without_row"), F.count_if(F.col("_d").isNull()).alias("n_without_vector"), F.countDistinct("_d").alias("n_dimensions"))


def tag_problems(tags: DataFrame, settings: Mapping[str, Any], dimension: Column | None = None) -> DataFrame:
    """``tags`` with ``problems``: members that are missing, members that differ from the settings (those not set are not compared), and a dimension other than the vectors'."""
    said = [F.when(F.col(tag).isNull(), f"no_{tag}") for tag in TAG_OF]
    said += [F.when(F.col(tag).cast("string") != str(settings[name]), f"{tag}_differs") for tag, name in TAG_OF.items() if settings.get(name) is not None]
    if dimension is not None:
        said.append(F.when(~F.col("vector_dimension").eqNullSafe(dimension), "dimension_differs"))
    return tags.withColumn("problems", F.filter(F.array(*said), lambda x: x.isNotNull()))


def lineage(declared: Column, from_records: Column, n_in_records: Column, from_settings: Column) -> Column:
    """Version an index comes from, with where it was found: as declared, else from its records where they agree, else from the settings; ``conflict`` where the declaration and the records differ or the records differ among themselves, ``unknown`` without any."""
    return (
        F.when((n_in_records > 1) | (declared.isNotNull() & from_records.isNotNull() & (declared != from_records)), "conflict").when(declared.isNotNull(), F.concat(F.lit("declared:"), declared)).when(from_records.isNotNull(), F.concat(F.lit("records:"), from_records))
        .when(from_settings.isNotNull(), F.concat(F.lit("settings:"), from_settings)).otherwise("unknown")
    )


def soft_delete(index: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """``index`` with the rows of the given documents set inactive; nothing is removed."""
    gone = documents.select(key).distinct().withColumn("_gone", F.lit(True))
    return index.join(gone, key, "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def upsert_problems(index: DataFrame, delivered: DataFrame, vector: str) -> DataFrame:
    """``problem, n`` of a delivery: vectors of another dimension than the index, chunk ids twice, ids that belong to another document."""
    d = index.agg(F.max(F.size(vector)).alias("_d"))
    dim = delivered.join(F.broadcast(d), F.lit(True)).agg(F.count_if(F.size(vector) != F.col("_d")).alias("n")).select(F.lit("dimension").alias("problem"), "n")
    twice = delivered.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("problem"), "n")
    owner = index.where("active").select("chunk_id", F.col("document_id").alias("_owner")).distinct()
    foreign = delivered.join(owner, "chunk_id").where(F.col("_owner") != F.col("document_id")).agg(F.count("*").alias("n")).select(F.lit("foreign").alias("problem"), "n")
    return dim.unionByName(twice).unionByName(foreign)


def forced_contexts(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """Responses with the gold chunks (``item_key, chunk_key``) as their only context, and whether that changed anything: the upper bound of what a search could give; items without gold stay as they are."""
    g = gold.groupBy("item_key").agg(F.array_sort(F.collect_set("chunk_key")).alias("_g"))
    j = responses.join(g, "item_key", "left")
    return j.withColumns({"contexts": F.coalesce("_g", "contexts"), "retrieved": F.when(F.col("_g").isNull(), F.col("retrieved")).otherwise(F.array().cast("array<long>")), "forced": F.col("_g").isNotNull()}).drop("_g")
