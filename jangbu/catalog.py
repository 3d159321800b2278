"""Registered queries of the core data-repair operators, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jangbu.operators import orphans, schema_drift, timestamps, units
from jangbu.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.disagreeing(table(spark, d, "extraction_rows"))


def p1_quantities(spark: SparkSession, d: str) -> DataFrame:
    return units.quantities(table(spark, d, "extraction_rows"))


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    return orphans.dangling(table(spark, d, "evaluation_items"), table(spark, d, "approved_memory"), table(spark, d, "registry"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).drop("at")


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_dangling(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.same_instant_pairs(table(spark, d, "identity_records"), table(spark, d, "collection_systems"))


def p4_instants(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised(table(spark, d, "identity_records"), table(spark, d, "collection_systems")).select("record_id", "field_name", "instant", "time_issue")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "metadata_files"))


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.table(table(spark, d, "metadata_files"))


def p7_unknown(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unknown_fields(table(spark, d, "metadata_files"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_quantities, p3_found, p3_by_month, p4_found, p4_instants, p7_found, p7_table, p7_unknown)}


_REFS = r"""
with refs as (
  select 'evaluation_items' as source_table, item_key as row_key, 'document_id' as field_name, document_id as id, created_at as t from evaluation_items
  union all select 'evaluation_items', item_key, 'location.document', location.document, created_at from evaluation_items
  union all select 'evaluation_items', item_key, 'evidence.location.document', e.location.document, created_at from (select item_key, created_at, unnest(evidence) as e from evaluation_items)
  union all select 'approved_memory', memory_key, 'approved_plan.document_ids', x, reviewed_at from (select memory_key, reviewed_at, unnest(approved_plan.document_ids) as x from approved_memory)),
named as (
  select distinct source_table, row_key, field_name, upper(regexp_replace(id, '^\s+|\s+$', '', 'g')) as document_id, t
  from refs where id is not null and regexp_replace(id, '\s', '', 'g') <> ''),
dangling as (
  select * from named n where not exists (
    select 1 from registry r where upper(trim(r.document_id)) = n.document_id and r.registered_at <= n.t and (r.deleted_at is null or n.t < r.deleted_at)))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _REFS + "select source_table, row_key, field_name, document_id from dangling",
        "p3_by_month": _REFS + "select source_table, field_name, strftime(t, '%Y-%m') as period, count(*) as n_references, count(distinct document_id) as n_documents from dangling group by 1, 2, 3",
    }
