"""Three-valued selection over a long field table: confirmed, undetermined, rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jangbu.functions.columns import STATUS_SETS, active, compare, plain_amount, region_restriction
from jangbu.operators import consortium

#: Fields numbers can be compared on.
NUMERIC_FIELDS = ("예산",)


#: Predicates on what a field's text means, by the field they are about.
MEANINGS = {"restricted": "지역제한", "unrestricted": "지역제한", "required": "컨소시엄 요건", "allowed": "컨소시엄 요건", "forbidden": "컨소시엄 요건"}


def meaning(operator: str, status: Column, text: Column) -> Column:
    """Whether a cell's text means what an operator asks for; undetermined without a value, and where the text does not say."""
    valued = F.when(status == "value_present", text)
    if operator in ("restricted", "unrestricted"):
        kind = region_restriction(valued)
        return F.when(valued.isNotNull() & (kind != "unknown"), (kind == "restricted") == F.lit(operator == "restricted"))
    said = consortium.classified(valued)
    return said["required"] if operator == "required" else said["allowed"] if operator == "allowed" else ~said["allowed"]


@dataclass(frozen=True)
class Condition:
    """One predicate on one field: a status set or a meaning (both may be negated), or a comparison of its amount."""

    field: str
    operator: str
    value: float | None = None
    negated: bool = False

    def __post_init__(self) -> None:
        if self.operator in MEANINGS:
            if self.field != MEANINGS[self.operator]:
                raise ValueError(f"{self.operator!r} is said of {MEANINGS[self.operator]!r}")
            return
        if self.operator not in STATUS_SETS and self.operator not in (">=", "<=", ">", "<", "=="):
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.operator not in STATUS_SETS:
            if self.negated:
                raise ValueError("only conditions on a status can be negated")
            if self.field not in NUMERIC_FIELDS:
                raise ValueError(f"{self.field!r} holds no numbers")
            if self.value is None:
                raise ValueError("a comparison needs a value")

    def on(self, status: Column, amount: Column, text: Column | None = None) -> Column:
        if self.operator in MEANINGS:
            hit = meaning(self.operator, status, text)
            return ~hit if self.negated else hit
        if self.operator in STATUS_SETS:
            hit = status.isin(*STATUS_SETS[self.operator])
            return ~hit if self.negated else hit
        return F.when(status == "value_present", compare(amount, self.operator, self.value))


def current_cells(rows: DataFrame) -> DataFrame:
    """The first active row (smallest ``row_id``) of every document and field."""
    cell = F.min_by(F.struct("status", "answer_raw", "answer_normalized", "row_id"), "row_id")
    return rows.where(active() & F.col("document_id").isNotNull()).groupBy("document_id", "field_name").agg(cell.alias("c")).select("document_id", "field_name", "c.*")


def scope(registry: DataFrame) -> DataFrame:
    """Eligible documents: one row per id that has an eligible registry row still held."""
    return registry.where("retrieval_eligible and deleted_at is null and document_id is not null").select("document_id").distinct()


def verdicts(rows: DataFrame, conditions: list[Condition], documents: DataFrame | None = None) -> DataFrame:
    """``document_id, verdict``: ``confirmed`` where every condition holds, ``undetermined`` where none fails and some cannot be told.

    Rejected documents are left out; no condition selects nothing.  A field
    without a row is undetermined.  One aggregation pivots all fields asked for.
    """
    if not conditions:
        return rows.select("document_id", F.lit(None).cast("string").alias("verdict")).limit(0)
    cells = current_cells(rows.where(F.col("field_name").isin(*{c.field for c in conditions})))
    fields = list(dict.fromkeys(c.field for c in conditions))
    wide = cells.groupBy("document_id").agg(
        *(F.max(F.when(F.col("field_name") == f, F.col("status"))).alias(f"s{i}") for i, f in enumerate(fields)),
        *(F.max(F.when(F.col("field_name") == f, F.coalesce(plain_amount(F.col("answer_normalized")), plain_amount(F.col("answer_raw"))))).alias(f"a{i}") for i, f in enumerate(fields)),
        *(F.max(F.when(F.col("field_name") == f, F.coalesce("answer_raw", "answer_normalized"))).alias(f"t{i}") for i, f in enumerate(fields)),
    )
    if documents is not None:
        wide = documents.join(wide, "document_id", "left")
    holds = None
    for c in conditions:
        i = fields.index(c.field)
        p = c.on(F.col(f"s{i}"), F.col(f"a{i}"), F.col(f"t{i}"))
        holds = p if holds is None else holds & p
    return wide.select("document_id", F.when(holds, "confirmed").when(holds.isNull(), "undetermined").alias("verdict")).where("verdict is not null")


def outcome(selected: DataFrame) -> DataFrame:
    """One row: counts and whether the selection matched, partly, only undetermined, or nothing."""
    n = selected.agg(F.count_if(F.col("verdict") == "confirmed").alias("n_confirmed"), F.count_if(F.col("verdict") == "undetermined").alias("n_undetermined"))
    c, u = F.col("n_confirmed"), F.col("n_undetermined")
    return n.select("n_confirmed", "n_undetermined", F.when((c > 0) & (u == 0), "matched").when(c > 0, "partial").when(u > 0, "undetermined_only").otherwise("empty").alias("outcome"))


def status_matrix(rows: DataFrame) -> DataFrame:
    """Documents per field and status of their current cells."""
    return current_cells(rows).groupBy("field_name", "status").agg(F.count("*").alias("n_documents"))


def lookup(rows: DataFrame, document_id: str, field: str) -> DataFrame:
    """The current cell of one document and field; both filters reach the scan."""
    return current_cells(rows.where((F.col("document_id") == document_id) & (F.col("field_name") == field)))


def grid(rows: DataFrame, documents: DataFrame, fields: list[str]) -> DataFrame:
    """Every document against every field with its status, ``missing`` where there is no row."""
    cells = current_cells(rows.where(F.col("field_name").isin(*fields)).join(documents, "document_id", "left_semi"))
    want = documents.select("document_id", F.explode(F.array(*map(F.lit, fields))).alias("field_name"))
    return want.join(cells, ["document_id", "field_name"], "left").select("document_id", "field_name", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("answer_normalized", "answer_raw").alias("value"))


def scope_split(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the registry in scope (retrievable and not withdrawn), and all others with the reason: no_id, withdrawn, duplicate or not_eligible."""
    ok = F.col("document_id").isNotNull() & F.coalesce(F.col("retrieval_eligible"), F.lit(False)) & F.col("deleted_at").isNull()
    why = F.when(F.col("document_id").isNull(), "no_id").when(F.col("deleted_at").isNotNull(), "withdrawn").when(F.col("duplicate_of_document_id").isNotNull(), "duplicate").otherwise("not_eligible")
    return registry.where(ok), registry.where(~ok).withColumn("reason", why)


def id_lists(registry: DataFrame) -> DataFrame:
    """``document_id, list``: ``included`` where any row of the document is in scope, else ``excluded``; one row per id."""
    inside, _ = scope_split(registry)
    return registry.where("document_id is not null").select("document_id").distinct().join(inside.select("document_id").distinct().withColumn("_in", F.lit(True)), "document_id", "left").select("document_id", F.when(F.col("_in"), "included").otherwise("excluded").alias("list"))


def selection_inputs(registry: DataFrame, identity_records: DataFrame, rows: DataFrame) -> DataFrame:
    """``document_id, in_registry, in_identity, in_table, usable`` of every document any of the three names; usable are those all three hold, in scope."""
    ids = lambda df, name: df.where("document_id is not null").select("document_id").distinct().withColumn(name, F.lit(True))
    j = ids(registry, "r").join(ids(identity_records, "i"), "document_id", "full_outer").join(ids(rows, "t"), "document_id", "full_outer").join(scope(registry).withColumn("s", F.lit(True)), "document_id", "left")
    held = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select("document_id", held("r").alias("in_registry"), held("i").alias("in_identity"), held("t").alias("in_table"), (held("s") & held("i") & held("t")).alias("usable"))


def manifest(batches: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """One row per batch from three sources: what the batch states, what was delivered in it, and how many of its documents an extraction run covers."""
    r = records.groupBy("batch_no").agg(F.count("*").alias("n_records"), F.countDistinct("document_id").alias("n_documents"), F.count_if(F.lower(F.trim("metadata_found")).isin("true", "1", "yes")).alias("n_with_metadata"))
    covered = records.where("document_id is not null").select("batch_no", "document_id").distinct().join(files.select("document_id").where("document_id is not null").distinct(), "document_id").groupBy("batch_no").agg(F.count("*").alias("n_covered"))
    j = batches.join(r, "batch_no", "left").join(covered, "batch_no", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("batch_no", "doc_count", F.size(F.coalesce("duplicate_doc_ids", F.array().cast("array<string>"))).alias("n_duplicates"), zero("n_records"), zero("n_documents"), zero("n_with_metadata"), zero("n_covered"))
