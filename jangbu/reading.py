"""Queries that read documents: blocks, tables, chunks, extracted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jangbu.operators import chunking, extraction
from jangbu.registry import registered
from jangbu.runtime import table

#: Vocabulary files of public tokenizers, and how the one used splits a text.
TOKENIZER, SPLIT = "/opt/tokenizers/byte_bpe_50k.tiktoken", r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


@registered(r"""select chunk_key, (len(regexp_extract_all(lower(text), '<table\b')) > 0) as has_table from chunks where text is not null""")
def c01_outer_tables(spark, d):
    c = table(spark, d, "chunks").where("text is not null")
    return c.select("chunk_key", (F.size(chunking.tables_of("text")) > 0).alias("has_table"))


@registered()
def c02_blocks(spark, d):
    b = _texts(spark, d).select("doc_id", F.posexplode(chunking.blocks_of("text")).alias("i", "b"))
    return b.select("doc_id", "i", "b.first", "b.last", "b.kind")


@registered(r"""with t as (select chunk_key, text, (length(text) - length(replace(lower(text), '<table', '')))  as x from chunks where text is not null and len(regexp_extract_all(lower(text), '<table\b')) = 1 and len(regexp_extract_all(lower(text), '</table\s*>')) = 1 and ends_with(trim(lower(text)), '</table>') and starts_with(trim(lower(text)), '<table'))
  select chunk_key, len(regexp_extract_all(lower(text), '<tr\b'))::int as rows, len(regexp_extract_all(lower(text), '<t[dh]\b'))::int as cells from t""")
def c03_outer_cells(spark, d):
    """Rows and cells of chunks that are one HTML table; nested tables are tested apart."""
    c = table(spark, d, "chunks").where(r"text is not null and size(regexp_extract_all(lower(text), '(<table\\b)', 1)) = 1 and size(regexp_extract_all(lower(text), '(</table\\s*>)', 1)) = 1 and endswith(trim(lower(text)), '</table>') and startswith(trim(lower(text)), '<table')")
    return c.select("chunk_key", F.get(chunking.tables_of("text"), F.lit(0)).alias("t")).select("chunk_key", "t.rows", "t.cells")


@registered()
def c04_table_parts(spark, d):
    t = table(spark, d, "chunks").where("text is not null").select("chunk_key", F.explode(chunking.tables_of("text")).alias("t"))
    return t.select("chunk_key", "t.start", "t.rows", "t.header", "t.cells", "t.nested")


@registered()
def c07_packed_paragraphs(spark, d):
    p = _texts(spark, d).select("doc_id", F.posexplode(chunking.packed(F.split("text", r"\n\s*\n"), F.lit(600), F.lit(60))).alias("i", "piece"))
    return p.select("doc_id", "i", F.length("piece").alias("n_chars"))


@registered()
def c08_split_tables(spark, d):
    c = table(spark, d, "chunks").where("block_type = 'table' and text is not null").select("chunk_key", F.posexplode(chunking.table_pieces("text", F.lit(600))).alias("i", "piece"))
    return c.select("chunk_key", "i", F.length("piece").alias("n_chars"))


@registered()
def c09_headings_kept(spark, d):
    """Documents chunked whole: every markdown heading stands in a path or, if nothing stands under it, in a text."""
    t = _texts(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("document_id"), "title", "text")
    chunks = chunking.chunk_documents(t, 800, 80)
    heads = t.select("document_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("i", "line")).where(r"line rlike '^#{1,6} +\\S'").select("document_id", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("heading")).distinct()
    whole = chunks.groupBy("document_id").agg(F.array_join(F.collect_list(F.concat_ws("\n", "section", "text")), "\n").alias("all"))  # the chunks of one document
    j = heads.join(whole, "document_id", "left")
    return j.groupBy("document_id").agg(F.count("*").alias("n_headings"), F.count_if(F.contains(F.coalesce("all", F.lit("")), F.col("heading"))).alias("n_kept"))


@registered()
def c12_token_lengths(spark, d):
    return chunking.token_statistics(table(spark, d, "chunks"), "chunking_version", "text", TOKENIZER, SPLIT, 512)


# Extraction


@registered(r"""with l as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line from documents where text is not null) select doc_id, count(*) filter (where regexp_matches(line, '총\s?사\s?업\s?비|사\s?업\s?예\s?산|소\s?요\s?예\s?산|사\s?업\s?비|예\s?산')) as n_budget, count(*) filter (where regexp_matches(line, '지\s?역\s?제\s?한|지\s?역\s?의\s?무')) as n_region from l group by 1""")
def e01_label_lines(spark, d):
    """Lines that name a field, its letters spaced or not."""
    line = _texts(spark, d).select("doc_id", F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line"))
    n = lambda f: F.count_if(F.col("line").rlike(extraction.alias_pattern(f)))
    return line.groupBy("doc_id").agg(n("예산").alias("n_budget"), n("지역제한").alias("n_region"))


@registered()
def e03_hits(spark, d):
    """Every label hit with its value, in the line or in the block below, and whether it is usable."""
    h = _texts(spark, d).select("doc_id", F.explode(extraction.hits_of("text")).alias("h"))
    return h.select("doc_id", "h.field", "h.line", "h.value", "h.inline", "h.heading", "h.source", "h.usable", "h.reason")


@registered()
def e04_outlines(spark, d):
    o = _texts(spark, d).select("doc_id", F.explode(extraction.outline("text")).alias("o"))
    return o.select("doc_id", "o.line", "o.level", F.array_join("o.path", " > ").alias("path"), "o.source")


@registered()
def e08_external_references(spark, d):
    """What the field table's values refer to elsewhere, and whether they say anything else."""
    r = table(spark, d, "extraction_rows").where("answer_raw is not null").select("row_id", extraction.reference_of("answer_raw").alias("r"))
    return r.select("row_id", "r.target", "r.only")


@registered()
def e09_new_labels(spark, d):
    return extraction.new_labels(table(spark, d, "documents"))


@registered(r"""with l as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line from documents where text is not null) select doc_id, count(*) filter (where regexp_matches(line, '(?:[·.…]\s*){4,}\s*\d{1,3}\s*$|^\s*(?:\d+\.)+\d*\s+\S.{0,40}\s\d{1,3}\s*$')) as n_contents, count(*) filter (where regexp_matches(line, '(?:법률|법|시행령|시행규칙|규정|기준|예규|고시)」?\s*제\s*\d+\s*조|「[^」]{2,40}(?:법|령|규칙|기준)」')) as n_statutes from l group by 1""")
def e10_detectors(spark, d):
    line = _texts(spark, d).select("doc_id", F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line"))
    return line.groupBy("doc_id").agg(F.count_if(extraction.says_contents(F.col("line"))).alias("n_contents"), F.count_if(F.col("line").rlike(extraction.STATUTE.pattern)).alias("n_statutes"))


@registered()
def e11_document_rows(spark, d):
    """Twelve rows of every document."""
    e = extraction.extract(table(spark, d, "documents"))
    return e.select("doc_id", "field_name", "status", "answer_raw", "line", F.array_join("section", " > ").alias("section"), "source_type", "n_hits", "n_usable", F.size("others").alias("n_others"))


@registered()
def w07_heading_stacks(spark, d):
    """The stack of headings above every line that is none: its depth and its path."""
    p = _texts(spark, d).select("doc_id", F.explode(extraction.heading_stacks("text")).alias("h"))
    return p.select("doc_id", "h.first", "h.last", F.size("h.path").alias("depth"), F.array_join("h.path", " > ").alias("path"))
