"""Oversized texts cut at natural boundaries into pieces with a fixed overlap.

A text is a tree: sections nested by the depth of their headings, below them
blank-line paragraphs, lines (list items, pipe rows) or HTML rows, sentences,
words.  Only parts over the limit are opened; siblings are merged bottom-up as
long as the limit holds.  Only texts over their limit reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Smallest limit of a piece, whatever its prefix takes.
LEAST = 200

#: Lines that open a section, by depth: markdown headings, then numbered ones.
HEADING = re.compile(r"^(?:(#{1,6})[ \t]|([IVXⅠ-Ⅻ]+\.)[ \t]|(\d+\.)[ \t]|([가-하]\.)[ \t]).*$", re.M)
#: Where a part below the headings ends, by level of the tree; each match ends a part after itself.
LEVELS = (
    re.compile(r"\n[ \t\r]*\n+|</table>|(?<=>)\n(?=<table)", re.I),  # paragraphs, whole tables
    re.compile(r"</tr\s*>\s*|\r?\n(?!\n)|<br\s*/?>|(?=[○●■□◦▪※] )", re.I),  # rows, list items, lines
    re.compile(r"</t[dh]\s*>|(?<=[.!?。！？])[\"'”’)\]]*\s+|(?<=다\.)(?=\S)|[;。]\s*", re.I),  # sentences, cells
    re.compile(r"\s+|(?<=[,，、·|])(?=\S)"),  # words
)


@dataclass
class Node:
    """A part of the text: a section with its own ``parts``, or a block that is opened by the separators from ``level`` on."""

    start: int
    end: int
    parts: list[Node] = field(default_factory=list)
    level: int = 0


def tree(text: str) -> Node:
    """The text's sections by the depth of their headings; each holds its own block, then its subsections."""
    root = Node(0, len(text))
    path: list[tuple[int, Node]] = [(0, root)]
    for m in HEADING.finditer(text):
        depth = len(m[1]) if m[1] else 7 + next(k for k in range(3) if m[2 + k])
        while path[-1][0] >= depth:
            path.pop()[1].end = m.start()
        section = Node(m.start(), len(text))
        path[-1][1].parts.append(section)
        path.append((depth, section))
    stack = [root]
    while stack:
        node = stack.pop()
        stack += node.parts
        if node.parts and node.parts[0].start > node.start:
            node.parts.insert(0, Node(node.start, node.parts[0].start))
    return root


def _opened(text: str, node: Node) -> list[Node]:
    """The parts of a node: its sections, else what the first separators that cut it leave; a heading stays with what follows it."""
    if node.parts:
        return node.parts
    for level in range(node.level, len(LEVELS)):
        cuts = [m.end() for m in LEVELS[level].finditer(text, node.start, node.end) if node.start < m.end() < node.end]
        if level < 2 and cuts and (m := HEADING.match(text, node.start)):
            cuts = [c for c in cuts if text[m.end() : c].strip()]
        if cuts:
            edges = [node.start, *dict.fromkeys(cuts), node.end]
            return [Node(a, b, level=level + 1) for a, b in zip(edges, edges[1:], strict=False)]
    return []


def _hard(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters, none cut inside what reads as one character where that can be helped."""
    out = []
    while end - start > most:
        at = start + most
        while at > start + max(1, most // 2) and (unicodedata.combining(text[at]) or text[at] in "‍︎️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n" or "ᅠ" <= text[at] <= "ᇿ"):
            at -= 1
        out.append((start, at))
        start = at
    return [*out, (start, end)]


def spans(text: str, node: Node, most: int) -> list[tuple[int, int]]:
    """Adjacent spans of at most ``most`` characters that cover a node: only parts over it are opened, neighbours are merged as long as they fit."""
    if node.end - node.start <= most:
        return [(node.start, node.end)]
    parts = _opened(text, node)
    if not parts:
        return _hard(text, node.start, node.end, most)
    packed: list[tuple[int, int]] = []
    for part in parts:
        for a, b in spans(text, part, most):
            if packed and b - packed[-1][0] <= most:
                packed[-1] = (packed[-1][0], b)
            else:
                packed.append((a, b))
    return packed


def shared(limit: int, overlap: int) -> int:
    """Characters that consecutive pieces share: ``overlap``, at most one less than the limit, so that every piece adds something."""
    return max(0, min(overlap, limit - 1))


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces: each but the first starts ``shared`` characters before its predecessor's end; none is over ``limit``.

    The first piece is longer than what the second repeats of it: a shorter one
    is merged with the next span, which always fits.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    back = shared(limit, overlap)
    own = spans(text, tree(text), limit - back)
    while own[0][1] <= back:
        own[:2] = [(0, own[1][1])]
    return [(a - back if k else a, b) for k, (a, b) in enumerate(own)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [t[a:b] for a, b in pieces(t, int(n), int(o))] for t, n, o in zip(text, limit, overlap, strict=True)], dtype=object)


def limited(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """``chunk_key, text, limit, chunk_overlap``: limit is max(chunk_size - length(prefix) - 1, 200), the prefix being the title and the section path joined by " > ".

    Null titles and path elements are skipped.  A chunk without text or whose
    chunking version has no tag has no limit and is left out.
    """
    tag = F.broadcast(tags.select("chunking_version", "chunk_size", "chunk_overlap").where("chunk_size is not null").dropDuplicates(["chunking_version"]))
    prefix = F.concat_ws(" > ", "source_document_title", "section_path")
    limit = F.greatest(F.col("chunk_size") - F.length(prefix) - 1, F.lit(LEAST))
    return chunks.where("text is not null").join(tag, "chunking_version").select("chunk_key", "text", limit.alias("limit"), F.coalesce("chunk_overlap", F.lit(0)).alias("chunk_overlap"))


def split(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """``chunk_key, part, of, overlap, text``: every chunk in numbered pieces within its limit, one piece if it fits (also the empty text).

    Consecutive pieces share exactly ``overlap`` characters, so taking that many
    off each piece but the first gives back the text: ``chunk_overlap``, at most
    one less than the limit.  Texts that fit never reach Python, and the chunks
    are read once.
    """
    over = F.length("text") > F.col("limit")
    cut = limited(chunks, tags).withColumn("cut", _cut(F.when(over, F.col("text")), "limit", "chunk_overlap"))
    back = F.greatest(F.lit(0), F.least("chunk_overlap", F.col("limit") - 1))
    numbered = cut.select("chunk_key", F.posexplode(F.coalesce("cut", F.array("text"))).alias("i", "piece"), F.coalesce(F.size("cut"), F.lit(1)).alias("of"), back.cast("int").alias("overlap"))
    return numbered.select("chunk_key", (F.col("i") + 1).alias("part"), "of", "overlap", F.col("piece").alias("text"))


def oversize(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """``chunk_key`` of the chunks that had to be cut."""
    return split(chunks, tags).where("of > 1 and part = 1").select("chunk_key")
