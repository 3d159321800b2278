"""Encoding of a corpus with a public byte-level tokenizer.

Frequent words, each with the blank before it, are compiled with their ids into a
minimal acyclic automaton: suffixes are shared, and the count of words below each
arc numbers the words, which indexes the id lists.  It is one flat buffer that
every Python worker maps; words it does not hold are merged exactly by rank.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jangbu.runtime import share_file

TOKENIZERS = "/opt/tokenizers"
# Fixed value: how byte_bpe_50k splits a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE = re.compile(r"\s ")
#: Most words the automaton holds.  Others are merged; the ids are the same.
LEXICON = 30_000
#: Words a worker keeps the ids of, before it forgets them all.
MEMO = 200_000


def read_ranks(directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is joined, the leftmost first, until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    rank = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        at, least = -1, None
        for i, r in enumerate(rank):
            if r is not None and (least is None or r < least):
                at, least = i, r
        if at < 0:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del rank[at]
        if at:
            rank[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(rank):
            rank[at] = ranks.get(parts[at] + parts[at + 1])


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """``merge`` with a heap over a linked list, for words of very many bytes."""
    import heapq

    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or parts[i] + parts[j] != pair:
            continue
        parts[i], alive[j], right[i] = pair, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p, ok in zip(parts, alive, strict=True) if ok]


class Lexicon:
    """Minimal acyclic automaton over words' bytes with a list of ids per word, in flat arrays."""

    def __init__(self, first: np.ndarray, label: np.ndarray, target: np.ndarray, before: np.ndarray, final: np.ndarray, start: np.ndarray, ids: np.ndarray) -> None:
        # lists index faster than arrays where a word is walked byte by byte
        self.first, self.label, self.target, self.before, self.final, self.start, self.ids = first, bytes(label), target, before, final, start, ids

    @classmethod
    def of(cls, words: dict[bytes, list[int]]) -> Lexicon:
        return cls(**cls.build(words))

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
        """Arrays of the automaton: words are added in order, finished states are registered by what follows them, equal ones shared."""
        register: dict[tuple, int] = {}
        final: list[bool] = []
        arcs: list[tuple[tuple[int, int], ...]] = []
        below: list[int] = []
        path: list[tuple[list[tuple[int, int]], bool]] = [([], False)]  # open states of the last word
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                out, ends = path.pop()
                key = (ends, tuple(out))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(arcs)
                    arcs.append(key[1])
                    final.append(ends)
                    below.append(int(ends) + sum(below[t] for _, t in out))
                path[-1][0].append((last[len(path) - 1], state))

        order = sorted(words)
        for w in order:
            k = 0
            while k < min(len(w), len(last)) and w[k] == last[k]:
                k += 1
            close(k)
            path.extend(([], False) for _ in w[k:])
            path[-1] = (path[-1][0], True)
            last = w
        close(0)
        arcs.append(tuple(path[0][0]))
        final.append(path[0][1])
        first = np.zeros(len(arcs) + 1, np.int32)
        first[1:] = np.cumsum([len(a) for a in arcs])
        before = [n for s, a in enumerate(arcs) for n in np.cumsum([int(final[s]), *(below[t] for _, t in a)])[:-1]]
        lengths = [len(words[w]) for w in order]
        return {
            "first": first,
            "label": np.array([c for a in arcs for c, _ in a], np.uint8),
            "target": np.array([t for a in arcs for _, t in a], np.int32),
            "before": np.array(before, np.int32),
            "final": np.array(final, np.uint8),
            "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32),
            "ids": np.array([i for w in order for i in words[w]], np.int32),
        }

    def find(self, word: bytes) -> list[int] | None:
        """Ids of ``word``, or None if the automaton does not hold it."""
        first, label, target, before = self.first, self.label, self.target, self.before
        state, n = len(self.final) - 1, 0
        for c in word:
            i = label.find(c, first[state], first[state + 1])
            if i < 0:
                return None
            n += before[i]
            state = target[i]
        if not self.final[state]:
            return None
        return self.ids[self.start[n] : self.start[n + 1]].tolist()


_FIELDS = ("first", "label", "target", "before", "final", "start", "ids")


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One flat buffer: the lengths of the arrays, then the arrays."""
    head = np.array([len(arrays[f]) for f in _FIELDS], np.int64)
    return head.tobytes() + b"".join(arrays[f].astype(np.int32).tobytes() for f in _FIELDS)


def unpack(buffer: bytes | np.memmap) -> Lexicon:
    head = np.frombuffer(buffer, np.int64, len(_FIELDS))
    at, out = head.nbytes, {}
    for f, n in zip(_FIELDS, head, strict=True):
        out[f] = np.frombuffer(buffer, np.int32, n, at)
        at += 4 * int(n)
    out["label"] = out["label"].astype(np.uint8)
    return Lexicon(**out)


def words_of(text: str, split: re.Pattern | None = None) -> list[str]:
    """``text`` in parts that are encoded apart: cut before every single blank between two other characters.

    No word of ``PATTERN`` reaches over such a cut.  Where a blank follows other
    white space the whole text is one part, unless ``split`` (``PATTERN``) is
    given to cut it.
    """
    if _WIDE.search(text):
        return split.findall(text) if split else [text]
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))


def frequent(texts: DataFrame, most: int) -> list[str]:
    """The ``most`` most frequent words of all texts, of those that occur twice, ties in order of the words."""
    import regex

    split = regex.compile(PATTERN)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                c.update(w for w in words_of(t, split) if len(w) <= 64)
            if len(c) > MEMO:
                yield counted(c)
                c.clear()
        yield counted(c)

    def counted(c: Counter[str]) -> pd.DataFrame:
        return pd.DataFrame({"word": list(c), "n": list(c.values())}).astype({"word": object, "n": "int64"})

    texts = texts.where("text <> ''").select("text")
    n = texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in n.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()]


class Words(dict):
    """Ids of words by word: from the lexicon, else merged exactly."""

    def __init__(self, held: Lexicon, ranks: dict[bytes, int]) -> None:
        import regex

        self.held, self.ranks, self.split = held, ranks, regex.compile(PATTERN)

    def __missing__(self, word: str) -> list[int]:
        found = self.held.find(word.encode())
        if found is None:
            found = [i for w in self.split.findall(word) for i in merge(w.encode(), self.ranks)]
        if len(word) <= 64:
            self[word] = found
        return found


def encode(documents: DataFrame, directory: str = TOKENIZERS, name: str = "byte_bpe_50k", lexicon: int = LEXICON, key: str = "doc_id") -> DataFrame:
    """``doc_id, ids``: every text as the tokenizer's ids, without special tokens.

    Null and empty texts give an empty list.  Names of special tokens in a text
    are ordinary text.  Whole texts are encoded, of any length.
    """
    spark = documents.sparkSession
    ranks = read_ranks(directory, name)
    none = Words(Lexicon.of({}), ranks)
    words = {w.encode(): none[w] for w in frequent(documents, lexicon)}
    file = share_file(spark, pack(Lexicon.build(words)), "lexicon")  # at most ``lexicon`` words
    table = spark.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(unpack(np.memmap(SparkFiles.get(file), np.uint8, "r")), table.value)
        for b in batches:
            ends, flat = [0], array("i")
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(known.__getitem__, words_of(t, known.split))))
                ends.append(len(flat))
            if len(known) > MEMO:
                known.clear()
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    out = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(key, "text").mapInArrow(ids_of, out)
