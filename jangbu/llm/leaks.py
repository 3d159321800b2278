"""Evaluation texts inside a corpus, found through a distributed positional inverted index.

The index holds where in a document each term stands: terms are the words of the
items, positions count letters and digits only, so that spacing, markup,
punctuation, case and the form of characters do not matter.  A word counts where
it stands free, or, inside longer stretches, where its neighbour in the item
stands right beside it: that is, where both lists, taken back by the words'
offsets in the item, hold the same number.  Everything is worked out from the
stored positions; texts are read once, to be indexed.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jangbu.llm.lookalike import by_table
from jangbu.runtime import broadcast_if_small, cut

#: Share of an item's words, in order, that makes a leak.
SHARE = 0.5
#: Share of an item's words, the most frequent in the corpus, that are looked up only for documents that hold enough of the rarer ones.
LATE = 0.25
#: Candidates up to which they, and not the index, travel to be joined.
FEW = 200_000

_TAG = re.compile(r"<[^<>]{1,300}>")
_SIGNS = re.compile(r"[\W_]+")
_IN_NUMBER = re.compile(r"(?<=\d)[.,:](?=\d)")
_PLAIN = re.compile(r"[\x20-\x7e\n\r\t가-힣]*")


def clean(text: str) -> str:
    """Text without markup, in one form of characters, lower case."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not _PLAIN.fullmatch(text):
        text = by_table(text)
    return text.lower()


def dense(text: str) -> str:
    """Letters and digits only."""
    return _SIGNS.sub("", clean(text))


def pieces(text: str) -> tuple[str, set[int]]:
    """Letters and digits only, and the positions in them at which blanks or signs stood (not those inside a number), both ends included."""
    parts = _SIGNS.split(_IN_NUMBER.sub("", clean(text)))
    return "".join(parts), {0, *accumulate(map(len, parts))}


def words(text: str) -> list[str]:
    return [w for w in (_SIGNS.sub("", x) for x in clean(text).split()) if w]


def in_line(at: dict[int, list[int]], sizes: list[int]) -> int:
    """Most words of an item that stand in a document in its order, whatever stands between.

    ``at`` gives for the i-th word of the item its places, twice the position and
    1 more where it stands free; ``sizes`` are the words' lengths.  Of words that
    do not stand free only those count that stand right beside a neighbour.
    """
    start = list(accumulate(sizes, initial=0))
    line = {i: {(x >> 1) - start[i] for x in xs} for i, xs in at.items()}  # positions less the word's offset: equal along a phrase
    none: set[int] = set()
    ends: list[int] = []  # the least end of a chain of 1, 2, ... words
    for i in sorted(at):
        beside = line.get(i - 1, none) | line.get(i + 1, none)
        places = {x >> 1 for x in at[i] if x & 1 or (x >> 1) - start[i] in beside}
        for n, b in [(bisect_right(ends, a), a + sizes[i]) for a in places]:
            if n == len(ends):
                ends.append(b)
            elif b < ends[n]:
                ends[n] = b
    return len(ends)


class Terms:
    """The words of the items as terms, and the scan of a text for them."""

    def __init__(self, items: Iterable[list[str]]) -> None:
        items = list(items)
        self.words = sorted({w for item in items for w in item})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.after: dict[int, set[int]] = defaultdict(set)  # terms that follow a term in some item
        for item in items:
            for x, y in zip(item, item[1:], strict=False):
                self.after[self.number[x]].add(self.number[y])
        self.automaton = None

    def scan(self, text: str) -> dict[int, list[int]]:
        """Places of every term, twice the position and 1 more where it stands free between blanks or signs; other places only beside a term that follows or is followed in an item."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for w, k in self.number.items():
                self.automaton.add_word(w, (k, len(w)))
            self.automaton.make_automaton()
        dense, edges = pieces(text)
        hits = [(end - n + 1, end + 1, k) for end, (k, n) in self.automaton.iter(dense)]
        starts: dict[int, set[int]] = defaultdict(set)
        for a, _, k in hits:
            starts[a].add(k)
        beside = set()
        for a, b, k in hits:
            for other in self.after[k] & starts[b] if b in starts and k in self.after else ():
                beside.add((a, k))
                beside.add((b, other))
        out: dict[int, list[int]] = {}
        for a, b, k in hits:
            free = a in edges and b in edges
            if free or (a, k) in beside:
                out.setdefault(k, []).append(2 * a + free)
        return out


def in_order(item: list[str], text: str, edges: set[int]) -> int:
    """``in_line`` of one item in one text (``pieces``), looked for word by word."""

    def places(w: str) -> Iterator[int]:
        a = text.find(w)
        while a >= 0:
            yield 2 * a + (a in edges and a + len(w) in edges)
            a = text.find(w, a + 1)

    return in_line({i: list(places(w)) for i, w in enumerate(item)}, [len(w) for w in item])


def index(documents: DataFrame, terms: Terms) -> DataFrame:
    """``doc_id, term, places`` of every term of every document (null texts have none), one row per document and term."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, term, places = [], [], []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                for k, xs in terms.scan(text).items():
                    doc.append(key)
                    term.append(k)
                    places.append(np.array(xs, np.int32))
            yield pd.DataFrame({"doc_id": np.array(doc, np.int64), "term": np.array(term, np.int32), "places": pd.Series(places, dtype=object)})

    return documents.where("doc_id is not null and text <> ''").select("doc_id", "text").mapInPandas(scan, "doc_id long, term int, places array<int>")


def leaks(documents: DataFrame, heldout_items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_words, n_found``: documents that contain at least ``SHARE`` of an item's words in its order.

    Items without text or words leak nowhere.  The items, a fixed set, reach the
    driver and every worker; nothing of the corpus does but the number of
    documents of each of their words.  The lists of an item's rarer words are
    intersected first: a leak holds ``SHARE`` of all words, hence at least that
    number less the ``LATE`` most frequent ones among the others.
    """
    spark = documents.sparkSession
    items = {r.item_id: words(r.text) for r in heldout_items.where("item_id is not null and text is not null").select("item_id", "text").collect()}  # fixed: 120 rows
    items = {k: w for k, w in items.items() if w}
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_found", T.IntegerType())])
    if not items:
        return spark.createDataFrame([], out)
    terms = Terms(items.values())
    stored = cut(index(documents, terms))
    df = {r.term: r.n for r in stored.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row per word of the items
    places = []
    for k, item in items.items():
        order = sorted(range(len(item)), key=lambda i, item=item: (df.get(terms.number[item[i]], 0), i))
        late = int(LATE * len(item))
        least = max(1, -int(-SHARE * len(item) // 1) - late)
        places += [(k, terms.number[item[i]], i, len(item), rank >= len(item) - late, least) for rank, i in enumerate(order)]
    of_item = F.broadcast(spark.createDataFrame(places, "item_id long, term int, i int, n_words int, late boolean, least int"))  # as many rows as the items have words
    rare = stored.select("doc_id", "term").join(of_item.where("not late"), "term")
    candidates = cut(rare.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("doc_id", "item_id"))
    sizes = {k: [len(w) for w in item] for k, item in items.items()}

    @F.pandas_udf(T.IntegerType())
    def found(item_id: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([in_line({h["i"]: h["places"] for h in hs}, sizes[k]) if len(hs) >= SHARE * len(sizes[k]) else 0 for k, hs in zip(item_id, hits, strict=True)], dtype="int32")

    lists = stored.join(broadcast_if_small(candidates, FEW), "doc_id").join(of_item.select("item_id", "term", "i", "n_words"), ["item_id", "term"])
    whole = lists.groupBy("doc_id", "item_id", "n_words").agg(F.collect_list(F.struct("i", "places")).alias("hits"))  # at most the items' words a group
    return whole.select("doc_id", "item_id", "n_words", found.asNondeterministic()("item_id", "hits").alias("n_found")).where(F.col("n_found") >= SHARE * F.col("n_words")).select(*out.names)
