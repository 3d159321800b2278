"""Questions bound to documents: names inside questions, longest match first, never a silent choice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jangbu.functions.columns import expression_key
from jangbu.runtime import cut

#: Most names of a fixed list that are matched by one automaton.
LISTED = 200_000
#: Most keys of a list of any size that pass the driver, for one automaton; of more, only counts and marks of fixed size do.
GROUP = 20_000
#: Characters of the n-grams by which texts and keys meet; shorter keys are left out.
GRAM = 4


#: Places counted in, and bits of the marks, by which texts leave out what no key begins with or is met by.
PLACES, BITS = 1 << 21, 1 << 25
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _prefixes(words: list[str], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``n``, numbers and hashes of the words' first ``n`` characters, for every ``n`` from ``least`` on."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(length) - length
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at, h = np.flatnonzero(length > 0), np.zeros(len(words), np.uint64)
    n = 0
    while len(at):
        h[at] = (h[at] ^ code[begin[at] + n]) * _FACTOR
        h[at] ^= h[at] >> np.uint64(29)
        n += 1
        if n >= least:
            yield n, at, h[at]
        at = at[length[at] > n]


def _gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct ``GRAM``-grams of every text, none for shorter ones."""
    n = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)) - (GRAM - 1), 0)
    row = np.repeat(np.arange(len(texts)), n)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(row), np.uint64)
    for k in range(GRAM):
        h = (h ^ code[begin + k]) * _FACTOR
        h ^= h >> np.uint64(29)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[first], h[first]


def _gathered(df: DataFrame, column: str, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, list[str]], None], join: np.ufunc) -> bytes:
    """One array of fixed size that every value of a column was added to; the driver gets that alone."""
    kind = start().dtype

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = start()
        for b in batches:
            add(out, b[column].tolist())
        yield pd.DataFrame({"part": [out.tobytes()]})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = start()
        for b in batches:
            for x in b["part"]:
                join(out, np.frombuffer(x, kind), out=out)
        yield pd.DataFrame({"part": [out.tobytes()]})

    return bytes(df.select(column).coalesce(4).mapInPandas(gather, "part binary").repartition(1).mapInPandas(fold, "part binary").first().part)


def _mark(marks: np.ndarray, h: np.ndarray) -> None:
    at = h % np.uint64(BITS)
    np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(BITS)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def name_keys(identity_records: DataFrame) -> DataFrame:
    """``kind, key, document_id``: every document's buyer and project as compared, keys under four characters left out."""
    named = identity_records.where("document_id is not null").select("document_id", F.explode(F.array(F.struct(F.lit("org").alias("kind"), F.col("buyer_org").alias("name")), F.struct(F.lit("project").alias("kind"), F.col("project_name").alias("name")))).alias("n"))
    return named.select(F.col("n.kind").alias("kind"), expression_key(F.col("n.name")).alias("key"), "document_id").where("length(key) >= 4").distinct()


def contained(texts: DataFrame, keys: DataFrame, text_id: str, text: str) -> DataFrame:
    """``text_id, key``: keys of at least ``GRAM`` characters that stand inside a text.

    Up to ``GROUP`` keys travel to the texts as one automaton.  More are gathered
    nowhere: both sides meet on a key's rarest n-gram (by counts of hashes, which
    only choose it).  Texts leave out n-grams that no key is met by, so that only
    the texts' numbers and those n-grams are shuffled, and the texts are fetched
    for what met.
    """
    distinct = keys.select("key").where(F.length("key") >= GRAM).distinct()
    t = texts.where(F.col(text).isNotNull()).select(text_id, F.col(text).alias("_t"))
    if distinct.limit(GROUP + 1).count() <= GROUP:
        return _found(t, [r.key for r in distinct.collect()], text_id)
    distinct = cut(distinct)
    sc, kind = texts.sparkSession.sparkContext, texts.schema[text_id].dataType.simpleString()
    held = sc.broadcast(_gathered(distinct, "key", lambda: np.zeros(PLACES, np.int32), lambda n, ks: np.add.at(n, (_gram_hashes(ks)[1] % np.uint64(PLACES)).astype(np.int64), 1), np.add))

    def rarest(keys: list[str]) -> np.ndarray:
        row, h = _gram_hashes(keys)
        n = np.frombuffer(held.value, np.int32)[(h % np.uint64(PLACES)).astype(np.int64)]
        order = np.lexsort((h, n, row))
        return h[order][np.searchsorted(row, np.arange(len(keys)))]

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"gram": rarest(b["key"].tolist()).astype(np.int64), "key": b["key"]})

    marks = sc.broadcast(_gathered(distinct, "key", lambda: np.zeros(BITS // 8, np.uint8), lambda m, ks: _mark(m, rarest(ks)), np.bitwise_or))

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            row, h = _gram_hashes(b["_t"].tolist())
            good = _marked(m, h)
            yield pd.DataFrame({text_id: b[text_id].to_numpy()[row[good]], "gram": h[good].astype(np.int64)})

    met = t.mapInPandas(known, f"{text_id} {kind}, gram long").join(distinct.mapInPandas(anchors, "gram long, key string").hint("merge"), "gram").select(text_id, "key")
    return met.join(t.hint("merge"), text_id).where(F.contains("_t", "key")).select(text_id, "key").distinct()


def _found(texts: DataFrame, keys: list[str], text_id: str) -> DataFrame:
    """``text_id, key`` of the keys in the texts (``_t``), by one automaton in every worker."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)
    kind = texts.schema[text_id].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k in shared.value:
            a.add_word(k, k)
        if not len(a):
            return
        a.make_automaton()
        for b in batches:
            rows = [(i, k) for i, t in zip(b[text_id], b["_t"], strict=True) for k in {k for _, k in a.iter(t)}]
            yield pd.DataFrame(rows, columns=[text_id, "key"]).astype({text_id: b[text_id].dtype})

    return texts.mapInPandas(find, f"{text_id} {kind}, key string").distinct()


def mentions(questions: DataFrame, keys: DataFrame, text: str = "question", question_id: str = "question_id") -> DataFrame:
    """``question_id, key``: keys a question contains, without those inside a longer key found there."""
    q = questions.select(question_id, expression_key(F.col(text)).alias("q"))
    all_keys = contained(q, keys, question_id, "q").groupBy(question_id).agg(F.collect_set("key").alias("ks"))  # the names in one question
    return all_keys.select(question_id, F.explode(without_subsumed(F.col("ks"))).alias("key"))


def without_subsumed(keys: Column) -> Column:
    """Keys without those that stand inside another of them."""
    return F.filter(keys, lambda k: ~F.exists(keys, lambda o: (o != k) & F.contains(o, k)))


#: What the names of organisations end in, and what may stand behind a name in a question.
ORGANISATION_ENDS = "공사|공단|재단|진흥원|연구원|의료원|교육청|교육지원청|시청|군청|구청|도청|테크노파크|대학교|산학협력단|박물관|도서관|센터|본부|연합회"


def unknown_organisations(questions: DataFrame, names: DataFrame, text: str = "question", question_id: str = "question_id") -> DataFrame:
    """``question_id, word``: words of a question that end like an organisation's name and stand in no known name (``name``), nor hold one."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"([가-힣A-Za-z0-9]{{2,}}(?:{ORGANISATION_ENDS}))"), F.lit(1)))).alias("word")
    w = questions.select(question_id, word).withColumn("key", expression_key(F.col("word")))
    known = names.select(expression_key(F.col("name")).alias("name")).where("length(name) >= 4").distinct()
    inside = contained(known, w.select("key"), "name", "name").select("key").distinct()
    holding = contained(w.select("key", F.col("key").alias("t")).distinct().withColumnRenamed("key", "word_key"), known.select(F.col("name").alias("key")), "word_key", "t").select(F.col("word_key").alias("key")).distinct()
    return w.where(F.length("key") >= GRAM).join(inside.unionByName(holding).distinct(), "key", "left_anti").select(question_id, "word")


def titles_in_order(questions: DataFrame, identity_records: DataFrame, text: str = "question", question_id: str = "question_id") -> DataFrame:
    """``question_id, document_id``: documents all words of whose project name (two at least) stand in a question in their order.

    A title meets the questions in which a word begins with its rarest word; other
    beginnings of words leave the questions' rows before anything is shuffled.  No
    join sends a table through the driver.
    """
    words = F.filter(F.split(F.regexp_replace(F.col("project_name"), r"[^0-9A-Za-z가-힣]+", " "), " "), lambda w: F.length(w) >= 2)
    titles = identity_records.where("document_id is not null and project_name is not null").select("document_id", words.alias("ws")).distinct().where("size(ws) >= 2")
    each = titles.select("ws").distinct().select("ws", F.explode(F.array_distinct("ws")).alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    anchor = each.join(df.hint("merge"), "w").groupBy("ws").agg(F.min(F.struct("df", "w")).alias("a")).select("ws", F.col("a.w").alias("begin"))
    q = questions.where(F.col(text).isNotNull()).select(question_id, F.col(text).alias("_q"))
    anchor = cut(anchor)
    marks = questions.sparkSession.sparkContext.broadcast(_gathered(anchor, "begin", lambda: np.zeros(BITS // 8, np.uint8), lambda m, ws: [_mark(m, h[np.fromiter((len(ws[i]) == n for i in at.tolist()), bool, len(at))]) for n, at, h in _prefixes(ws, 2)], np.bitwise_or))

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            word, of = [], []
            for k, t in enumerate(b["_q"]):
                for w in {w for w in re.split(r"[^0-9A-Za-z가-힣]+", t) if len(w) >= 2}:
                    word.append(w)
                    of.append(k)
            found = {(of[i], word[i][:n]) for n, at, h in _prefixes(word, 2) for i in at[_marked(m, h)].tolist()}
            rows = [k for k, _ in found]
            yield pd.DataFrame({question_id: b[question_id].to_numpy()[rows], "_q": b["_q"].to_numpy()[rows], "begin": [w for _, w in found]})

    kind = questions.schema[question_id].dataType.simpleString()
    pattern = F.concat(F.lit("(?s)"), F.array_join(F.transform("ws", lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), ".*"))
    found = q.mapInPandas(begins, f"{question_id} {kind}, _q string, begin string").join(anchor.hint("merge"), "begin").where(F.regexp_like(F.col("_q"), pattern)).select(question_id, "ws").distinct()
    return found.join(titles.hint("merge"), "ws").select(question_id, "document_id").distinct()


def sweep(identity_records: DataFrame) -> DataFrame:
    """``phrasing, outcome, right, n``: every document asked for in several true phrasings of its names and two made-up ones, and what the resolver makes of them."""
    names = identity_records.where("document_id is not null and buyer_org is not null and project_name is not null").groupBy("document_id").agg(F.min(F.struct("record_id", "buyer_org", "project_name")).alias("n")).select("document_id", "n.buyer_org", "n.project_name")
    o, p = F.col("buyer_org"), F.col("project_name")
    forms = {
        "both": F.concat(o, F.lit(" "), p, F.lit("의 예산은?")), "project": F.concat(p, F.lit(" 예산 알려줘")), "organisation": F.concat(o, F.lit(" 사업의 마감일은?")), "turned": F.concat(p, F.lit(", "), o, F.lit(" 건")), "unspaced": F.concat(F.regexp_replace(o, " ", ""), F.regexp_replace(p, " ", ""), F.lit(" 예산")),
        "made_up_project": F.concat(F.reverse(p), F.lit(" 예산은?")), "made_up_both": F.concat(F.reverse(o), F.lit(" "), F.reverse(p)),
    }
    q = names.select("document_id", F.explode(F.array(*(F.struct(F.lit(k).alias("phrasing"), v.alias("question")) for k, v in forms.items()))).alias("f")).select(F.col("document_id").alias("asked"), "f.phrasing", "f.question").withColumn("question_id", F.xxhash64("asked", "phrasing"))
    r = resolve(q, name_keys(identity_records)).join(q.select("question_id", "asked", "phrasing"), "question_id")
    return r.groupBy("phrasing", "outcome", F.coalesce(F.col("document_id") == F.col("asked"), F.lit(False)).alias("right")).agg(F.count("*").alias("n"))


def resolve(questions: DataFrame, keys: DataFrame, text: str = "question", question_id: str = "question_id") -> DataFrame:
    """``question_id, outcome, document_id``: ``org_and_project`` or ``project`` or ``org`` where exactly one document is meant, ``ambiguous`` where several are, ``conflict`` where organisation and project share none, ``none``."""
    # of a set of documents only its least and greatest matter: one, or several; no question meets all documents of an organisation
    ends = lambda c, when=None: [f(F.when(when, F.col(c)) if when is not None else F.col(c)) for f in (F.min, F.max)]
    is_org, is_project = F.col("kind") == "org", F.col("kind") == "project"
    per_key = keys.groupBy("key").agg(*(e.alias(a) for a, e in zip(("o1", "o2", "p1", "p2"), ends("document_id", is_org) + ends("document_id", is_project), strict=True)))
    org, project = (keys.where(w).select("document_id", F.col("key").alias(a)) for w, a in ((is_org, "org"), (is_project, "project")))
    per_pair = org.join(project.hint("merge"), "document_id").groupBy("org", "project").agg(*(e.alias(a) for a, e in zip(("b1", "b2"), ends("document_id"), strict=True)))
    hit = mentions(questions, keys, text, question_id).join(per_key.hint("merge"), "key")
    by = hit.groupBy(question_id).agg(
        F.min("o1").alias("o1"), F.max("o2").alias("o2"), F.min("p1").alias("p1"), F.max("p2").alias("p2"),
        F.collect_set(F.when(F.col("o1").isNotNull(), F.col("key"))).alias("orgs"), F.collect_set(F.when(F.col("p1").isNotNull(), F.col("key"))).alias("projects"),
    )
    by = cut(by)
    said = by.where("size(orgs) > 0 and size(projects) > 0").select(question_id, F.explode("orgs").alias("org"), "projects").select(question_id, "org", F.explode("projects").alias("project"))
    both = said.join(per_pair.hint("merge"), ["org", "project"]).groupBy(question_id).agg(F.min("b1").alias("d_both"), F.max("b2").alias("b2"))
    number = lambda a, b: F.when(F.col(a).isNull(), 0).when(F.col(a) == F.col(b), 1).otherwise(2)
    n = by.join(both.hint("merge"), question_id, "left").select(
        question_id, number("o1", "o2").alias("orgs"), number("p1", "p2").alias("projects"), number("d_both", "b2").alias("both"), "d_both", F.col("p1").alias("d_project"), F.col("o1").alias("d_org")
    )
    j = questions.select(question_id).join(n.hint("merge"), question_id, "left")
    outcome = (
        F.when(F.col("orgs").isNull(), "none").when(F.col("both") == 1, "org_and_project").when(F.col("both") > 1, "ambiguous").when((F.col("orgs") > 0) & (F.col("projects") > 0), "conflict")
        .when(F.col("projects") == 1, "project").when(F.col("projects") > 1, "ambiguous").when(F.col("orgs") == 1, "org").otherwise("ambiguous")
    )
    doc = F.when(outcome == "org_and_project", F.col("d_both")).when(outcome == "project", F.col("d_project")).when(outcome == "org", F.col("d_org"))
    return j.select(question_id, outcome.alias("outcome"), doc.alias("document_id"))


def verbatim(documents: DataFrame, names: DataFrame, key: str, text: str, name_id: str, most: int = LISTED) -> DataFrame:
    """``key, name_id`` where a document's text contains a name (``key`` column of ``names``) as it stands.

    ``names`` is a fixed list: at most ``most`` rows, else this fails rather than gather them.
    """
    rows = [(r.key, r[name_id]) for r in names.where("key <> ''").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} names")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        by: dict[str, list[int]] = {}
        for k, i in rows:
            by.setdefault(k, []).append(i)
        a = ahocorasick.Automaton()
        for k, ids in by.items():
            a.add_word(k, (k, ids))
        if not len(a):
            return
        a.make_automaton()
        for b in batches:
            found = [(d, i) for d, t in zip(b[key], b[text], strict=True) for i in {i for _, (_, ids) in a.iter(t) for i in ids}]
            yield pd.DataFrame(found, columns=[key, name_id]).astype("int64")

    return documents.where(F.col(text).isNotNull()).select(key, text).mapInPandas(find, f"{key} long, {name_id} long")
