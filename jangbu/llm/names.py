"""Variant spellings of names typed by people, linked to one entity.

Names become vectors of weighted character n-grams (of letters, a Korean
syllable being two or three), compared by a sparse cosine join; an edit distance
over syllables confirms a candidate.  Organisations are looked up in the official
list, of fixed size; projects are joined with each other and grouped by
average-linkage clustering.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jangbu.llm.lookalike import by_table
from jangbu.runtime import broadcast_if_small, cut

GRAM = 4


def letters(text: str) -> str:
    return unicodedata.normalize("NFD", text)


def grams(text: str, n: int = GRAM) -> list[str]:
    """Distinct n-grams over letters, in order of first use; the whole text where it is shorter."""
    s = letters(text)
    return list(dict.fromkeys(s[i : i + n] for i in range(max(1, len(s) - n + 1)))) if s else []


def substitution(a: str, b: str) -> float:
    """Cost of one syllable for another: by how many of its three letters differ."""
    if a == b:
        return 0.0
    if not ("가" <= a <= "힣" and "가" <= b <= "힣"):
        return 1.0
    x, y = ord(a) - 0xAC00, ord(b) - 0xAC00
    return (0.0, 0.5, 0.8, 1.0)[(x // 588 != y // 588) + (x // 28 % 21 != y // 28 % 21) + (x % 28 != y % 28)]


def inside(short: str, long: str, whole: bool = False, most: float = math.inf) -> float:
    """Least cost to turn ``short`` into a part of ``long`` (or into the ``whole`` of it): substitutions by letters, inserted, lost and swapped syllables 1 each.

    Costs over ``most`` may come out as any number over ``most``.
    """
    before: list[float] = []
    row = [float(j) if whole else 0.0 for j in range(len(long) + 1)]
    for i, x in enumerate(short, 1):
        new = [float(i)]
        for j, y in enumerate(long, 1):
            v = min(row[j - 1] + substitution(x, y), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == long[j - 2] and short[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most and min(row) > most - 1:  # neither a step nor a swap leads back
            return most + 1
        before, row = row, new
    return row[-1] if whole else min(row)


# Organisations

# Legal forms and other words that do not belong to an organisation's name.
LEGAL = re.compile(r"㈜|㈳|㈶|[(（]\s*[주재사]\s*[)）]|주식회사|재단법인|사단법인|[(（]\s*본원\s*[)）]|\bthe\b", re.I)
# How long region names and types are shortened.
SHORT_REGION = re.compile(r"(?:광역시|특별자치시|특별시)$")
SHORT_TYPES = {
    "테크노파크": ("TP",), "대학교 산학협력단": ("대 산학협력단", "산학협력단", "대학교 산단", "대 산단"), "디지털콘텐츠랩": ("D콘텐츠랩",), "교육지원청": ("교육청",), "상수도사업본부": ("상수도본부",), "도시철도공사": ("철도공사",), "환경관리공단": ("환경공단",),
    "소방안전본부": ("소방본부",), "평생학습도서관": ("평생도서관",), "정보화진흥센터": ("정보화센터",), "중소기업연합회": ("중기연합회",), "문화관광재단": ("문화재단",), "공공의료원": ("의료원",),
}
# Offices that stand beside the name of their organisation.
OFFICES = re.compile(r"총무과|계약담당관?|정보화기획팀|디지털전략실|정보화담당관|정보전산과|기획조정실|기획예산과|경영지원(?:팀|실|부)|재무과|회계과|운영지원과|전산실|정보전략팀|구매팀|조달팀|사업팀")
#: Candidates of an organisation's name that are confirmed by edit distance.
TOP = 8
#: Cost up to which a name means an organisation, and how much nearer than any other it must be.
MOST_COST, MARGIN = 2.6, 0.25
#: Added to the cost where the region's own name is nowhere in the text.
NO_REGION = 0.6


def plain(text: str) -> str:
    """A name as compared: one form of characters, lower case, no legal forms, no blanks or punctuation."""
    return re.sub(r"[^0-9a-z가-힣]", "", LEGAL.sub(" ", by_table(text)).lower())


def without_offices(s: str) -> str:
    return OFFICES.sub("", s) or s


class Organisations:
    """The official list, ready to be asked for what a typed name means.

    Beside the listed ones it knows every other pairing of the list's regions and
    types; a name that means one of these means no listed organisation.
    """

    def __init__(self, rows: list[tuple[int, str, str, str, str]]) -> None:
        listed = {(region, kind): org for org, _, _, kind, region in rows}
        english_region = {region: english.split()[0] for _, _, english, _, region in rows if english}
        english_kind = {kind: " ".join(english.split()[1:]) for _, _, english, kind, _ in rows if english}
        self.official = {org: official for org, official, *_ in rows}
        self.stem: list[str] = []
        self.org: list[int | None] = []
        self.forms: list[tuple[str, ...]] = []
        for region in sorted({r[4] for r in rows}):
            for kind in sorted({r[3] for r in rows}):
                regions = dict.fromkeys((region, SHORT_REGION.sub("시", region)))
                kinds = (kind, *SHORT_TYPES.get(kind, ()))
                forms = [plain(x) for r in regions for k in kinds for x in (f"{r}{k}", f"{k}{r}")]
                if region in english_region and kind in english_kind:
                    forms.append(plain(f"{english_region[region]} {english_kind[kind]}"))
                self.stem.append(re.sub(r"(?:광역시|특별자치시|특별시|시|군|도|구)$", "", region))
                self.org.append(listed.get((region, kind)))
                self.forms.append(tuple(dict.fromkeys(forms)))
        holders: dict[str, set[int]] = {}
        for k, fs in enumerate(self.forms):
            for f in fs:
                holders.setdefault(f, set()).add(k)
        self.exact = {f: ks.pop() for f, ks in holders.items() if len(ks) == 1}
        self.form_grams = [[frozenset(grams(f, 3)) for f in fs] for fs in self.forms]
        docs = [set().union(*gs) for gs in self.form_grams]
        df = Counter(g for d in docs for g in d)
        self.column = {g: i for i, g in enumerate(sorted(df))}
        self.idf = np.array([math.log(1 + len(docs) / df[g]) for g in sorted(df)])
        self.matrix = np.zeros((len(df), len(docs)), np.float32)
        for k, d in enumerate(docs):
            for g in d:
                self.matrix[self.column[g], k] = self.idf[self.column[g]]
        # the norm of one form, not of all forms together
        self.matrix /= np.sqrt([max(sum(self.idf[self.column[g]] ** 2 for g in grams(f, 3)) for f in fs) for fs in self.forms]).astype(np.float32)

    def meant(self, typed: str) -> int | None:
        """Id of the organisation a typed name means, or None."""
        s = without_offices(plain(typed))
        if len(s) < 3:
            return None
        whole = self.exact.get(s, self.exact.get(s.removesuffix("장")))
        if whole is not None:
            return self.org[whole]
        cols = [self.column[g] for g in grams(s, 3) if g in self.column]
        if not cols:
            return None
        similar = self.idf[cols] @ self.matrix[cols]
        best = np.argsort(-similar, kind="stable")[:TOP].tolist()
        named = [k for k in best if any(f in s for f in self.forms[k])]
        if len(named) == 1:
            return self.org[named[0]]
        # the likeliest spelling first; a cost that cannot matter any more is not worked out
        have, least, cost = set(grams(s, 3)), math.inf, []
        for k in best:
            extra = NO_REGION * (self.stem[k] not in s and not s.isascii())
            c = bound = min(MOST_COST, least) + MARGIN - extra
            for i in sorted(range(len(self.forms[k])), key=lambda i, k=k: (-len(self.form_grams[k][i] & have), i)):
                c = min(c, self._cost(self.forms[k][i], s, c))
            cost.append(((c if c < bound else c + 1) + extra, k))
            least = min(least, cost[-1][0])
        cost.sort()
        (least, k), rest = cost[0], [c for c, _ in cost[1:]]
        if least > MOST_COST or least > 0.3 * len(s) or (rest and rest[0] - least < MARGIN):
            return None
        return self.org[k]

    @staticmethod
    def _cost(form: str, s: str, most: float) -> float:
        if form in s:
            return 0.0
        if form.isascii() != s.isascii():
            return 99.0
        return 0.5 * inside(form, s, most=2 * most) if form.isascii() else inside(form, s, most=most)


def _listed(buyer_orgs: DataFrame) -> list[tuple[int, str, str, str, str]]:
    """The official list, which is fixed (260 rows)."""
    whole = buyer_orgs.where("org_id is not null and official_name is not null and org_type is not null and region is not null")
    return [tuple(r) for r in whole.select("org_id", "official_name", "english_name", "org_type", "region").collect()]


def organisation_links(identity_records: DataFrame, buyer_orgs: DataFrame) -> DataFrame:
    """``record_id, linked_id``: records whose buyer means a listed organisation and is not exactly its official name.

    An office, department or head counts as the organisation.  Null and empty
    names, and names that mean none or could mean two, are left out.  Each
    distinct text is matched once.
    """
    rows = _listed(buyer_orgs)
    cache: dict[str, Organisations] = {}

    @F.pandas_udf(T.LongType())
    def meant(s: pd.Series) -> pd.Series:
        if not rows:
            return pd.Series([None] * len(s), dtype="Int64")
        if "all" not in cache:
            cache["all"] = Organisations(rows)
        out = []
        for x in s:
            org = cache["all"].meant(x)
            out.append(None if org is None or cache["all"].official[org] == x else org)
        return pd.Series(out, dtype="Int64")

    named = identity_records.where("buyer_org is not null and trim(buyer_org) <> ''").select("record_id", "buyer_org")
    linked = _spread(named.select("buyer_org").distinct(), "buyer_org").withColumn("linked_id", meant.asNondeterministic()("buyer_org")).where("linked_id is not null")
    return named.join(linked, "buyer_org").select("record_id", "linked_id")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Small rows with dear functions before them, in several parts a core: parts are otherwise merged by their bytes.

    The functions over them are marked as not deterministic, so that no filter on
    a result is pushed below ``distinct``, where it would run them once more.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


# Projects

# How names state year and phase, what marks a repeated tender, and what ends a name without saying anything.
YEAR = re.compile(r"(?<!\d)(20\d\d)\s*(?:학?년도?)?(?!\d)|['‘’`](\d\d)\s*(?:년도?)?(?!\d)|(?<!\d)(\d\d)년도?")
PHASE = re.compile(r"(?:제\s*)?(\d+|iii|ii|iv|vi|i|v)\s*(?:단계|phase)|phase\s*(\d+|iii|ii|iv|vi|i|v)\b")
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"}
TAGS = re.compile(r"^\s*(?:[\[(<【〔]\s*[^\])>】〕]{1,8}\s*[\])>】〕]\s*)+")
ENDING = re.compile(r"(?:위탁용역|용역사업|용역|사업)$")
#: Share of distinct names from which a pair of syllables is ordinary wording, and the least number that share stands for.
ORDINARY, ORDINARY_LEAST = 0.003, 8
#: Syllables in a row, in no frequent pair, from which a name has a part of its own beside its frequent pairs: typing errors in a frequent name leave fewer.
OWN_LEAST = 4
#: Cosine from which names are candidates; similarity at which clusters are joined.
COSINE, LINKAGE = 0.3, 0.5
#: Edit cost at which two cores have nothing in common any more.
APART = 2.6


def project_key(name: str) -> tuple[str, str, str]:
    """Year, phase (empty where not stated) and the bare wording of a project's name."""
    t = by_table(name).lower()
    year = phase = ""
    if m := YEAR.search(t):
        year = m[1] or "20" + (m[2] or m[3])
        t = f"{t[: m.start()]} {t[m.end() :]}"
    if m := PHASE.search(t):
        said = m[1] or m[2]
        phase = ROMAN.get(said, said)
        t = f"{t[: m.start()]} {t[m.end() :]}"
    t = TAGS.sub("", re.sub(r"[(\[]\s*[)\]]", " ", t).strip())
    t = re.sub(r"[^0-9a-z가-힣]", "", t)
    return year, phase, ENDING.sub("", t) or t


def own_stretch(text: str, ordinary: frozenset[str]) -> tuple[int, int]:
    """Begin and end of the longest part of a wording outside the given pairs of syllables."""
    usual = [False] * len(text)
    for i in range(len(text) - 1):
        if text[i : i + 2] in ordinary:
            usual[i] = usual[i + 1] = True
    best, a = (0, 0), 0
    for i in range(len(text) + 1):
        if i == len(text) or usual[i]:
            if i - a > best[1] - best[0]:
                best = (a, i)
            a = i + 1
    return best


def own_words(text: str, ordinary: frozenset[str]) -> str:
    """The longest part of a wording outside ordinary pairs of syllables; with four syllables on either side where it is short, all of it where there is none."""
    a, b = own_stretch(text, ordinary)
    if a == b:
        return text
    return text[max(0, a - 4) : b + 4] if b - a < 5 else text[a:b]


def beside_own(text: str, frequent: frozenset[str]) -> list[str]:
    """The frequent pairs of syllables of a wording that has a part of its own beside them; none where all it has is frequent."""
    a, b = own_stretch(text, frequent)
    return sorted({text[i : i + 2] for i in range(len(text) - 1)} & frequent) if b - a >= OWN_LEAST else []


def without_organisation(wording: str, organisations: frozenset[str]) -> str:
    """A wording without the organisation it begins with, where more than that is left."""
    for n in range(min(max(map(len, organisations), default=0), len(wording) - 4), 3, -1):
        if wording[:n] in organisations:
            return wording[n:]
    return wording


def _keys(organisations: frozenset[str]):
    @F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("year", "phase", "wording")]))
    def keys(name: pd.Series) -> pd.DataFrame:
        found = (project_key(x) for x in name)
        return pd.DataFrame([(y, p, without_organisation(w, organisations)) for y, p, w in found], columns=["year", "phase", "wording"])

    return keys.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pairs_of_syllables(s: pd.Series) -> pd.Series:
    return pd.Series([sorted({x[i : i + 2] for i in range(len(x) - 1)}) for x in s], dtype=object)


#: Syllables in a row that two cores share and that then cost no more than one letter, whatever stands around them.
SHARED_RUN = 6


def _apart(short: str, long: str) -> float:
    """Edit cost of two cores: of the whole where both are about as long, else of the shorter inside the longer, which then has wording around it."""
    c = inside(short, long, whole=len(short) >= 5 and len(long) - len(short) <= 1)
    return min(c, 0.5) if c > 0.5 and any(short[i : i + SHARED_RUN] in long for i in range(len(short) - SHARED_RUN + 1)) else c


def project_names(identity_records: DataFrame, organisations: frozenset[str] = frozenset()) -> DataFrame:
    """``project_name, year, phase, core`` of every distinct name that is not null or blank.

    ``core`` is what is left of a name without year, phase, tags, endings, the
    organisation it begins with (of the bare names given) and wording that many
    names share.  A pair of syllables counts as shared where names hold it beside
    a part of their own; the spellings of one project, however many, hold the
    pairs of its name beside nothing else, so its name stays.  The list of
    shared pairs holds at most (mean length / ORDINARY) entries, some thousands
    at any size.
    """
    keyed = identity_records.where("project_name is not null and trim(project_name) <> ''").select("project_name").distinct()
    keyed = cut(_spread(keyed, "project_name").withColumn("k", _keys(organisations)("project_name")).select("project_name", "k.*").where("wording <> ''"))
    wordings = keyed.select("year", "phase", "wording").distinct()
    least = max(ORDINARY_LEAST, ORDINARY * wordings.count())
    shared = lambda pairs: frozenset(r.pair for r in wordings.select(F.explode(pairs("wording")).alias("pair")).groupBy("pair").count().where(F.col("count") > least).select("pair").collect())
    frequent = shared(_pairs_of_syllables)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def beside(s: pd.Series) -> pd.Series:
        return pd.Series([beside_own(x, frequent) for x in s], dtype=object)

    ordinary = shared(beside)

    @F.pandas_udf(T.StringType())
    def core(s: pd.Series) -> pd.Series:
        return pd.Series([own_words(x, ordinary) for x in s], dtype=object)

    return keyed.withColumn("core", core("wording")).select("project_name", "year", "phase", "core")


def packed_grams(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and n-gram of every distinct n-gram of the cores, as ``grams`` gives them; an n-gram is its letters at 16 bits each (cores hold digits, a to z and syllables)."""
    spelt = [letters(x) for x in cores]
    length = np.fromiter(map(len, spelt), np.int64, len(spelt))
    code = np.concatenate([np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32).astype(np.int64) & 0xFFFF, np.zeros(GRAM, np.int64)])
    n = np.where(length > 0, np.maximum(1, length - GRAM + 1), 0)
    row = np.repeat(np.arange(len(spelt)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(length) - length)[row] + at
    gram = np.zeros(len(row), np.int64)
    for k in range(GRAM):
        gram = gram << 16 | np.where(at + k < length[row], code[begin + k], 0)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[first], gram[first]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _packed(core: pd.Series) -> pd.Series:
    row, gram = packed_grams(core.tolist())
    return pd.Series(np.split(gram, np.searchsorted(row, np.arange(1, len(core)))), dtype=object)


#: Pairs of equal size from which their costs are worked out together.
TOGETHER = 32


def apart_many(a: list[str], b: list[str]) -> np.ndarray:
    """``_apart`` of the shorter and the longer of every pair."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    out = np.empty(len(pairs))
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(pairs):
        by_size.setdefault((len(x), len(y)), []).append(k)
    for (m, n), ks in by_size.items():
        if m == 0 or len(ks) < TOGETHER:
            out[ks] = [_apart(*pairs[k]) for k in ks]
            continue
        cost = _inside_many([pairs[k][0] for k in ks], [pairs[k][1] for k in ks], m >= 5 and n - m <= 1)
        if m >= SHARED_RUN:
            for i in np.flatnonzero(cost > 0.5).tolist():
                x, y = pairs[ks[i]]
                if any(x[j : j + SHARED_RUN] in y for j in range(m - SHARED_RUN + 1)):
                    cost[i] = 0.5
        out[ks] = cost
    return out


def _inside_many(short: list[str], long: list[str], whole: bool) -> np.ndarray:
    """``inside`` of pairs of which all the short sides are of one length and all the long sides too."""
    codes = lambda xs: np.ascontiguousarray(np.frombuffer("".join(xs).encode("utf-32-le"), np.uint32).astype(np.int32).reshape(len(xs), -1).T)
    s, t = codes(short), codes(long)
    parts = lambda c: ((c - 0xAC00) // 588, (c - 0xAC00) // 28 % 21, (c - 0xAC00) % 28, (c >= 0xAC00) & (c <= 0xD7A3))
    (s1, s2, s3, s_is), (t1, t2, t3, t_is) = parts(s), parts(t)
    by_differing = np.array([0.0, 0.5, 0.8, 1.0])
    before: list[np.ndarray] = []
    row = [np.full(len(short), float(j) if whole else 0.0) for j in range(len(t) + 1)]
    for i in range(len(s)):
        new = [np.full(len(short), i + 1.0)]
        for j in range(len(t)):
            differing = (s1[i] != t1[j]).astype(np.int8) + (s2[i] != t2[j]) + (s3[i] != t3[j])
            cost = np.where(s_is[i] & t_is[j], by_differing[differing], s[i] != t[j])
            v = np.minimum(np.minimum(row[j] + cost, row[j + 1] + 1), new[j] + 1)
            if i and j:
                v = np.where((s[i] == t[j - 1]) & (s[i - 1] == t[j]), np.minimum(v, before[j - 1] + 1), v)
            new.append(v)
        before, row = row, new
    return row[-1] if whole else np.minimum.reduce(row)


#: Nodes of one block; two blocks of one year and phase meet in one cell.  Products of two nodes' n-grams worked out at once.
BLOCK, AT_ONCE = 30_000, 2_000_000


def close_rows(cores: list[str], n_first: int, gram: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and cosine of all pairs of cores of cosine ``COSINE`` or more, in parts: one of the first ``n_first`` with one of the rest, or, where these are all, each with each.

    ``gram`` is sorted and holds every n-gram of the cores, ``weight`` its weight.
    """
    row, g = packed_grams(cores)
    w = weight[column := np.searchsorted(gram, g)]
    x = (w / np.sqrt(np.bincount(row, w * w, len(cores)))[row]).astype(np.float32)
    order = np.lexsort((row, column))
    row, column, x = row[order], column[order], x[order]
    # every n-gram's list of rows; an entry meets those behind it, or those of the second block
    end = np.searchsorted(column, column, "right")
    place = column * len(cores) + row
    begin = np.arange(1, len(row) + 1) if n_first == len(cores) else np.searchsorted(place, column * len(cores) + n_first)
    mine = np.flatnonzero((row < n_first) & (end > begin))
    mine = mine[np.argsort(row[mine], kind="stable")]
    n = (end - begin)[mine]
    total = np.cumsum(n)
    at = 0
    while at < len(mine):
        # whole rows, at least one
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")), at + 1)
        if to < len(mine):
            back = int(np.searchsorted(row[mine], row[mine[to]]))
            to = back if back > at else int(np.searchsorted(row[mine], row[mine[at]], "right"))
        own, k = mine[at:to], n[at:to]
        other = np.repeat(begin[own] - np.cumsum(k) + k, k) + np.arange(k.sum())
        pair = np.repeat(row[own] - row[own[0]], k) * len(cores) + row[other]
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        cosine = np.add.reduceat((np.repeat(x[own], k) * x[other])[order].astype(np.float64), first)
        good = cosine >= COSINE - 1e-6
        found = pair[first[good]]
        yield found // len(cores) + row[own[0]], found % len(cores), cosine[good]
        at = to


def _cell(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs of one cell: its nodes (``id, core, block``) and, without core, the n-grams of their year and phase (``id, w``)."""
    is_node = part["core"].notna()
    nodes, gram = part[is_node].sort_values("block", kind="stable"), part[~is_node].sort_values("id")
    cores, node = nodes["core"].to_numpy(object), nodes["id"].to_numpy()
    n_first = len(nodes) if part["one"].iloc[0] else int((nodes["block"] == nodes["block"].min()).sum())
    if not part["one"].iloc[0] and n_first == len(nodes):  # one of the two blocks is empty
        return
    for i, j, cosine in close_rows(cores.tolist(), n_first, gram["id"].to_numpy(), gram["w"].to_numpy()):
        similarity = (1 - apart_many(cores[i].tolist(), cores[j].tolist()) / APART + cosine) / 2
        a, b, good = node[i], node[j], similarity > 0
        yield pd.DataFrame({"a": np.minimum(a, b)[good], "b": np.maximum(a, b)[good], "similarity": similarity[good]})


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of all cells of rows sorted by cell, of which one at a time is held."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for cell, part in b.groupby("cell", sort=False):
            if held and held[0]["cell"].iloc[0] != cell:
                yield from _cell(pd.concat(held))
                held = []
            held.append(part)
    if held:
        yield from _cell(pd.concat(held))


def similar_cores(nodes: DataFrame) -> DataFrame:
    """``a, b, similarity`` (a < b) of nodes (``node, year, phase, core``) of one year and phase: all pairs of cosine ``COSINE`` or more, confirmed by edit distance.

    The nodes of a year and phase are dealt into blocks of about ``BLOCK``, and
    every two blocks meet in a cell of their own, where a worker multiplies them
    over an inverted index of n-grams, exact, without caps.  What is shuffled is
    every node once for each block of its year and phase, never the pairs.  The
    similarity is the mean of the cosine and 1 - edit cost / ``APART``.
    """
    n = nodes.agg(F.count("*")).scalar()
    held = cut(nodes.select("year", "phase", F.explode(_packed("core")).alias("gram")).groupBy("year", "phase", "gram").agg(F.count("*").alias("n")))
    weight = held.groupBy("gram").agg(F.sum("n").alias("df")).select("gram", F.log(1 + n / F.col("df")).alias("w"))
    sizes = nodes.groupBy("year", "phase").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = broadcast_if_small(cut(sizes), 100_000)
    name = lambda i, j: F.concat_ws("|", "year", "phase", i.cast("string"), j.cast("string"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = nodes.join(sizes, ["year", "phase"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = placed.select("year", "phase", "node", "core", "block", F.explode(every).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    left = met.select(name(low, high).alias("cell"), (low == high).alias("one"), F.col("node").alias("id"), "core", "block", F.lit(0.0).alias("w"))
    grams_of = held.join(weight, "gram").join(sizes, ["year", "phase"])
    twice = F.explode(F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))).alias("c")
    right = grams_of.select("year", "phase", "gram", "w", twice).select(name(F.col("c.i"), F.col("c.j")).alias("cell"), (F.col("c.i") == F.col("c.j")).alias("one"), F.col("gram").alias("id"), F.lit(None).cast("string").alias("core"), F.lit(0).alias("block"), "w")
    # few bytes and much work: in several parts a core
    spread = left.unionByName(right).repartition(4 * nodes.sparkSession.sparkContext.defaultParallelism, "cell").sortWithinPartitions("cell")
    return spread.mapInPandas(_cells, "a long, b long, similarity double")


def average_linkage(edges: DataFrame, sizes: DataFrame, least: float = LINKAGE) -> DataFrame:
    """``node, cluster``: average-linkage clusters of ``edges`` (``a, b, similarity``; pairs without an edge count 0).

    ``sizes`` (``node, n``) says how many records a node stands for.  In every
    round all pairs of clusters that are each other's nearest are joined, which
    gives the tree that joining one pair at a time gives; rounds end when no pair
    reaches ``least``.  A cluster's number is that of one of its nodes.  Nothing
    is gathered anywhere: each round is joins over what is left of the edges, and
    nodes that no edge of ``least`` touches take no part in them, as an average
    never exceeds the largest of what it averages.
    """
    na, nb = sizes.withColumnsRenamed({"node": "a", "n": "na"}), sizes.withColumnsRenamed({"node": "b", "n": "nb"})
    edges = cut(edges)
    strong = edges.where(F.col("similarity") >= least)
    touched = strong.select(F.col("a").alias("x")).unionByName(strong.select(F.col("b").alias("x"))).distinct()
    kept = edges.join(touched.withColumnRenamed("x", "a"), "a", "left_semi").join(touched.withColumnRenamed("x", "b"), "b", "left_semi")
    # total similarity between clusters, weighted by records
    between = cut(kept.join(na, "a").join(nb, "b").select("a", "b", "na", "nb", (F.col("similarity") * F.col("na") * F.col("nb")).alias("total")))
    rounds: list[DataFrame] = []
    while True:
        mean = between.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), (F.col("total") / (F.col("na") * F.col("nb"))).alias("mean")).where(F.col("mean") >= least)
        ends = mean.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("d")), F.struct(F.col("b").alias("c"), F.col("a").alias("d")))).alias("e"), "n", "mean", "a", "b")
        nearest = ends.groupBy("e.c").agg(F.max(F.struct("mean", "a", "b", "n", "e.d")).alias("m")).select("c", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.n").alias("n"))
        # both ends name the pair
        joined = nearest.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("n").alias("n")).where("k = 2")
        merged = cut(joined.select(F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("into"), "n"))
        if merged.isEmpty():
            break
        rounds.append(merged)
        ra, rb = (merged.withColumnsRenamed({"c": s, "into": f"into_{s}", "n": f"n_{s}"}) for s in "ab")
        moved = between.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("into_a", "a").alias("a"), F.coalesce("n_a", "na").alias("na"), F.coalesce("into_b", "b").alias("b"), F.coalesce("n_b", "nb").alias("nb"), "total").where("a <> b")
        turned = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"), "total")
        between = cut(turned.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("total").alias("total")))
    if not rounds:
        return sizes.select("node", F.col("node").alias("cluster"))
    member = rounds[0].select(F.col("c").alias("node"), F.col("into").alias("cluster"))
    for merged in rounds[1:]:
        step = merged.select("c", "into")
        old = member.join(step, F.col("cluster") == F.col("c"), "left").select("node", F.coalesce("into", "cluster").alias("cluster"))
        # nodes that are joined for the first time
        first = step.join(member.select(F.col("node").alias("c")), "c", "left_anti").select(F.col("c").alias("node"), F.col("into").alias("cluster"))
        member = cut(old.unionByName(first))
    return sizes.join(member, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def projects(identity_records: DataFrame, buyer_orgs: DataFrame | None = None) -> DataFrame:
    """``project_name, project``: the class of every distinct name; names of one project share it.

    A class holds one year and one phase (also "none stated").
    """
    known = frozenset() if buyer_orgs is None else frozenset(f for forms in Organisations(_listed(buyer_orgs)).forms for f in forms)
    named = cut(project_names(identity_records, known))
    node = F.xxhash64("year", "phase", "core")
    named = named.withColumn("node", node)
    records = identity_records.select("project_name").where("project_name is not null").groupBy("project_name").agg(F.count("*").alias("k"))
    nodes = cut(named.join(records, "project_name").groupBy("node", "year", "phase", "core").agg(F.sum("k").alias("n")))
    member = average_linkage(similar_cores(nodes), nodes.select("node", "n"))
    return named.join(member, "node").select("project_name", F.col("cluster").alias("project"))


def project_links(identity_records: DataFrame, buyer_orgs: DataFrame | None = None) -> DataFrame:
    """``record_id, linked_id`` (smaller first): records of different documents whose differing names mean one project.

    Null and blank names, and records without document, link to nothing.
    """
    of = projects(identity_records, buyer_orgs)
    r = identity_records.where("document_id is not null and project_name is not null").select("record_id", "document_id", "project_name").join(of, "project_name")
    a, b = r.alias("a"), r.alias("b")
    pairs = a.join(b, F.col("a.project") == F.col("b.project")).where("a.record_id < b.record_id and a.document_id <> b.document_id and a.project_name <> b.project_name")
    return pairs.select(F.col("a.record_id").alias("record_id"), F.col("b.record_id").alias("linked_id"))


def project_classes(identity_records: DataFrame, buyer_orgs: DataFrame | None = None) -> DataFrame:
    """``record_id, project, n_links`` of every record with document and project name: its class, and the number of records ``project_links`` links it to.

    Counted from the sizes of the class and of its documents and texts, so no
    pair is made.  Blank names belong to no class and are left out.
    """
    of = projects(identity_records, buyer_orgs)
    r = cut(identity_records.where("document_id is not null and project_name is not null").select("record_id", "document_id", "project_name").join(of, "project_name"))
    whole = r.groupBy("project").agg(F.count("*").alias("n"))
    same_text = r.groupBy("project", "project_name").agg(F.count("*").alias("t"))
    same_document = r.groupBy("project", "document_id").agg(F.count("*").alias("d"))
    both = r.groupBy("project", "project_name", "document_id").agg(F.count("*").alias("b"))
    counted = r.join(whole, "project").join(same_text, ["project", "project_name"]).join(same_document, ["project", "document_id"]).join(both, ["project", "project_name", "document_id"])
    return counted.select("record_id", "project", (F.col("n") - F.col("t") - F.col("d") + F.col("b")).alias("n_links"))


def links(identity_records: DataFrame, buyer_orgs: DataFrame) -> DataFrame:
    """``field_name, record_id, linked_id`` of both kinds of names."""
    org = organisation_links(identity_records, buyer_orgs).select(F.lit("buyer_org").alias("field_name"), "record_id", F.col("linked_id").cast("long").alias("linked_id"))
    return org.unionByName(project_links(identity_records, buyer_orgs).select(F.lit("project_name").alias("field_name"), "record_id", "linked_id"))
