"""Abusive, hateful and sexual content: a weighted lexicon with exception phrases.

Texts are folded first: look-alike letters, digits and signs that stand for
letters, letters spelled out one by one, syllables taken apart into letters,
signs put between syllables.  One Aho-Corasick pass a language finds the entries
of ``abuse_words``; hits inside an exception phrase (neutral and technical uses,
rules against such language) do not count.  Some entries count by themselves;
others only together, as a group of people and what is said of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jangbu.llm import abuse_words as W
from jangbu.llm.lookalike import by_table

#: Evidence of one clear entry, or of two doubtful ones.
THRESHOLD = 1.0
#: Words of a passage, the stretch whose evidence is measured against its length; a sentence of more words is cut.
PASSAGE = 40
#: Score of a passage from which a document counts as a case: evidence / (1 + words / PASSAGE), so one clear entry among at most ``PASSAGE`` words.
FLAG = 0.5
#: Syllables, and English words, over which entries count together.
REACH, REACH_WORDS = 24, 9

CLEAR, DOUBT, GROUP, SAID, REMOVE, TARGET, SPARE, SEXUAL, VIOLENT, INTENDED, SOMEBODY, DONE = range(12)

_PLAIN = re.compile(r"[\x20-\x7e\n\r\t가-힣]*")
_RUN = re.compile(r"[가-힣]+")
_NOT_HANGUL = re.compile(r"[^가-힣]+")
_SIGN = re.compile(r"[^\sa-z()（）\[\]|:,\"'“”‘’]{1,3}")
_STOP = re.compile(r"[.!?。！？]\s|\n")
#: What may follow an entry that ends a word: plural, suffixes of contempt, particles, copula.
_ENDING = re.compile(r"(?:들|놈|년|새끼|자식|짓|질|소리|같은|같이|주제)*(?:이?(?:야|다|라|네|냐|구나|군|지|요|에요|예요|었|였|니|니까|라고|라는|란|며|고|면|거든|잖)[가-힣]{0,3}|아|은|는|이|가|을|를|의|에|에게|한테|께|도|만|로|으로|와|과|랑|까지|부터|보다|처럼|하고|에서|님)?")
#: What makes a doubtful word an address: a call, a question, or "you" beside it.
_ADDRESSED = re.compile(r"(?:들|놈|년|새끼|자식)*(?:아|야|이?냐|이?니)(?![가-힣])|[가-힣]{0,4},? (?:너|니들|너희|네놈)(?:는|들|도|가)?(?![가-힣])")
#: A clear word that is only named, by a rule against it.
_NAMED = re.compile(r"[\"'”’」』)]*\s*(?:(?:이?라고? ?하는|이?라는|같은|등의|등|과 같은|와 같은)\s*)?(?:[가-힣]{0,4} ?(?:표현|단어|욕설|비속어|낱말|어휘|용어|호칭|발언|문구))")
#: A passage that forbids or teaches: sexual words in it are what it is about.
_RULE = re.compile(r"예방|금지|차단|걸러|필터|제재|징계|처벌|신고 ?(?:센터|창구|접수|방법)|근절|단속|삭제(?:한다|하고|됩니다|합니다)|교육을|서약|고충 ?처리|\b(?:prohibit|forbid|filter|block|prevent|moderat|polic(?:y|ies)|ban(?:s|ned)?|remov)\w*")

# Syllables taken apart: letters of the keyboard, put together again.
_HEAD, _BODY, _TAIL = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ", " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
_APART = re.compile(rf"([{_HEAD}])([{_BODY}])(?:([{_TAIL[1:]}])(?![{_BODY}]))?")
#: Consonants that stand for a curse where they stand alone.
_INITIALS = re.compile(r"(?<![ㄱ-ㅎㅏ-ㅣ])(?:ㅅ ?ㅂ|ㅆ ?ㅂ|ㅂ ?ㅅ|ㅄ|ㅈ ?ㄹ|ㄲ ?ㅈ|ㅁ ?ㅊ|ㄱ ?ㅅ ?ㄲ|ㅅ ?ㄲ|ㄷ ?ㅊ|ㅈ ?ㄴ ?(?=[가-힣])|ㅊ ?ㄴ(?=[가-힣]))(?:ㅋ*)(?![ㄱ-ㅎㅏ-ㅣ])")
_LEET = str.maketrans("013457@$!", "oieastasi")
_LEET_WORD = re.compile(r"(?<![0-9a-z@$!])[0-9@$!]*[a-z][a-z0-9@$!]*(?![0-9a-z])")
_MASKED = re.compile(r"(?<![a-z0-9*#])[a-z]+[*#_\-.]{1,4}[a-z]*(?![a-z0-9*#])")
_SPELLED = re.compile(r"(?<![a-z0-9])(?:[a-z0-9@$!][ _.\-*~]){3,}[a-z0-9@$!](?![a-z0-9])")
_LONG = re.compile(r"([a-z])\1{2,}")
_WORD = re.compile(r"[a-z0-9]+")
#: Words that may stand between a person and what they are called.
_FILLER = frozenset("are re r is was a an the such so just all really nothing but too very bunch pack of fucking complete completely total totally utter utterly absolute absolutely damn dumb stupid pathetic worthless useless filthy lazy ugly old little fat dirty sick big most more only always every one must what even been being be like not s as and fundamentally basically obviously".split())
_CALLED = frozenset("you u ya he she they him her them".split())


class Judged(NamedTuple):
    """Sum of the weights found, number of words, score of the worst passage, whether that makes a case."""

    evidence: float
    words: int
    score: float
    flagged: bool


def _plural(w: str) -> list[str]:
    last = w.rsplit(" ", 1)[-1]
    more = w[:-1] + "ies" if last.endswith("y") and last[-2] not in "aeiou" else w + ("es" if last.endswith(("s", "sh", "ch", "x")) else "s")
    return [w, more]


def _verb(w: str) -> list[str]:
    stem = w[:-1] if w.endswith("e") else w
    doubled = w + w[-1] if len(w) < 5 and w[-1] in "tbpn" and w[-2] in "aeiou" and w[-3:-1] not in ("ea", "ur", "oo") else stem
    return [w, *_plural(w)[1:], doubled + "ing", doubled + "ed"]


@lru_cache(maxsize=1)
def _korean():
    """Automaton over syllables: for every entry its length and (kind, weight, may begin inside a word, must end the word) of each sense."""
    import ahocorasick

    senses: dict[str, list[tuple[int, float, bool, bool]]] = {}

    def add(entries: list[str], kind: int, weight: float = 0.0) -> None:
        for e in entries:
            senses.setdefault(e.strip("~$"), []).append((kind, weight, e[0] == "~" or kind == SPARE, e[-1] == "$"))

    add([*W.CURSES, *W.SLURS, *W.HUMILIATION, *W.THREATS], CLEAR, 1.0)
    add([f"~{b}{particle}{h}" for b in W.BODY for h in W.HARM for particle in ("", "을", "를", "부터", "이라도")], CLEAR, 1.0)
    add(W.SEXUAL, SEXUAL, 1.0)
    add(W.DOUBTFUL, DOUBT, 0.5)
    add(W.GROUPS, GROUP)
    add(W.CONTEMPT, SAID)
    add(W.REMOVAL, REMOVE)
    add(W.TARGETS, TARGET)
    add(W.SPARED, SPARE)
    a = ahocorasick.Automaton()
    for text, s in senses.items():
        a.add_word(text, (len(text), tuple(dict.fromkeys(s))))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _latin():
    """Automaton over words between blanks: for every entry its length and (kind, weight) of each sense."""
    import ahocorasick

    senses: dict[str, list[tuple[int, float]]] = {}

    def add(entries: list[str], kind: int, weight: float = 0.0) -> None:
        for e in entries:
            senses.setdefault(f" {e.strip()} ", []).append((kind, weight))

    add([x for w in W.LATIN["strong"].split() for x in _plural(w)], CLEAR, 1.0)
    add(W.LATIN["set"].split("|"), CLEAR, 1.0)
    add(W.LATIN["sexual"].split("|"), SEXUAL, 1.0)
    add([x for w in W.LATIN["mild"].split() for x in _plural(w)], DOUBT, 0.5)
    add(W.PEOPLE, GROUP)
    add(W.SAID_OF, SAID)
    add(W.DONE_TO, DONE)
    add([x for w in W.VIOLENCE for x in _verb(w)], VIOLENT)
    add(W.OF_SOMEBODY, SOMEBODY)
    add(W.INTENT, INTENDED)
    add(list(_CALLED), TARGET)
    add(W.SPARED_LATIN, SPARE)
    a = ahocorasick.Automaton()
    for text, s in senses.items():
        a.add_word(text, (len(text), tuple(dict.fromkeys(s))))
    a.make_automaton()
    return a


@lru_cache(maxsize=4096)
def _masked(word: str) -> str:
    """A strong word that a masked one (f*ck) can stand for, else the word itself."""
    form = re.compile(re.sub(r"[*#_\-.]+", lambda m: f"[a-z]{{1,{len(m[0]) + 1}}}", word))
    return next((w for w in W.LATIN["strong"].split() if form.fullmatch(w)), word)


def fold(text: str) -> str:
    t = text if _PLAIN.fullmatch(text) else by_table(text) if "\n" not in text else "\n".join(map(by_table, text.split("\n")))
    t = t.lower()
    if _APART.search(t):
        t = _APART.sub(lambda m: chr(0xAC00 + (_HEAD.index(m[1]) * 21 + _BODY.index(m[2])) * 28 + (_TAIL.index(m[3]) if m[3] else 0)), t)
    return t


def _counted(hits: list[tuple[int, int, float]]) -> list[tuple[int, float]]:
    """Place and weight of hits, one of hits that overlap (the heaviest, then the longest)."""
    taken: list[tuple[int, int]] = []
    out = []
    for w, _, a, b in sorted(((w, b - a, a, b) for a, b, w in hits), reverse=True):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((a, w))
    return out


def _korean_hits(t: str) -> list[tuple[int, float]]:
    """Place in the text and weight of what counts in Korean."""
    packed = _NOT_HANGUL.sub("", t)
    raw = list(_korean().iter(packed))
    kinds = {s[0] for _, (_, senses) in raw for s in senses}
    if not kinds - {GROUP, TARGET, SPARE} or (kinds <= {GROUP, SAID, SPARE} and not {GROUP, SAID} <= kinds):
        return []
    runs = [(m.start(), m.end()) for m in _RUN.finditer(t)]
    begins = list(accumulate((b - a for a, b in runs), initial=0))

    def gap(r: int) -> int:
        """What stands before a run: 1 a sign inside a word, 2 a blank or the like, 3 the end of a sentence."""
        between = t[runs[r - 1][1] : runs[r][0]]
        return 3 if _STOP.search(between) else 1 if _SIGN.fullmatch(between) else 2

    found: list[tuple[int, int, int, float]] = []  # kind, from, to (among the syllables), weight
    for end, (n, senses) in raw:
        a, b = end - n + 1, end + 1
        first, last = bisect_right(begins, a) - 1, bisect_right(begins, end) - 1
        inner = [gap(r) for r in range(first + 1, last + 1)]
        if 3 in inner:
            continue
        opens = a == begins[first]
        tail = t[runs[last][0] + end - begins[last] + 1 : runs[last][1]]
        whole = None
        for kind, weight, anywhere, closes in senses:
            if not (anywhere or opens):
                continue
            if n < 3 and kind in (CLEAR, DOUBT, GROUP, TARGET) and 2 in inner and len(inner) == n - 1 and not (opens and tail == "" and n > 1 and kind == CLEAR):
                continue  # two syllables of two words are no entry
            if closes:
                whole = bool(_ENDING.fullmatch(tail)) if whole is None else whole
                if not whole:
                    continue
            found.append((kind, a, b, weight))
    spared = [(a, b) for k, a, b, _ in found if k == SPARE]
    found = [x for x in found if x[0] != SPARE and not any(a <= x[1] and x[2] <= b for a, b in spared)]
    at = lambda i: (lambda r: runs[r][0] + i - begins[r])(bisect_right(begins, i) - 1)
    one_sentence = lambda i, j: not _STOP.search(t, at(i), at(j))
    hits: list[tuple[int, int, float]] = []
    for kind, a, b, weight in found:
        if kind == CLEAR:
            around = packed[max(0, a - 14) : a]
            if packed[a] in "죽패태박묻" and any(w in around for w in W.HARMLESS):
                continue
            if not _NAMED.match(t, at(b - 1) + 1):
                hits.append((a, b, weight))
        elif kind == SEXUAL:
            lo = max((m.end() for m in _STOP.finditer(t, max(0, at(a) - 120), at(a))), default=max(0, at(a) - 120))
            stop = _STOP.search(t, at(b - 1))
            if not _RULE.search(t, lo, min(stop.start() if stop else len(t), at(b - 1) + 120)):
                hits.append((a, b, weight))
        elif kind == DOUBT:
            hits.append((a, b, 1.0 if _ADDRESSED.match(t, at(b - 1) + 1) else weight))
    groups = [(a, b) for k, a, b, _ in found if k == GROUP]
    said = [(k, a, b) for k, a, b, _ in found if k in (SAID, REMOVE)]
    for a, b in groups:
        for k, c, d in said:
            # what is said of a group stands after it; of removal also a little before
            if b <= c <= b + REACH and one_sentence(a, c) and _of_group(t[at(b - 1) + 1 : at(c)], t[at(c) : at(d - 1) + 12], k):
                hits.append((a, d, 1.0))
                break
    targets = [(a, b) for k, a, b, _ in found if k == TARGET]
    for a, b in targets:
        for k, c, d in said:
            if k == SAID and 0 <= c - b <= 8 and one_sentence(a, c):
                hits.append((c, d, 0.5))
                break
        else:
            for k, c, d in said:
                if 0 <= a - d <= 8 and one_sentence(c, a):
                    hits.append((c, d, 0.5))
                    break
    return [(at(a), w) for a, w in _counted(hits)]


_OTHER_TOPIC = re.compile(r"시설|편의|화장실|복지관|회관|센터|병원|주택|지원|위한|전용|보호구역|주차|교육|안내|상담|검사|사업|이용|배려|대상|근로자를|참여|가점|비율|통계|고용|채용")


def _of_group(between: str, said: str, kind: int) -> bool:
    """Is it the group that something is said of: no other topic stands between the two."""
    return not _OTHER_TOPIC.search(between) and not (kind == REMOVE and _OTHER_TOPIC.search(said))


def _latin_hits(t: str) -> list[tuple[int, float]]:
    """Place in the text and weight of what counts in English."""
    if not _WORD.search(t):
        return []
    s = _SPELLED.sub(lambda m: re.sub(r"[ _.\-*~]", "", m[0]).ljust(len(m[0])), t)
    s = _LEET_WORD.sub(lambda m: m[0] if m[0].isalpha() else m[0].translate(_LEET), s)
    s = _MASKED.sub(lambda m: w if (w := _masked(m[0])) != m[0] else m[0], s)
    s = _LONG.sub(r"\1", s)
    tokens = [(m.start(), m[0]) for m in _WORD.finditer(s)]
    if not tokens:
        return []
    line = " " + " ".join(w for _, w in tokens) + " "
    begins = [0, *accumulate(len(w) + 1 for _, w in tokens)]  # place of the blank before each token
    found: list[tuple[int, int, int, float]] = []  # kind, first and last token, weight
    for end, (n, senses) in _latin().iter(line):
        i = bisect_right(begins, end - n + 1) - 1
        j = bisect_right(begins, end - 1) - 1
        found += [(kind, i, j, weight) for kind, weight in senses]
    kinds = {k for k, *_ in found}
    if not kinds & {CLEAR, SEXUAL, DOUBT, VIOLENT} and not (GROUP in kinds and kinds & {SAID, DONE}):
        return []
    spared = [(i, j) for k, i, j, _ in found if k == SPARE]
    found = [x for x in found if x[0] != SPARE and not any(i <= x[1] and x[2] <= j for i, j in spared)]
    words = [w for _, w in tokens]
    joined = lambda i, j: not _STOP.search(s, tokens[i][0], tokens[j][0])
    of = {k: [(i, j) for kind, i, j, _ in found if kind == k] for k in range(12)}
    hits: list[tuple[int, int, float]] = [(i, j + 1, w) for k, i, j, w in found if k in (CLEAR, DOUBT)]
    for i, j in of[SEXUAL]:
        lo = max((m.end() for m in _STOP.finditer(s, max(0, tokens[i][0] - 160), tokens[i][0])), default=max(0, tokens[i][0] - 160))
        stop = _STOP.search(s, tokens[j][0])
        if not _RULE.search(s, lo, min(stop.start() if stop else len(s), tokens[j][0] + 160)):
            hits.append((i, j + 1, 1.0))
    # somebody is called something
    for i, j in of[DOUBT]:
        k = i - 1
        while k >= max(0, i - 7) and words[k] in _FILLER:
            k -= 1
        before = k >= 0 and words[k] in _CALLED and joined(k, i)
        after = j + 1 < len(words) and words[j + 1] in ("you", "u", "bastard") and joined(i, j + 1)
        chained = [x for x in of[DOUBT] if x[0] == j + 1 and joined(i, x[0])]
        if (before and (k == i - 1 or any(words[x] in ("are", "re", "r", "is", "was") for x in range(k + 1, i)) or chained)) or (after and i and words[i - 1] in ("you", "the", "a")):
            hits.append((i, j + 1, 1.0))
    # violence meant for somebody
    for i, j in of[VIOLENT]:
        victim = [x for x, _ in of[SOMEBODY] if j < x <= j + 4 and joined(i, x)]
        meant = [x for x, _ in of[INTENDED] if i - 6 <= x < i and joined(x, i)]
        person = any(words[x] in ("you", "your") or (words[x] in ("his", "her", "their") and x + 1 < len(words) and words[x + 1] in ("face", "legs", "head", "neck", "kids", "family", "wife", "children", "throat", "skull", "teeth", "bones")) for x in victim)
        if victim and meant and person:
            hits.append((i, j + 1, 1.0))
    # a group, and what is said of it or asked for it
    for i, j in of[GROUP]:
        for k in (SAID, DONE, DOUBT):
            for a, b in of[k]:
                if j < a <= j + REACH_WORDS and joined(i, a):
                    between = words[j + 1 : a]
                    copula = any(w in ("are", "re", "r", "were", "is", "stink", "smell", "breed") for w in [*between, words[a]])
                    asked = any(w in ("should", "must", "ought", "deserve", "need", "let", "hope") for w in between)
                    if (k == DONE and asked) or (k != DONE and copula and not asked and not any(w in ("responsible", "in", "by", "from", "with", "who", "affected", "for") for w in between)):
                        hits.append((i, b + 1, 1.0))
    return [(tokens[i][0], w) for i, w in _counted(hits)]


_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")


def _worst(t: str, hits: list[tuple[int, float]]) -> float:
    """Highest score of a passage of the text."""
    best = 0.0
    edges = [0, *(m.end() for m in _SENTENCE.finditer(t)), len(t)]
    for a, b in zip(edges, edges[1:], strict=False):
        own = [(at, w) for at, w in hits if a <= at < b]
        if not own:
            continue
        starts = [a + m.start() for m in re.finditer(r"\S+", t[a:b])]
        if len(starts) <= PASSAGE:
            best = max(best, sum(w for _, w in own) / (1 + len(starts) / PASSAGE))
            continue
        for at, _ in own:  # of a longer sentence the words from every hit on
            k = bisect_right(starts, at) - 1
            far = starts[k + PASSAGE] if k + PASSAGE < len(starts) else b
            best = max(best, sum(w for x, w in own if at <= x < far) / (1 + min(PASSAGE, len(starts) - k) / PASSAGE))
    return best


def judged(text: str | None) -> Judged:
    """What a text holds; zeros for null and blank."""
    if not text or text.isspace():
        return Judged(0.0, 0, 0.0, False)
    t = fold(text)
    hits = [(m.start(), 1.0) for m in _INITIALS.finditer(t)]
    hits += _korean_hits(t) + _latin_hits(t)
    score = _worst(t, hits) if hits else 0.0
    return Judged(sum(w for _, w in hits), len(t.split()), round(score, 6), score >= FLAG)


def evidence(text: str | None) -> tuple[float, int]:
    """Sum of the weights found in a text, and the number of its words."""
    return judged(text)[:2]


@F.pandas_udf(T.StructType([T.StructField("evidence", T.DoubleType()), T.StructField("words", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())]))
def _judged(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judged(t) for t in text], columns=Judged._fields)


def scores(documents: DataFrame) -> DataFrame:
    """``doc_id, source, evidence, score, flagged`` of every document.

    ``evidence`` sums the weights found; ``score`` is that of the worst passage,
    its evidence over 1 + its words / ``PASSAGE``, a passage being a sentence or
    ``PASSAGE`` words of a longer one; ``flagged`` is a score of at least
    ``FLAG``.  So a single remark in a long text counts like one that stands
    alone, and doubtful words count where they stand together.  Null, empty and
    blank texts score 0.
    """
    e = documents.select("doc_id", "source", _judged.asNondeterministic()("text").alias("e"))
    return e.select("doc_id", "source", "e.evidence", "e.score", "e.flagged")


def rates(documents: DataFrame) -> DataFrame:
    """``source, n_documents, n_flagged, rate, mean_score`` per source; documents without a source are a group of their own (null)."""
    s = scores(documents)
    return s.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
