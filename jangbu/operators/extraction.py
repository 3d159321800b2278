"""Documents read into twelve fields: sections, hits of labels with their values, what is usable of them, a representative, a status.

A document is one row's work: its lines, its sections and its hits stay together,
so nothing is shuffled and no document waits for another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jangbu.functions.answers import period_tokens, ratio_pair
from jangbu.functions.arrow import vectorised
from jangbu.functions.columns import expression_key
from jangbu.operators.policy import policy_kind

# Labels of the fields; their letters may be spaced.
ALIASES = {
    "사업 개요": ("사업개요", "사업목적", "추진배경"), "사업분야": ("사업분야", "사업구분"), "공고일": ("공고일", "공고일자"), "사업기간": ("사업기간", "과업기간", "계약기간", "용역기간"), "예산": ("총사업비", "사업예산", "소요예산", "사업비", "예산"), "참가 자격(면허·실적)": ("입찰참가자격", "참가자격"),
    "지역제한": ("지역제한", "지역의무"), "컨소시엄 요건": ("공동수급", "공동도급", "컨소시엄"), "평가 배점": ("평가배점", "배점", "평가기준"), "제출 방식": ("제출방식", "제출방법"), "필수 제출 서류": ("필수제출서류", "제출서류", "구비서류"), "과업 범위": ("과업범위", "과업내용"),
}
EXTERNAL = re.compile(r"(?:별도|붙임|첨부|별첨|공고문|제안요청서|과업지시서)[^.]{0,20}(?:참조|참고|따른다|따름|따르며|의함|확인)|참조$")
UNDISCLOSED = re.compile(r"비공개|공개하지\s*않")
NONE = re.compile(r"원문에 값이 없|해당\s*(?:사항\s*)?없|^없음|제한\s*없음?$")
STATUTE = re.compile(r"(?:법률|법|시행령|시행규칙|규정|기준|예규|고시)」?\s*제\s*\d+\s*조|「[^」]{2,40}(?:법|령|규칙|기준)」")
CONTENTS = re.compile(r"(?:[·.…]\s*){4,}\s*\d{1,3}\s*$|^\s*(?:\d+\.)+\d*\s+\S.{0,40}\s\d{1,3}\s*$")
ATTACHMENT = re.compile(r"^\s*(?:#{1,6}\s*)?[\[【<(]?\s*(?:별지|별첨|붙임|서식|양식)\s*(?:제?\s*\d+\s*호?)?")
_VALUE = {
    "예산": re.compile(r"\d[\d,.]*\s*(?:조|억|천만|백만|만|천)*\s*원|\d{1,3}(?:,\d{3})+|[\d,]+\s*(?:천|백만)원"), "사업기간": re.compile(r"\d+\s*(?:개?월|년|일|주)|20\d\d\s*[.년-]"), "공고일": re.compile(r"20\d\d\s*[.년/-]\s*\d{1,2}"), "평가 배점": re.compile(r"\d+\s*(?:점|%|퍼센트|:)"),
    "지역제한": re.compile(r"본점|본사|소재|권역|관내|지역|전국|제한"), "제출 방식": re.compile(r"온라인|전자|방문|우편|직접|이메일|창구|시스템|제출"), "필수 제출 서류": re.compile(r"서류|신청서|증명서|확인서|제안서|서약서|등록증|계획서|\d+\s*부"), "참가 자격(면허·실적)": re.compile(r"업체|업자|실적|면허|등록|자격|확인서|신고|자$|인증"),
}
_ALIAS = {a: f for f, names in ALIASES.items() for a in names}
#: One alternation over all labels, the longest first, with blanks allowed between their letters.
PATTERN = re.compile("|".join(r"\s?".join(map(re.escape, a)) for a in sorted(_ALIAS, key=len, reverse=True)))
_JOINT = re.compile(r"^(?:\s*(?:[:：|)\]】\-]|은(?=\s)|는(?=\s)|이(?=\s)|가(?=\s)|에는|항목은|항목))*\s*")
_MARK = re.compile(r"^\s*(?:[-○●■□◦▪※*•◎]|\(?\d{1,2}[.)]|[가-하][.)]|[①-⑳]|[IVXⅠ-Ⅻ]+\.)\s*")
#: Lines of a block that are taken for a value, and characters of it that are kept.
BLOCK, KEPT = 6, 300
#: Lines before and behind a hit, and those among which a table of contents is looked for.
NEAR_CONTENTS = 6


@dataclass
class Hit:
    field: str
    line: int
    value: str
    inline: bool
    heading: bool
    section: tuple[str, ...]
    source: str  # body, attachment, contents or table
    usable: bool = False
    reason: str = field(default="")


def heading_level(line: str) -> int:
    """Depth of a heading line, 0 for any other: markdown by its marks, numbered ones (I., 1., 가.) below."""
    if m := re.match(r"^(#{1,6})\s+\S", line):
        return len(m[1])
    for depth, rx in ((7, r"^[IVXⅠ-Ⅻ]+\.\s+\S"), (8, r"^\d{1,2}\.\s+\S"), (9, r"^[가-하]\.\s+\S")):
        if re.match(rx, line) and len(line) <= 40 and not line.rstrip().endswith(("다.", "다", ".")):
            return depth
    return 0


def sections(lines: list[str]) -> list[tuple[str, ...]]:
    """Path of headings above every line; a heading line stands in its own path."""
    out: list[tuple[str, ...]] = []
    path: list[tuple[int, str]] = []
    for line in lines:
        if depth := heading_level(line):
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, re.sub(r"^#+\s*", "", line).strip()))
        out.append(tuple(t for _, t in path))
    return out


def attachment_start(lines: list[str]) -> int:
    """Index of the first line of the attachments, past the first fifth of the document; the number of lines without any."""
    return next((i for i, x in enumerate(lines) if ATTACHMENT.match(x) and i >= len(lines) // 5 and len(x) <= 60), len(lines))


def looks_contents(line: str) -> bool:
    return CONTENTS.search(line) is not None


def looks_header_row(line: str) -> bool:
    """A table row of names only: several short cells without digits."""
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return line.lstrip().startswith("|") and len(cells) > 1 and all(0 < len(c) <= 12 and not re.search(r"\d", c) for c in cells)


def looks_statute(text: str) -> bool:
    return STATUTE.search(text) is not None


def source_types(lines: list[str]) -> list[str]:
    """Where every line stands: attachment, contents (several such lines around it), table or body."""
    start = attachment_start(lines)
    dotted = [looks_contents(x) for x in lines]
    out = []
    for i, x in enumerate(lines):
        near = sum(dotted[max(0, i - NEAR_CONTENTS) : i + NEAR_CONTENTS + 1])
        out.append("attachment" if i >= start else "contents" if dotted[i] and near > 1 else "table" if x.lstrip().startswith("|") or "<td" in x.lower() else "body")
    return out


def block_after(lines: list[str], at: int) -> str:
    """The lines below a label that belong to it: deeper list items or plain lines, up to the next heading, label or blank line behind some text."""
    out: list[str] = []
    for x in lines[at + 1 : at + 1 + 3 * BLOCK]:
        if heading_level(x) or len(out) == BLOCK:
            break
        if not x.strip():
            if out:
                break
            continue
        body = _MARK.sub("", x)
        if (m := PATTERN.match(body)) and (len(body) == m.end() or re.match(r"\s*[:：|]", body[m.end() :])):
            break
        out.append(body.strip())
    return "\n".join(out)


def find_hits(text: str) -> list[Hit]:
    """Labels of a document with what follows them: in the line, in the next cell, or, where the line ends, in the block below."""
    lines = text.replace("\r", "").split("\n")
    paths, kinds = sections(lines), source_types(lines)
    out = []
    for i, line in enumerate(lines):
        spans = list(PATTERN.finditer(line))
        for k, m in enumerate(spans):
            name = _ALIAS[re.sub(r"\s", "", m[0])]
            end = spans[k + 1].start() if k + 1 < len(spans) and re.match(r"\s*[:：|]", line[spans[k + 1].end() :]) else len(line)
            rest = line[m.end() : end]
            anchored = not _MARK.sub("", re.sub(r"^[|#\s]+", "", line[: m.start()])).strip()
            joined = _JOINT.sub("", rest).strip(" |")
            head = heading_level(line) > 0
            value = "" if head else joined.split("|")[0].strip() if kinds[i] == "table" else joined
            inline = bool(value)
            if not value and anchored:
                value = block_after(lines, i)
            if anchored or re.match(r"\s*(?:[:：|]|은|는|이|가)", rest):
                out.append(Hit(name, i + 1, value[:KEPT], inline, head, paths[i], kinds[i]))
    return out


def usable(hit: Hit) -> tuple[bool, str]:
    """Whether a hit's value says something about its field, else why not; each field asks for its own kind of value."""
    v = hit.value.strip()
    if not v:
        return False, "blank"
    if hit.source == "contents" or looks_contents(v):
        return False, "contents"
    if looks_header_row(v) or (hit.source == "table" and len(v) <= 12 and PATTERN.fullmatch(v)):
        return False, "header"
    if UNDISCLOSED.search(v) or EXTERNAL.search(v) or NONE.search(v):
        return False, "no_value"
    if looks_statute(v) and len(STATUTE.sub("", v).strip()) < 10:
        return False, "statute"
    if hit.field == "컨소시엄 요건":
        said = policy_kind(v if re.search("공동|컨소시엄", v) else f"공동수급 {v}")
        return (True, "") if said else (False, "no_policy")
    if hit.field == "평가 배점" and ratio_pair(v):
        return True, ""
    if hit.field in _VALUE:
        return (True, "") if _VALUE[hit.field].search(v) else (False, "other_kind")
    return (len(v) >= 4, "" if len(v) >= 4 else "short")


def pick(hits: list[Hit]) -> Hit | None:
    """The hit that stands for a field: usable, outside attachments and tables of contents, in the line; then what its field prefers, then the first."""
    if not hits:
        return None

    def rank(h: Hit) -> tuple:
        own = {"예산": -len(re.findall(r"원", h.value)), "사업기간": -len(period_tokens(h.value)[1]), "필수 제출 서류": -h.value.count("\n") - h.value.count(","), "사업 개요": -len(h.value), "평가 배점": -len(ratio_pair(h.value))}.get(h.field, 0)
        return (not h.usable, h.source in ("contents", "attachment"), not h.inline, own, h.line)

    return min(hits, key=rank)


def same_value(name: str, a: str, b: str) -> bool:
    """Whether two values of a field say the same: amounts and periods by what they come to, others by their letters."""
    if name == "사업기간":
        (da, la), (db, lb) = period_tokens(a), period_tokens(b)
        return bool(la & lb or da & db) or (not (la and lb) and not (da and db))
    if name == "예산":
        na, nb = (set(re.findall(r"\d[\d,.]*\s*(?:조|억|천만|백만|만|천)*\s*원", x)) for x in (a, b))
        return not (na and nb) or bool({re.sub(r"[\s,]", "", x) for x in na} & {re.sub(r"[\s,]", "", x) for x in nb})
    x, y = (re.sub(r"[^0-9A-Za-z가-힣]", "", v) for v in (a, b))
    return x in y or y in x


def decide(name: str, hits: list[Hit]) -> tuple[str, Hit | None, list[Hit]]:
    """Status of a field, its representative and its other usable hits: absent, referred elsewhere, not disclosed, found only in attachments or contents, without usable value, contradicting, or present."""
    own = [h for h in hits if h.field == name]
    for h in own:
        h.usable, h.reason = usable(h)
    best = pick(own)
    if best is None:
        return "field_absent", None, []
    good = [h for h in own if h.usable]
    if not good:
        said = [h.value for h in own if h.value.strip()]
        if any(EXTERNAL.search(v) for v in said):
            return "external_reference", best, []
        if any(UNDISCLOSED.search(v) for v in said):
            return "not_disclosed", best, []
        if any(NONE.search(v) for v in said) or not said:
            return "field_absent", best, []
        return ("field_absent" if all(h.source == "contents" for h in own) else "review_required"), best, []
    if all(h.source == "attachment" for h in good):
        return "review_required", best, [h for h in good if h is not best]
    body = [h for h in good if h.source != "attachment"]
    if name in ("예산", "사업기간", "공고일") and any(not same_value(name, best.value, h.value) for h in body):
        return "conflict", best, [h for h in body if h is not best]
    return "value_present", best, [h for h in good if h is not best]


def external_target(text: str | None) -> str:
    """What a value refers to elsewhere (a notice, an attachment), empty where it refers to nothing."""
    m = re.search(r"((?:입찰\s*)?공고(?:문|서)?|제안요청서|과업\s*(?:지시서|내용서)|(?:붙임|첨부|별첨|별지)\s*(?:자료|서류|서식|제?\s*\d+\s*호?)?|별도\s*(?:공고(?:문|서)?|문서|통지|안내))[^.\n]{0,20}?(?:참조|참고|따른다|따름|따르며|의함|확인|안내)", text or "")
    return re.sub(r"\s+", " ", m[1]).strip() if m else ""


def external_only(text: str | None) -> bool:
    """Whether a value is a reference and nothing beside it: without the reference, its particles and signs, under ten letters are left."""
    t = text or ""
    if not external_target(t):
        return False
    rest = re.sub(r"(?:입찰\s*)?공고(?:문|서)?|제안요청서|과업\s*(?:지시서|내용서)|붙임|첨부|별첨|별지|별도|자료|서류|서식|문서|참조|참고|따른다|따름|따르며|의함|확인|안내|하여|바람|것", "", t)
    return len(re.sub(r"[^0-9A-Za-z가-힣]", "", rest)) < 10


COLUMNS = "field_name string, status string, answer_raw string, line int, section array<string>, source_type string, n_hits int, n_usable int, others array<struct<line:int,value:string>>"


def rows_of(text: str) -> list[tuple]:
    """The twelve rows of a document."""
    hits = find_hits(text)
    out = []
    for name in ALIASES:
        status, best, others = decide(name, hits)
        own = [h for h in hits if h.field == name]
        out.append((name, status, best and best.value, best and best.line, list(best.section) if best else None, best and best.source, len(own), sum(h.usable for h in own), [(h.line, h.value) for h in others]))
    return out


def extract(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``COLUMNS``: twelve rows of every document that is not null."""
    names = ["field_name", "status", "answer_raw", "line", "section", "source_type", "n_hits", "n_usable", "others"]
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[key], b[text], strict=True) for r in rows_of(t)]
            out = pd.DataFrame(rows, columns=[key, *names])
            out["line"] = out["line"].astype("Int32")
            out["others"] = [[{"line": n, "value": v} for n, v in x] for x in out["others"]]
            yield out

    return documents.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, {COLUMNS}")


@vectorised("array<struct<field:string,line:int,value:string,inline:boolean,heading:boolean,section:array<string>,source:string,usable:boolean,reason:string>>")
def hits_of(text: str) -> list[tuple]:
    """All hits of a text, each with whether it is usable and why not."""
    out = []
    for h in find_hits(text):
        ok, why = usable(h)
        out.append({"field": h.field, "line": h.line, "value": h.value, "inline": h.inline, "heading": h.heading, "section": list(h.section), "source": h.source, "usable": ok, "reason": why})
    return out


@vectorised("struct<target:string,only:boolean>")
def reference_of(text: str) -> tuple:
    return external_target(text), external_only(text)


@vectorised("array<struct<line:int,level:int,path:array<string>,source:string>>")
def outline(text: str) -> list[dict]:
    """Headings of a text with their depth, their path and where they stand."""
    lines = text.replace("\r", "").split("\n")
    paths, kinds = sections(lines), source_types(lines)
    return [{"line": i + 1, "level": n, "path": list(paths[i]), "source": kinds[i]} for i, x in enumerate(lines) if (n := heading_level(x))]


def new_labels(documents: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """``label, n_documents, n``: names of headings and left cells, followed by a value, that no alias covers, in at least ``least`` documents: candidates for the alias list."""
    line = F.explode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("line")
    cell = r"^\s*(?:[-○●■□◦▪※*•|#]+\s*|\(?\d{1,2}[.)]\s*|[가-하][.)]\s*)*([가-힣][가-힣 ·]{1,14}[가-힣])\s*[:：|]\s*\S"
    e = documents.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("_d"), text).select("_d", line).select("_d", F.trim(F.regexp_extract("line", cell, 1)).alias("label")).where("label <> ''")
    known = documents.sparkSession.createDataFrame([(a,) for a in _ALIAS], "key string")
    n = e.withColumn("key", expression_key(F.col("label"))).join(F.broadcast(known), "key", "left_anti").groupBy("key").agg(F.min("label").alias("label"), F.countDistinct("_d").alias("n_documents"), F.count("*").alias("n"))
    return n.where(F.col("n_documents") >= least).select("label", "n_documents", "n")


def alias_pattern(name: str) -> str:
    """Pattern of a field's labels, as the engine's own regular expressions write it."""
    return "|".join(r"\s?".join(a) for a in sorted(ALIASES[name], key=len, reverse=True))


def says_contents(line: Column) -> Column:
    return line.rlike(CONTENTS.pattern)


@vectorised("array<struct<first:int,last:int,path:array<string>>>")
def heading_stacks(text: str) -> list[dict]:
    """Runs of lines under one path of headings, from the outermost to the nearest."""
    out: list[dict] = []
    for i, path in enumerate(sections(text.replace("\r", "").split("\n")), 1):
        if out and out[-1]["path"] == list(path):
            out[-1]["last"] = i
        else:
            out.append({"first": i, "last": i, "path": list(path)})
    return out
