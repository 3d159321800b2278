"""Keys of organisation and project names, as names are compared; every key is empty rather than misleading."""

from __future__ import annotations

import re
import unicodedata

from jangbu.functions.arrow import vectorised

# Legal forms, words every project may have in its name, what a round may count.
LEGAL_FORMS = ("주식회사", "유한회사", "재단법인", "사단법인", "학교법인", "의료법인", "사회복지법인", "(주)", "(재)", "(사)", "(유)", "㈜", "㈶", "㈳")
GENERIC = ("유지보수용역", "유지관리용역", "고도화사업", "위탁용역", "구축사업", "개선사업", "용역사업", "위탁운영", "재공고", "용역", "위탁", "수탁", "사업", "공사", "구매", "임차", "대여", "납품", "제안", "입찰", "공고", "계약", "선정", "긴급", "협상", "기타", "관련", "및", "등")
PROJECT_WORDS = ("사업", "용역", "구축", "고도화", "개선", "추진", "도입", "운영")
OTHER_ROUNDS = ("공고", "재공고", "입찰공고", "정정공고", "변경공고", "사전공고", "긴급공고", "회의", "질문", "답변", "회신", "검토", "평가", "심사", "통보", "안내", "요청")
SEPARATORS = "·ㆍ~∼―─–—/\\|＋+￦₩$"
QUOTES = "「」『』【】《》〈〉"
_SPACE = re.compile(r"\s+")


def shown(text: str | None) -> str:
    """Text as displayed and stored: composed, single blanks, nothing deleted."""
    return _SPACE.sub(" ", unicodedata.normalize("NFC", text or "")).strip()


def _bare(text: str) -> str:
    return "".join(c for c in text if not (c.isspace() or unicodedata.category(c)[0] == "P" or c in SEPARATORS)).casefold()


def organisation_key(name: str | None) -> str:
    """One width, no legal form, no punctuation or blanks, no case."""
    t = unicodedata.normalize("NFKC", name or "")
    for form in LEGAL_FORMS:
        t = t.replace(unicodedata.normalize("NFKC", form), " ")
    return _bare(t)


def project_key(name: str | None) -> str:
    """As ``organisation_key`` but for the legal forms; an ordinal's prefix is folded (제2차 = 2차), digits stay."""
    return re.sub(r"제(?=\d+(?:차|단계|회|기))", "", _bare(unicodedata.normalize("NFKC", name or "")))


def unbracketed(name: str | None) -> str:
    """Name without remarks in brackets, nested ones too; quotation brackets are opened and keep their content."""
    t = unicodedata.normalize("NFKC", name or "").translate(dict.fromkeys(map(ord, QUOTES), " "))
    depth, out = 0, []
    closing = 0
    for i, c in enumerate(t):
        if c in "([" and any(x in ")]" for x in t[i + 1 :]):
            depth += 1
            closing = max(closing, len(out))
        elif c in ")]" and depth:
            depth -= 1
            if not depth:
                out.append(" ")
        elif not depth:
            out.append(c)
    return _SPACE.sub(" ", "".join(out)).strip()


def is_generic(key: str) -> bool:
    """Whether a key is made of words any project may have, read from the left, the longest word first."""
    rest = key
    while rest:
        word = max((w for w in GENERIC if rest.startswith(w)), key=len, default="")
        if not word:
            return False
        rest = rest[len(word) :]
    return bool(key)


def without_organisation(project: str | None, organisation: str | None) -> str:
    """Key of a project's name behind the name of its organisation; empty where it does not begin with that."""
    org = organisation_key(organisation)
    return next((k[len(org) :] for k in (organisation_key(project), project_key(project)) if org and k.startswith(org) and len(k) > len(org)), "")


def possessive_folded(text: str | None) -> str:
    """Text without the possessive particle between words, where at least two syllables stay before it."""
    words = (text or "").split(" ")
    return " ".join(w[:-1] if w.endswith("의") and len(w) > 2 and any(words[i + 1 :]) else w for i, w in enumerate(words))


def rounds(name: str | None) -> list[int]:
    """Rounds an official project name states (2차), in order; 차 inside a longer word is none."""
    return sorted({int(n) for n in re.findall(r"(?<!\d)(\d{1,2})\s*차(?![가-힣])|(?<!\d)(\d{1,2})\s*차(?=사업|용역|공고)", name or "") for n in n if n})


def asked_rounds(question: str | None) -> list[int]:
    """Rounds a question states of a project: before a word for projects, or alone in brackets beside one; rounds of announcements and meetings are none."""
    q, out = question or "", set()
    for m in re.finditer(r"(?<!\d)(?:제\s*)?(\d{1,2})\s*차", q):
        inside = re.search(r"[(（]([^)）\n]*)$", q[: m.start()])
        if inside and re.match(r"\s*[)）]", q[m.end() :]):
            if any(w in inside[1] for w in OTHER_ROUNDS):
                continue
            before = re.findall(r"[가-힣A-Za-z0-9]+", q[: inside.start()])[-1:]
            after = re.findall(r"[가-힣A-Za-z0-9]+", q[m.end() :])[:1]
            beside = [w.endswith(PROJECT_WORDS) - w.endswith(OTHER_ROUNDS) * (not w.endswith(PROJECT_WORDS)) for w in before] + [w.startswith(PROJECT_WORDS) - w.startswith(OTHER_ROUNDS) * (not w.startswith(PROJECT_WORDS)) for w in after]
            if next((x for x in beside if x), 0) > 0:
                out.add(int(m[1]))
        elif re.match(rf"\s*(?:{'|'.join(PROJECT_WORDS)})", q[m.end() :]) and not any(w in q[max(0, m.start() - 12) : m.start()] for w in OTHER_ROUNDS):
            out.add(int(m[1]))
    return sorted(out)


def file_alias(file_name: str | None, organisation: str | None, project: str | None = None) -> str:
    """Short project name in ``organisation_project.md``; one that is cut inside a word of the full name is drawn out to the word's end."""
    f, org, full = shown(file_name), shown(organisation), shown(project)
    if not org or not f.startswith(org + "_"):
        return ""
    alias = re.sub(r"\.md$", "", f[len(org) + 1 :], flags=re.I).strip()
    if alias and full.startswith(alias):
        return full[: len(alias) + len(re.match(r"\S*", full[len(alias) :])[0])] if not full[len(alias) :].startswith(" ") else alias
    return alias


@vectorised("string")
def shown_text(text: str) -> str:
    return shown(text)


@vectorised("struct<org:string,project:string,org_unbracketed:string,project_unbracketed:string,project_folded:string,generic:boolean,behind_org:string,rounds:array<int>>", nulls=True)
def name_keys(organisation: str | None, project: str | None) -> tuple:
    """All keys of a record's names; a variant equal to the plain key is empty, and so is one that only generic words are left of."""
    org, proj = organisation_key(organisation), project_key(project)
    org_u, proj_u, folded = organisation_key(unbracketed(organisation)), project_key(unbracketed(project)), project_key(possessive_folded(project))
    generic = is_generic(proj_u)
    return org, proj, "" if org_u == org else org_u, "" if proj_u == proj or generic else proj_u, "" if folded == proj else folded, generic, without_organisation(project, organisation), rounds(project)


@vectorised("array<int>")
def question_rounds(question: str) -> list[int]:
    return asked_rounds(question)


@vectorised("string", nulls=True)
def alias_of_file(file_name: str | None, organisation: str | None, project: str | None) -> str:
    return file_alias(file_name, organisation, project)
