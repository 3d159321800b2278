"""A second, independent opinion on consortium clauses, and the kind of policy a clause states.

Nothing here is shared with ``operators.consortium``: where the two disagree, one
of them is wrong.  This reading starts from the refusals of a sentence and looks
back at what they refuse.
"""

from __future__ import annotations

import re

from jangbu.functions.arrow import vectorised

# The states, and the words looked for.
STATES = ("field_absent", "undetermined", "required_all", "required_conditional", "forbidden_all", "allowed_explicit", "method_restricted")
GROUP = r"(?:공동\s*(?:수급|도급|계약)(?:체|업체)?|컨소시엄)"
WAY = r"(?:공동\s*이행|분담\s*이행|주계약자)"
REFUSED = re.compile(r"불가(?!피)|불허|금지|배제|(?:허용|가능|인정|승인)(?:하|되|할|될)?(?:지|수)?\s*(?:는\s*)?(?:않|아니|없)|할\s*수\s*없")
GRANTED = re.compile(r"허용(?!\s*(?:하|되)?지)|가능(?!\s*(?:하|되)?지)|할\s*수\s*있")
DUTY = re.compile(rf"{GROUP}.{{0,20}}?(?:필수(?!\s*(?:가|는)?\s*아)|의무(?!\s*(?:가|는)?\s*아)|구성하여야|구성해야|로만\s*참)|반드시\s*{GROUP}|단독\S{{0,6}}\s*\S{{0,4}}\s*(?:불가|불허|금지)")
ONLY_IF = re.compile(r"경우|한하여|에\s*한해|인\s*때|미보유|부족")
SENTENCE = re.compile(r"[.。;\n/]|(?:하며|으며|되며|이며|하되|다만|단,)\s*")


def _object_of(head: str) -> str:
    """What the words before a refusal are about: group, both ways, one way, or something else."""
    head = re.split(r"[:：]|여부", head)[-1][-60:]
    last = None
    for last in re.finditer(rf"(?P<group>{GROUP})\s*(?P<remark>\([^)]*\))?|(?P<way>{WAY})|(?P<sub>하도급)", head):
        if last["group"]:
            inner = last["remark"] or ""
            if not re.search(WAY, inner):
                return "group"
            return "both_ways" if re.search(r"공동", inner) and "분담" in inner else "one_way"
    return "" if last is None else "one_way" if last["way"] else "sub"


def state_of(status: str | None, text: str | None, excerpt: str | None = None) -> str:
    """One of seven states; the excerpt is read where the text does not settle it."""
    if status == "field_absent":
        return "field_absent"
    if status != "value_present":
        return "undetermined"
    for t in (text, excerpt):
        found = _settled(" ".join((t or "").split()))
        if found != "undetermined":
            return found
    return "undetermined"


def _settled(t: str) -> str:
    if m := DUTY.search(t):
        around = t[max(0, m.start() - 40) : m.end()]
        return "required_conditional" if ONLY_IF.search(around) else "required_all"
    refused: set[str] = set()
    granted = False
    for sentence in SENTENCE.split(t):
        ends = 0
        for m in REFUSED.finditer(sentence):
            refused.add(_object_of(sentence[ends : m.start()]))
            ends = m.end()
        for m in GRANTED.finditer(sentence):
            names = list(re.finditer(GROUP, sentence[: m.start()]))
            if names and not REFUSED.search(sentence[names[-1].end() : m.start()]) and not re.search("단독", sentence[names[-1].end() : m.start()]):
                granted = True
    if refused & {"group", "both_ways"}:
        return "forbidden_all"
    return "allowed_explicit" if granted else "method_restricted" if "one_way" in refused else "undetermined"


def policy_kind(text: str | None) -> str:
    """What an extracted clause lays down: ``allow``, ``deny``, ``conditional``, ``constraint`` (only how a consortium is made up), or nothing."""
    t = " ".join((text or "").split())
    if not re.search(rf"{GROUP}|{WAY}", t) or re.search(r"하도급\s*계획서|허용\s*여부|협정서\s*양식", t):
        return ""
    ways = {w: bool(re.search(rf"{w}\s*이행[^.]{{0,30}}(?:불가|불허|금지|않)", t)) for w in ("공동", "분담")}
    open_ways = {w: bool(re.search(rf"{w}\s*이행[^.]{{0,20}}(?:가능|허용|원칙)(?!\s*(?:하|되)?지)", t)) for w in ("공동", "분담")}
    if (ways["공동"] and open_ways["분담"]) or (ways["분담"] and open_ways["공동"]):
        return "conditional"
    settled = _settled(t)
    if settled == "forbidden_all":
        return "deny"
    if settled in ("allowed_explicit", "required_all"):
        return "allow"
    return "constraint" if re.search(r"구성원|지분율|\d+\s*개\s*사|협정서", t) else ""


@vectorised("string", nulls=True)
def consortium_state(status: str | None, text: str | None, excerpt: str | None = None) -> str:
    return state_of(status, text, excerpt)


@vectorised("string", nulls=True)
def consortium_policy(text: str | None) -> str:
    return policy_kind(text)
