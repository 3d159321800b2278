"""Clauses of Korean sentences."""

from __future__ import annotations

import re

_END = re.compile(r"(?<=[.;])\s+|\n+|(?<=[하으이]며)[,\s]\s*|(?<=하고)[,\s]\s*|(?<=하되)[,\s]\s*|(?<=지만)[,\s]\s*|(?<=[이하]나)[,\s]\s*")
_ONLY_NUMBER = re.compile(r"(?:[가-힣]|\(?\d{1,2})\s*[.)]|[①-⑳]")


def clauses(text: str) -> list[str]:
    """Clauses of a text: cut at ends of sentences, at line ends and behind connective endings; a list number alone is none."""
    return [c for x in _END.split(text) if (c := x.strip()) and not _ONLY_NUMBER.fullmatch(c)]
