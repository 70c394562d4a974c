"""The shared rules in Python, for table functions that read recursive formats."""

from __future__ import annotations

import re
from collections.abc import Callable

from passagemill.functions import patterns as R


def _rewriter(rules: tuple[tuple[str, str], ...]) -> Callable[[str], str]:
    compiled = [(re.compile(pattern), by.replace("$1", r"\1")) for pattern, by in rules]

    def rewrite(text: str) -> str:
        for pattern, by in compiled:
            text = pattern.sub(by, text)
        return text

    return rewrite


def _whole(*patterns: str) -> Callable[[str], bool]:
    compiled = re.compile("|".join(f"(?:{p})" for p in patterns))
    return lambda text: compiled.fullmatch(text) is not None


collapse = _rewriter(((R.ZERO_WIDTH, ""), *R.COLLAPSE))
tidy = _rewriter(R.TIDY)
heading = _rewriter(R.HEADING)
note_marks = _rewriter(R.NOTE_MARKS)
_is_listed, _is_marker, _is_year = _whole(*R.BOILERPLATE_HEADINGS), _whole(R.MARKER), _whole(R.YEAR_MARKER)
is_note_boilerplate = _whole(*R.NOTE_BOILERPLATE)


def is_boilerplate(title: str) -> bool:
    return _is_listed(heading(heading(title).lower().replace("’", "'")))


def is_numeric_marker(text: str) -> bool:
    return _is_marker(text.strip()) and not _is_year(text.strip())


def first(pattern: str, text: str | None) -> str | None:
    """What the first group of a pattern, or else the whole of it, finds in a text."""
    found = re.search(pattern, text or "", re.IGNORECASE)
    return found and (found.group(1) if found.re.groups else found.group())


def normalise_doi(value: str | None) -> str | None:
    found = first(R.DOI, (value or "").replace("\\_", "_"))
    return found.rstrip(".,;)").lower() if found else None
