"""Patterns and word lists that the column expressions and the table functions share, each stated once.

Rules are (pattern, replacement) pairs, applied in order. They are written so
that Java and Python read them alike; ``$1`` stands for the first group.
"""

from __future__ import annotations

# Everything in this module must match texts in one given way.
DASHES = "–\\-−—"
ZERO_WIDTH = "\u200b"
COLLAPSE = ((r"\s+", " "), (r"^ | $", ""))
TIDY = (
    (ZERO_WIDTH, ""),
    *COLLAPSE,
    (rf"[\[(][\s,;{DASHES}]*[\])]", ""),
    (r"\s+([,.;:)\]])", "$1"),
    (r"([(\[])\s+", "$1"),
    *COLLAPSE,
)
HEADING = ((ZERO_WIDTH, ""), *COLLAPSE, (r"^(?:\d+(?:\.\d+)*\.?|[A-Za-z]\.|[IVX]+\.)\s+(?=[A-Za-z])", ""), (r"[.:]+$", ""), *COLLAPSE)
MARKER = rf"[\[(]?\s*\d+[a-z]?(\s*[,{DASHES}]\s*\d+[a-z]?)*\s*[\])]?[\s,;]*"
YEAR_MARKER = r"[\[(]?\s*(?:19|20)\d{2}[a-z]?\s*[\])]?[\s,;]*"
DOI = r"10\.\d{4,9}/[^\s\"<>{}]+"
CLOSERS = "[\"'”’)\\]]*"
NUMBER = r"(?<![A-Za-z\d])(?<![A-Za-z]-)\d+(?:[.,]\d+)*(?:\^-?\d+)?"
CITED_KEY = r"\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}"
INDEX_ENTRY = r"^- `L[\d-]+` — (.+?) Cites: (.+?)\.?$"

# Words that take a full stop without ending a sentence.
ABBREVIATIONS = (
    "al approx ca cf dr eq eqs fig figs no nos prof ref refs resp sp spp ssp st suppl tab var viz vol vs"
).split()

# Query words that are not marked in a text.
STOPWORDS = (
    "a an and are as at be been by can did do does for from had has have how in is it its of on or than that the "
    "their there these this to was were what when where which who why with"
).split()

# Headings of sections that are not part of an argument; each matches a whole lower-cased heading.
BOILERPLATE_HEADINGS = (
    r"acknowledge?ments?",
    r"(sources? of )?funding( information| statement| sources?)?",
    r"financial (support|disclosure)",
    r"(conflicts? of interests?|competing interests?)( statement)?",
    r"conflict of interest and funding",
    r"declarations?( of (competing )?interests?)?",
    r"disclosure( statement)?",
    r"author(s'|s)? contributions?( statement)?",
    r"credit authorship contribution statement",
    r"contributors|contributor information|author information|authorship|about the authors?",
    r"(data|code|software|materials|resource) availability( statement)?",
    r"availability of (data|supporting) .*",
    r"data (and code |and materials )?(availability|access|accessibility)( statement)?",
    r"underlying data|source data|associated data|extended data",
    r"(gene )?accession numbers?",
    r"(other )?(supplementary|supplemental|additional) (material|materials|information|data|files?|data files)\b.*",
    r"(foot)?notes?|editors? note|publisher's note",
    r"peer review( information)?",
    r"(key |uncited )?references( and notes)?|bibliography|literature cited",
    r"abbreviations( used)?|glossary",
    r"ethics( statement| approval| declarations?)?|ethical (approval|statement|clearance|permission)|ethic statement",
    r"ethics approval and consent to participate|informed consent( statement)?|consent( for publication| to (publish|participate))?",
    r"inclusion and ethics|institutional review board.*|role of the funder|orcid( ids?)?",
)

# Syntax of a note's lines. Marks leave what they stand for; a link reads as its other name, else as its target.
NOTE_FENCE = r"\s*(`{3,}|~{3,})"
NOTE_HEADING = r"\s{0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*"
NOTE_RULE = r"\s{0,3}([-*_])(?:\s*\1){2,}\s*"
NOTE_MARKS = (
    (r"!\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[\[[^\]|]*\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]|#]*)(?:#[^\]|]*)?(?:\|)?\]\]", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"==([^=\n]+)==", "$1"),
    (r"\[![^\]]*\][+-]?\s*", ""),
    (r"(?:^|\s)\^[A-Za-z0-9-]+$", ""),
)
NOTE_BOILERPLATE = (r"Notes for .+\.pdf:", r"show annotation")
