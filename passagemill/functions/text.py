"""Text functions as column expressions; all but the folding of accents stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions import patterns as R
from passagemill.functions.patterns import ABBREVIATIONS, BOILERPLATE_HEADINGS, STOPWORDS  # noqa: F401

_CLOSERS = R.CLOSERS


def _rewrite(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, f"(?U){pattern}", by)
    return text


def collapse(text: Column) -> Column:
    """Unicode white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tidy(text: Column) -> Column:
    """Collapsed text without zero-width spaces, empty brackets, or blanks inside brackets and before punctuation."""
    return _rewrite(text, R.TIDY)


def heading(title: Column) -> Column:
    """A title without its section number and closing full stops or colons."""
    return _rewrite(title, R.HEADING)


def is_boilerplate(title: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(heading(title)), "’", "'"), "[.:]+$", "")
    return plain.rlike("^(?:" + "|".join(f"(?:{p})" for p in BOILERPLATE_HEADINGS) + ")$")


def is_numeric_marker(text: Column) -> Column:
    """A citation marker of numbers ("[1, 2]", "3-5") that is not a year alone."""
    marker = F.trim(text)
    return marker.rlike(f"^(?:{R.MARKER})$") & ~marker.rlike(f"^(?:{R.YEAR_MARKER})$")


def sentences(text: Column) -> Column:
    """Array of sentences. A boundary depends on a word and the next alone, so it is a predicate over neighbouring words.

    A word ends a sentence if it closes with a stop, the next word does not
    begin with a-z, and it is no abbreviation, initial or "e.g."-like form.
    """
    words = F.split(collapse(text), " ")
    following = F.concat(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))

    def mark(word: Column, after: Column) -> Column:
        core = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(word, _CLOSERS + "$", ""), "^[(\\[\"'“‘]+", ""), "[.!?]+$", ""))
        guarded = core.isin(ABBREVIATIONS) | core.rlike(r"^(?:[a-z]\.)+[a-z]$") | core.rlike(r"^\p{L}$")
        ends = word.rlike(r"[.!?]" + _CLOSERS + "$") & after.isNotNull() & ~F.coalesce(after, F.lit("")).rlike("^[a-z]") & ~guarded
        return F.when(ends, F.concat(word, F.lit("\u0001"))).otherwise(word)

    return F.filter(F.split(F.array_join(F.zip_with(words, following, mark), " "), "\u0001 "), lambda s: s != "")


def word_count(text: Column) -> Column:
    plain = collapse(text)
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " ")))


def tokenize(text: Column) -> Column:
    """Search tokens: lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """Distinct tokens worth marking: no stopwords, no single letters."""
    return F.filter(F.array_distinct(tokenize(query)), lambda t: ((F.length(t) > 1) | t.rlike("^[0-9]$")) & ~t.isin(STOPWORDS))


def numbers(sentence: Column) -> Column:
    """Distinct numbers, not those in names such as H1N1 or COVID-19, without thousands separators; "1,2" is two."""
    found = F.regexp_extract_all(sentence, F.lit(R.NUMBER), F.lit(0))
    plain = F.transform(found, lambda n: F.split(F.regexp_replace(n, r",(?=\d{3}(?!\d))", ""), ","))
    return F.array_distinct(F.filter(F.flatten(plain), lambda n: n != ""))


def fingerprint(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def index_header(title: Column, section: Column) -> Column:
    """Title and section, each closed by a stop; absent parts are left out."""
    def closed(part: Column) -> Column:
        return F.when(part != "", F.when(part.rlike("[.?!]$"), part).otherwise(F.concat(part, F.lit("."))))

    return F.concat_ws(" ", closed(title), closed(section))


def index_text(title: Column, section: Column, text: Column) -> Column:
    header = index_header(title, section)
    return F.concat_ws(" ", F.when(header != "", header), F.when(text != "", text))


def text_hash(header: Column, text: Column) -> Column:
    return fingerprint(F.concat(header, F.lit("\n"), text))


def opening(text: Column, words: int = 30) -> Column:
    """The first ``words`` words, with dots if more follow."""
    parts = F.split(collapse(text), " ")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, F.lit(" ...")).otherwise(F.lit("")))


def normalise_doi(value: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(value, r"\\_", "_"), f"({R.DOI})", 1)
    return F.when(found != "", F.lower(F.regexp_replace(found, "[.,;)]+$", "")))


def _fold(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts], dtype=object)


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without what is not ASCII then; only texts that need it leave the JVM."""
    return F.coalesce(F.pandas_udf(_fold, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalise_title(title: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces; accents are taken off."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(title)), "[^a-z0-9]+", " "))


def is_current(source: Column, line_start: Column, line_end: Column, stored: Column) -> Column:
    """Whether lines start..end of ``source`` still have the stored fingerprint."""
    lines = F.split(source, "\n")
    held = F.when((line_start >= 1) & (line_end >= line_start), F.slice(lines, F.greatest(line_start, F.lit(1)), F.greatest(line_end - line_start + 1, F.lit(0))))
    # A range that is none, or null, holds nothing.
    return F.coalesce(fingerprint(F.array_join(held, "\n")) == stored, F.lit(False))


def document_of(paper: Column, note: Column, section: Column) -> Column:
    """What a chunk is read in: its paper, its note, or the chapter that its section begins with."""
    return F.coalesce(paper, note, F.split(section, " > ")[0])


def source_label(name: Column, year: Column, citable: Column) -> Column:
    """How a source is named to people: its name, its year or n.d., and whether it may not be cited."""
    return F.concat(name, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"), F.when(F.coalesce(citable, F.lit(False)), F.lit("")).otherwise(F.lit(", not citable")))


def paper_of(key: Column, paper: Column) -> Column:
    """Which paper a chunk counts for: its citation key, else its paper."""
    return F.coalesce(F.nullif(key, F.lit("")), paper.cast("string"))


def note_line(line: Column) -> Column:
    """A line of a note as text; empty if only a quote mark or a plugin's boilerplate is left."""
    shown = F.regexp_replace(_rewrite(line, R.NOTE_MARKS), r"(?U)\s+$", "")
    core = F.btrim(shown, F.lit(" >"))
    return F.when((core == "") | core.rlike("^(?:" + "|".join(f"(?:{p})" for p in R.NOTE_BOILERPLATE) + ")$"), F.lit("")).otherwise(shown)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight(text: Column, terms: list[str]) -> Column:
    """Text as HTML with whole words of ``terms`` marked in any case. The words are framed before escaping, so that no entity is cut."""
    if not terms:
        return escape_html(text)
    words = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    framed = F.regexp_replace(text, rf"(?i)(?<![a-z0-9])({words})(?![a-z0-9])", "\ue000$1\ue001")
    return F.replace(F.replace(escape_html(framed), F.lit("\ue000"), F.lit("<mark>")), F.lit("\ue001"), F.lit("</mark>"))
