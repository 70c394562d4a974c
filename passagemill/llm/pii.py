"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give base spans, which always stay. Where a pattern swallows two
neighbours at once (a phone number and the card number after it) or a form is
written another way, its match fails; there the field decides. It scores whole
candidate segments (digit groups, separators, checksums, cues before the span,
what surrounds it) and a dynamic program over segments of bounded length picks
boundaries and types together. Weights are learned from sentences that
``training_sentences`` composes.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.partitions import spread
from passagemill.shipping import ship_package

KINDS = ("email", "ip", "card", "phone")
#: Tokens in the longest segment that the dynamic program considers.
MAX_TOKENS = 24
#: Digits that a card or phone segment has.
MIN_DIGITS, MAX_DIGITS = 7, 19

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile(r"[0-9][0-9\x20().+-]*")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^0-9]")
_DISGUISED = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{1,63}){1,8}")
_DISGUISE = re.compile(r"\((?:at|dot)\)|\[(?:at|dot)\]| dot ")
_CUES = {
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "card": ("card", "visa", "credit", "mastercard", "pay"),
    "ip": ("ip", "host", "address", "server"),
    "none": ("version", "order", "isbn", "date", "no", "id", "invoice", "page"),
}
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Every match holds exactly one "@" after its local part, so "@" is looked for first.
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind number, end), sorted, and the runs of digits and their separators."""
    found = [(s, 0, e) for s, e in _emails(text)]
    runs = []
    for run in _RUN.finditer(text):
        low, high = run.span()
        runs.append((low, high))
        if high - low < 7:
            continue
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text, low, high) if all(int(part) <= 255 if len(part) < 19 else int(part.lstrip("0") or 0) <= 255 for part in m.group().split("."))]
        for m in _CARD.finditer(text, low, high):
            if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, low - (low > 0 and text[low - 1] == "+"), high):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found), runs


def _numeric_candidates(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Segments of whole tokens that begin with a digit, "+" or "(" and end with a digit, not glued to letters or digits."""
    tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
    found = []
    for i, (start, _) in enumerate(tokens):
        if text[start] not in "0123456789+(" or (start and (text[start - 1].isalnum() or text[start - 1] == "+")):
            continue
        digits = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, b = tokens[j]
            if not text[a].isdigit():
                continue
            digits += b - a
            if digits > MAX_DIGITS:
                break
            if digits >= MIN_DIGITS and not (b < len(text) and text[b].isalnum()):
                found.append((start, b))
            elif 4 <= digits and text.count(".", start, b) == 3 and not (b < len(text) and text[b].isalnum()):
                found.append((start, b))
    return found


def span_features(text: str, start: int, end: int) -> dict[str, list[str]]:
    """Features of a segment for each kind it may be."""
    span = text[start:end]
    before = _WORD_BEFORE.search(text[max(0, start - 24) : start])
    word = before.group(1).lower() if before else ""
    cue = next((k for k, words in _CUES.items() if word in words), "other")
    shared = [f"cue={cue}", f"after={_side(text, end)}", f"before={_side(text, start - 1)}"]
    if any(c.isalpha() for c in span):
        return {"email": [*shared, f"signs={len(_DISGUISE.findall(span))}", f"at={'@' in span or '(at)' in span or '[at]' in span or ' at ' in span}", f"end={len(re.split('[^A-Za-z]', span)[-1]) in range(2, 7)}"]}
    digits = _digits(span)
    groups = re.findall("[0-9]+", span)
    separators = "".join(sorted(set(re.sub("[0-9]", "", span))))
    open_close = span.count("(") == span.count(")")
    shape = "-".join(str(len(g)) for g in groups[:6])
    found = {
        "card": [*shared, f"digits={len(digits)}", f"luhn={luhn(digits)}", f"valid={luhn(digits) and 13 <= len(digits) and separators in ('', ' ', '-', '.')}", f"separators={separators}", f"groups={min(len(groups), 6)}", f"even={len({len(g) for g in groups[:-1]} | {len(groups[0])}) == 1}"],
        "phone": [*shared, f"digits={len(digits)}", f"plus={span[0] == '+'}", f"closed={open_close}", f"separators={separators}", f"shape={shape}", f"plain={span.isdigit()}", f"long_group={max(map(len, groups)) > 8}", f"whole={span[0] == '+' and 9 <= len(digits) <= 15 and open_close and len(groups) > 1 and max(map(len, groups)) <= 8}"],
    }
    if len(groups) == 4 and re.fullmatch(r"[0-9]+(?: ?\. ?[0-9]+){3}", span):
        found["ip"] = [*shared, f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}", f"spaced={' ' in span}", "four"]
    return found


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "digit" if c.isdigit() else c if c in ".,;:()-+/=\"'" else "other"


@dataclass
class Segments:
    """Positions (boundaries in the text, sorted) and candidate segments between them."""

    cuts: list[int]
    arcs: list[tuple[int, int, str, list[str]]]  # from cut, to cut, kind, features


def lattice(text: str, spans: list[tuple[int, int]]) -> Segments:
    cuts = sorted({x for span in spans for x in span})
    place = {x: k for k, x in enumerate(cuts)}
    arcs = [(place[a], place[b], kind, features) for a, b in sorted(set(spans)) for kind, features in span_features(text, a, b).items()]
    return Segments(cuts, arcs)


def _arc_score(weights: dict[str, float], kind: str, features: list[str]) -> float:
    return weights.get(kind, 0.0) + sum(weights.get(f"{kind}|{f}", 0.0) for f in features)


def decode(weights: dict[str, float], lat: Segments) -> list[tuple[int, int, str]]:
    """The best segmentation: skipping costs nothing, a segment pays its score; of equal ones the shorter and earlier segment."""
    best, back = [0.0] * len(lat.cuts), [None] * len(lat.cuts)
    into: dict[int, list] = {}
    for arc in lat.arcs:
        into.setdefault(arc[1], []).append(arc)
    for k in range(1, len(lat.cuts)):
        best[k] = best[k - 1]
        for a, _, kind, features in into.get(k, ()):
            score = best[a] + _arc_score(weights, kind, features)
            if score > best[k] + 1e-12:
                best[k], back[k] = score, (a, kind)
    found, k = [], len(lat.cuts) - 1
    while k > 0:
        if back[k]:
            found.append((lat.cuts[back[k][0]], lat.cuts[k], back[k][1]))
            k = back[k][0]
        else:
            k -= 1
    return found[::-1]


def _marginals(weights: dict[str, float], lat: Segments) -> list[float]:
    """Probability of each arc, by forward and backward sums over all segmentations."""
    n = len(lat.cuts)
    scores = [_arc_score(weights, kind, features) for _, _, kind, features in lat.arcs]
    into, out = [[] for _ in range(n)], [[] for _ in range(n)]
    for k, (a, b, _, _) in enumerate(lat.arcs):
        into[b].append(k)
        out[a].append(k)

    def total(terms: list[float]) -> float:
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    forward, backward = [0.0] * n, [0.0] * n
    for k in range(1, n):
        forward[k] = total([forward[k - 1], *(forward[lat.arcs[x][0]] + scores[x] for x in into[k])])
    for k in range(n - 2, -1, -1):
        backward[k] = total([backward[k + 1], *(backward[lat.arcs[x][1]] + scores[x] for x in out[k])])
    return [math.exp(forward[a] + s + backward[b] - forward[-1]) for (a, b, _, _), s in zip(lat.arcs, scores, strict=True)]


def training_sentences(count: int = 400, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with personal data in many forms, side by side and apart, and with numbers that are none."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = r.choice("3456") + number(r.choice((12, 13, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        if len(d) != 16 or r.random() < 0.5:
            return d
        return r.choice(" -.").join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice((f"+{number(r.choice((1, 2)))} ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"+{number(1)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"))

    def ip() -> str:
        return r.choice((".", ".", " . ")).join(str(r.randrange(1, 256)) for _ in range(4))

    def email() -> str:
        return f"{r.choice(('ana', 'bo.li', 'kim42'))}{r.choice((' (at) ', ' [at] ', '(at)', ' at '))}{r.choice(('mail', 'post8'))}{r.choice((' dot ', ' (dot) ', '[dot]'))}{r.choice(('com', 'org', 'example'))}"

    def nothing() -> str:
        bad = number(r.randrange(7, 19))
        while luhn(bad):
            bad = number(r.randrange(7, 19))
        return r.choice((bad, f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{number(4)} {number(2)}", f"{number(3)}-{number(4)}", f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"{number(3)} {number(3)} {number(3)}", f"{number(8)}.{number(2)}", f"{r.randrange(300, 999)}.{r.randrange(300, 999)}.{number(3)}.{number(2)}", f"({number(4)}) {number(4)}"))

    makers = {"card": card, "phone": phone, "ip": ip, "email": email, None: nothing}
    rows = []
    for _ in range(count):
        text, gold = r.choice(("", "the ", "so ")), []
        for _ in range(r.choice((1, 2, 2, 3))):
            kind = r.choice(("card", "phone", "phone", "card", "ip", "email", None, None, None))
            cue = r.choice(_CUES[kind]) + r.choice((" ", ": ")) if kind in _CUES and r.random() < 0.3 else r.choice(_CUES["none"]) + " " if kind is None and r.random() < 0.5 else ""
            piece = makers[kind]()
            text += cue
            if kind:
                gold.append((len(text), len(text) + len(piece), kind))
            text += piece + r.choice((" ", " ", " and then ", ". ", ", "))
        rows.append((text + "end", gold))
    return rows


def all_candidates(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found = []
    for low, high in runs:
        while low and text[low - 1] in "+(":
            low -= 1
        if high - low >= 7:
            found += _numeric_candidates(text, low, high)
    if _DISGUISE.search(text):
        found += [m.span() for m in _DISGUISED.finditer(text)]
    return found


def train(sentences: list[tuple[str, list[tuple[int, int, str]]]], passes: int = 12, rate: float = 0.5, penalty: float = 1e-3) -> dict[str, float]:
    """Weights that maximise the conditional likelihood, by AdaGrad steps."""
    examples = []
    for text, gold in sentences:
        lat = lattice(text, all_candidates(text, [m.span() for m in _RUN.finditer(text)]))
        if lat.arcs:
            wanted = set(gold)
            examples.append((lat, [(lat.cuts[a], lat.cuts[b], kind) in wanted for a, b, kind, _ in lat.arcs]))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(passes):
        for lat, truth in examples:
            slope: dict[str, float] = {}
            for (_, _, kind, features), p, t in zip(lat.arcs, _marginals(weights, lat), truth, strict=True):
                if (d := t - p) and abs(d) > 1e-6:
                    for name in (kind, *(f"{kind}|{f}" for f in features)):
                        slope[name] = slope.get(name, 0.0) + d
            for name, d in slope.items():
                d -= penalty * weights.get(name, 0.0)
                squares[name] = squares.get(name, 0.0) + d * d
                weights[name] = weights.get(name, 0.0) + rate * d / math.sqrt(squares[name] + 1e-9)
    return weights


def added_spans(text: str, base: list[tuple[int, int, int]], runs: list[tuple[int, int]], weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """Spans of the field that touch no base span."""
    candidates = all_candidates(text, runs)
    if not candidates:
        return []
    taken = sorted((s, e) for s, _, e in base)
    free, k, reach = [], 0, -1
    for a, b in sorted(candidates):
        while k < len(taken) and taken[k][0] <= a:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= a and (k == len(taken) or taken[k][0] >= b):
            free.append((a, b))
    if not free:
        return []
    return [(s, KINDS.index(kind), e) for s, e, kind in decode(weights, lattice(text, free))]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end lists).

    Positions are code points, ends exclusive. Null text is empty; texts of any
    length are read whole; repeated rows are rows like any others; of
    segmentations with equal scores the one with shorter and earlier segments
    wins; an empty table gives an empty result; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learned = train(training_sentences()) if weights is None else weights

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base, runs = base_spans(text)
                more = added_spans(text, base, runs, learned)
                counts = [sum(k == n for _, k, _ in base) for n in range(4)]
                rows.append((*counts, _listed(base), _listed(sorted([*base, *more]))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return docs.mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def brute_force_base(text: str) -> str:
    """The base spans by the patterns as they are stated, for tests."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(_digits(m.group())) <= 19 and luhn(_digits(m.group()))]
    spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return _listed(sorted(spans))


def base_digest(text: str) -> str:
    return hashlib.sha256(brute_force_base(text).encode()).hexdigest()
