"""HTML page of answers: the hits of each question, then each document they are from, once."""

from __future__ import annotations

import html
from datetime import datetime
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.serving.library import Answer, Collection

_STYLE = "body{font-family:sans-serif;max-width:60em;margin:auto}article,.chunk{margin:1em 0}.found{background:#fffbe0}.quiet{color:#666}"


def label(row) -> str:
    """Where a passage is from: key and year of a paper, else file or document and lines."""
    shown = row.asDict()
    if shown.get("line_start") is not None:
        return f"{shown.get('file') or shown['document']}:{shown['line_start']}-{shown['line_end']}"
    name = f"{shown.get('key') or shown['document']} ({shown.get('year') or 'n.d.'})"
    return name if shown.get("citable", True) else f"{name}, not citable"


def file_links(shown: dict, folder: str | None = None, vault: str | None = None) -> list[tuple[str, str]]:
    """(name, address) of a passage's DOI and of the files that it is from, as far as they are known."""
    links = []
    if folder and (source := shown.get("source_file")):
        base = Path(folder) / "data" / "manuscripts"
        links += [("PDF", (base / source).with_suffix(".pdf").as_uri()), ("Markdown", (base / source).as_uri())]
    if folder and shown.get("file"):
        name = "Markdown" if shown.get("note") else "LaTeX"
        links.append((name, (Path(folder) / shown["file"]).as_uri() + (f"#L{shown['line_start']}" if shown.get("line_start") else "")))
    if vault and shown.get("note"):
        links.append(("Obsidian", f"obsidian://open?vault={quote(vault, safe='')}&file={quote(str(shown['note']), safe='')}"))
    if shown.get("doi"):
        links.append(("DOI", f"https://doi.org/{shown['doi']}"))
    return links


def render(collection: Collection, answers: list[Answer], folder: str | None = None, vault: str | None = None) -> str:
    """The page; only the documents of hits are read, and terms are marked by Spark."""
    documents = list(dict.fromkeys(hit["document"] for a in answers for hit in a.hits))
    terms = sorted({t for a in answers for t in a.terms})
    chunks = collection.chunks.filter(F.col("document").isin(documents)).withColumn("html", T.highlight(F.coalesce("text", F.lit("")), terms))
    rows = chunks.select("document", "pos", "chunk_id", "section", "html").orderBy("pos").collect() if documents else []
    marked = {r.chunk_id: r.html for r in rows}
    found: dict[str, list[str]] = {}
    out = []
    for n, a in enumerate(answers, 1):
        out.append(f'<h2>{n}. {html.escape(a.question)}</h2><p class="quiet">{a.seconds:.2f} s</p>')
        out += [] if a.hits else ['<p class="quiet">No hits.</p>']
        for hit in a.hits:
            found.setdefault(hit["chunk_id"], []).append(f"q{n} #{hit['rank']}")
            places = ", ".join(f"{m} {p}" for m, p in sorted(hit["ranks"].items()))
            link = "".join(f' · <a href="{html.escape(address)}">{name}</a>' for name, address in file_links(hit.asDict(), folder, vault))
            out.append(
                f'<article><b>{hit["rank"]}</b> {hit["score"]:.3f} <b>{html.escape(label(hit))}</b> {html.escape(hit["section"] or "")}'
                f'<div class="quiet">{html.escape(places)} · <a href="#{html.escape(hit["chunk_id"])}">in context</a>{link}</div><p>{marked[hit["chunk_id"]]}</p></article>'
            )
    out.append("<h2>In context</h2>")
    for document in documents:
        inside = [r for r in rows if r.document == document]
        hits = sum(r.chunk_id in found for r in inside)
        out.append(f"<details open><summary>{html.escape(str(document))} · {len(inside)} chunks, {hits} found</summary>")
        for r in inside:
            mark = ", ".join(found.get(r.chunk_id, []))
            out.append(f'<div class="chunk{" found" if mark else ""}" id="{html.escape(r.chunk_id)}"><span class="quiet">{mark} {html.escape(r.section or "")}</span><p>{r.html}</p></div>')
        out.append("</details>")
    count = f"{len(answers)} question{'' if len(answers) == 1 else 's'}"
    head = f'<meta charset="utf-8"><title>Search results</title><style>{_STYLE}</style>'
    return f"<!doctype html><html><head>{head}</head><body><h1>{html.escape(collection.name)}</h1><p>{count}</p>{''.join(out)}</body></html>"


def write(page: str, folder: str) -> Path:
    """Save a page under a name made of the time; no earlier page is overwritten."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"search-{datetime.now():%Y%m%d-%H%M%S-%f}.html"
    path.write_text(page, encoding="utf-8")
    return path


def results_table(rows: list, numbers: dict[str, float] | None = None) -> str:
    """Markdown table of evaluation rows (config, metric, mean, low, high)."""
    metrics = list(dict.fromkeys(r["metric"] for r in rows))
    cells = {(r["config"], r["metric"]): f"{r['mean']:.2f} ({r['low']:.2f}–{r['high']:.2f})" for r in rows}
    head = ["configuration", *metrics, *(["numbers"] if numbers is not None else [])]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for config in dict.fromkeys(r["config"] for r in rows):
        share = [] if numbers is None else [f"{numbers[config]:.2f}" if numbers.get(config) is not None else "–"]
        lines.append("| " + " | ".join([config, *(cells.get((config, m), "–") for m in metrics), *share]) + " |")
    return "\n".join(lines)


def signed(mean: float, low: float, high: float) -> str:
    """A difference with its interval."""
    return f"{mean:+.2f} ({low:+.2f} to {high:+.2f})"
