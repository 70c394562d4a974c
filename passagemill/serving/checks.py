"""Readiness and freshness: what a project lacks before it can be searched."""

from __future__ import annotations

import shutil
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from passagemill.operators import vectors

#: Free disk under which a project is not ready, in GB.
LEAST_DISK_GB = 5


def waiting(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_file) of the files that the last ingestion has not seen."""
    return files.select("source_file").join(manifest.select("source_file"), "source_file", "left_anti")


@dataclass
class Finding:
    name: str
    ok: bool
    detail: str
    required: bool = True

    def __str__(self) -> str:
        return f"{'ok' if self.ok else 'MISSING' if self.required else 'missing':<8} {self.name:<18} {self.detail}"


def library(files: DataFrame, manifest: DataFrame | None, papers: int) -> Finding:
    """Whether every file is in the manifest."""
    if manifest is None:
        return Finding("library", False, "not built yet", required=False)
    new = waiting(files, manifest).count()
    return Finding("library", not new, f"{papers} papers, " + (f"{new} new files not ingested" if new else "up to date"), required=False)


def index(collections: dict[str, tuple[DataFrame, dict[str, DataFrame]]]) -> Finding:
    """Whether every chunk of every collection has a vector of every model."""
    gaps = [f"{n} {name} chunks without {model}" for name, (chunks, stores) in collections.items() for model, store in stores.items() if (n := vectors.lacking(chunks, store).count())]
    return Finding("index", not gaps, "; ".join(gaps) or "up to date", required=False)


def disk(folder: str, least_gb: float = LEAST_DISK_GB) -> Finding:
    free = shutil.disk_usage(folder).free / 1e9
    return Finding("disk", free >= least_gb, f"{free:.0f} GB free")


def report(checks: Sequence[Callable[[], Finding]]) -> tuple[list[str], bool]:
    """The lines of all checks, and whether nothing required is missing. A check that fails is a finding as well."""
    lines, ready = [], True
    for check in checks:
        try:
            found = check()
        except Exception as error:  # noqa: BLE001 - whatever goes wrong is what the report is for
            found = Finding(getattr(check, "__name__", "check"), False, str(error)[:120])
        lines.append(str(found))
        ready &= found.ok or not found.required
    return lines, ready
