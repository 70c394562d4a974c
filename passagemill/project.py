"""A project: a folder with papers, and what may lie beside them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

#: Names the project's folder; otherwise the nearest folder above that holds papers is taken.
VARIABLE = "PASSAGEMILL_PROJECT"


@dataclass(frozen=True)
class Project:
    """Paths of a project; collections exist as far as their sources do."""

    # The names that a project's files have.

    folder: Path
    store: Path

    @property
    def papers(self) -> Path:
        return self.folder / "data" / "manuscripts"

    @property
    def notes(self) -> Path:
        return self.folder / "data" / "notes"

    @property
    def bibliography(self) -> Path:
        return self.folder / "allpapers.bib"

    @property
    def book_record(self) -> Path:
        return self.folder / "thesis.fls"

    @property
    def reference_list(self) -> Path:
        return self.folder / "thesis.bbl"

    @property
    def overrides(self) -> Path:
        return self.folder / "key-overrides.csv"

    @property
    def collections(self) -> tuple[str, ...]:
        sources = {"library": self.papers.is_dir(), "thesis": self.book_record.is_file(), "notes": self.notes.is_dir()}
        return tuple(name for name, there in sources.items() if there)

    def table(self, name: str) -> str:
        return str(self.store / name)

    def required(self) -> Project:
        """The project itself, or an error if it has no papers."""
        if not self.papers.is_dir():
            raise FileNotFoundError(f"{self.folder} has no data/manuscripts; set {VARIABLE} or work inside the project")
        return self


def find(environ: Mapping[str, str] | None = None, here: Path | None = None, store: Path | None = None) -> Project:
    """The project that the environment names, else the nearest folder at or above ``here`` that holds papers, else ``here``."""
    environ, here = os.environ if environ is None else environ, (here or Path.cwd()).resolve()
    named = environ.get(VARIABLE)
    above = (folder for folder in (here, *here.parents) if (folder / "data" / "manuscripts").is_dir())
    folder = Path(named).expanduser().resolve() if named else next(above, here)
    return Project(folder, store or folder / ".passagemill")
