"""python -m passagemill.serving.tools: a project's collections as tools of a language model, by JSON-RPC lines on the standard streams."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable
from typing import IO

from pyspark.sql import DataFrame, SparkSession

from passagemill import project as projects
from passagemill.serving import build, library

#: Fixed value: the version of the Model Context Protocol that is spoken when the client names none.
PROTOCOL = "2024-11-05"
_CODES = {"parse": -32700, "method": -32601, "arguments": -32602}


def _number(low: int, high: int, default: int) -> dict:
    return {"type": "integer", "minimum": low, "maximum": high, "default": default}


_TEXT, _HITS = {"type": "string"}, (1, library.MAX_HITS)
TOOLS = {
    "search_library": ("Passages of papers that answer a question, best first.", {"question": _TEXT, "k": _number(*_HITS, 8), "citable_only": {"type": "boolean", "default": True}}, "library"),
    "search_thesis": ("Paragraphs of the book that are like a text; current tells whether the file still holds them.", {"text": _TEXT, "k": _number(*_HITS, 5)}, "thesis"),
    "search_notes": ("Passages of notes that are like a text; current tells whether the file still holds them.", {"text": _TEXT, "k": _number(*_HITS, 8)}, "notes"),
    "get_context": ("The passage with an id and its neighbours in reading order.", {"chunk_id": _TEXT, "window": _number(0, library.MAX_WINDOW, 1)}, None),
}


class Wrong(ValueError):
    """Arguments that do not fit a tool's schema."""


def checked(schema: dict, arguments: dict) -> dict:
    """Arguments with defaults filled in."""
    if extra := set(arguments) - set(schema):
        raise Wrong(f"unknown arguments: {', '.join(sorted(extra))}")
    full = {}
    for name, rule in schema.items():
        value = arguments.get(name, rule.get("default"))
        kind = {"string": str, "integer": int, "boolean": bool}[rule["type"]]
        if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            raise Wrong(f"{name} must be of type {rule['type']}")
        if kind is int and not rule["minimum"] <= value <= rule["maximum"]:
            raise Wrong(f"{name} must be from {rule['minimum']} to {rule['maximum']}")
        full[name] = value
    return full


class Server:
    """Answers one request after the other, so that a collection is never loaded twice at once."""

    def __init__(self, at: projects.Project, shelf: library.Shelf):
        self.at, self.shelf = at, shelf

    def _there(self) -> dict[str, tuple]:
        return {name: tool for name, tool in TOOLS.items() if tool[2] is None or tool[2] in self.at.collections}

    def call(self, name: str, arguments: dict) -> list[dict]:
        """The rows that a tool gives."""
        if name not in self._there():
            raise Wrong(f"unknown tool {name}")
        _, schema, kind = TOOLS[name]
        given = checked(schema, arguments)
        if name == "search_library":
            found = library.search_library(self.shelf.get(kind), given["question"], given["k"], given["citable_only"])
        elif kind:
            found = library.search_lines(self.shelf.get(kind), kind, given["text"], str(self.at.folder), given["k"])
        else:
            found = self._context(given["chunk_id"], given["window"])
        return [row.asDict(recursive=True) for row in found.collect()]

    def _context(self, chunk_id: str, window: int) -> DataFrame:
        held = [self.shelf.get(name) for name in self.at.collections]
        near = library.get_context(held, chunk_id, window)
        kind = next(c.name for c in held if not c.chunks.filter(c.chunks["chunk_id"] == chunk_id).isEmpty())
        sources = None if kind == "library" else library.sources_of(near.sparkSession, str(self.at.folder), near)
        ordered = near.select("pos", "chunk_id")
        return library.shaped(near, kind, sources).join(ordered, "chunk_id").orderBy("pos").drop("pos", "rank")

    def answer(self, request: dict) -> dict | None:
        """The answer to a request, or None to a notification."""
        method, given = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        known: dict[str, Callable[[], dict]] = {
            "initialize": lambda: {"protocolVersion": given.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "passagemill", "version": "1"}},
            "ping": dict,
            "tools/list": lambda: {"tools": [_described(name, *tool) for name, tool in self._there().items()]},
            "tools/call": lambda: self._told(given),
        }
        if method not in known:
            return {**reply, "error": {"code": _CODES["method"], "message": f"no method {method}"}}
        try:
            return {**reply, "result": known[method]()}
        except Wrong as error:
            return {**reply, "error": {"code": _CODES["arguments"], "message": str(error)}}

    def _told(self, given: dict) -> dict:
        try:
            rows = self.call(given.get("name", ""), given.get("arguments") or {})
        except Wrong:
            raise
        except Exception as error:  # noqa: BLE001 - a tool's failure is an answer
            return {"content": [{"type": "text", "text": str(error)}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(row, ensure_ascii=False, default=str)} for row in rows], "isError": False}

    def serve(self, lines: Iterable[str], out: IO[str]) -> None:
        for line in filter(str.strip, lines):
            try:
                request = json.loads(line)
                reply = self.answer(request) if isinstance(request, dict) else None
            except json.JSONDecodeError as error:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": _CODES["parse"], "message": str(error)}}
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


def _described(name: str, told: str, schema: dict, kind: str | None) -> dict:
    return {"name": name, "description": told, "inputSchema": {"type": "object", "properties": schema, "required": [n for n, rule in schema.items() if "default" not in rule]}, "annotations": {"readOnlyHint": True}}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--project", help="the project's folder")
    options = parser.parse_args(arguments)
    at = projects.find(None if options.project is None else {projects.VARIABLE: options.project}).required()
    spark = spark or SparkSession.builder.appName("passagemill").getOrCreate()
    Server(at, build.shelf(spark, at)).serve(sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
