"""Connectors against a server on this machine, adding papers, and the tools of a built project."""

import io
import json
import sys
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from passagemill import project as projects
from passagemill.serving import add, build, gather, tools
from passagemill.sources import remote, stores

JATS = "<article><front><article-meta><title-group><article-title>Owls of the north</article-title></title-group></article-meta></front><body><sec><title>Results</title><p>Owls hunt voles at night in the forest.</p></sec></body></article>"
TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Moss</title></titleStmt></fileDesc></teiHeader><text><body><div><head>Results</head><p>Moss holds water in peat.</p></div></body></text></TEI>'


@pytest.fixture(scope="module")
def service():
    asked, bodies = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status, body):
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            asked[self.path] += 1
            known = {"/PMC1/fullTextXML": (200, JATS), "/PMC2/fullTextXML": (404, ""), "/PMC3/fullTextXML": (429, "later"), "/api/isalive": (200, "true")}
            self.reply(*known.get(self.path, (404, "")))

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            bodies.append(body)
            name = body.split(b'filename="')[1].split(b'"')[0].decode()
            asked[name] += 1
            if name == "bad.pdf":
                self.reply(400, "no text")
            else:
                self.reply(503 if asked[name] < 3 or name == "busy.pdf" else 200, TEI)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, bodies
    server.shutdown()


def test_outcomes_are_stored_and_errors_asked_for_again(spark, service, tmp_path):
    address, asked, _ = service
    stored, wanted = remote.outcomes(spark, str(tmp_path / "o")), spark.createDataFrame([("PMC1", None), ("PMC1", None), ("PMC2", None), ("PMC3", None), (None, None)], "id string, content binary")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for turn in (1, 2):
        rows = {r.id: r for r in remote.fetch(wanted, stored, remote.Publisher(address)).collect()}
        assert set(rows) == {"PMC1", "PMC2", "PMC3"} and bytes(rows["PMC1"].content).decode() == JATS
        assert rows["PMC2"].failure == "HTTP 404" and rows["PMC2"].error is None and rows["PMC3"].content is None and "429" in rows["PMC3"].error
        assert [asked[f"/PMC{k}/fullTextXML"] for k in (1, 2, 3)] == [1, 1, turn]
    assert remote.fetch(wanted.limit(0), stored, remote.Publisher(address)).count() == 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in (int(batch), 1000)


def test_layout_parser(service):
    address, asked, bodies = service
    parser = remote.LayoutParser(address, wait=0)
    assert parser.alive() and not remote.LayoutParser("http://127.0.0.1:1").alive()
    assert parser("late.pdf", b"%PDF \x00") == (TEI.encode(), None) and asked["late.pdf"] == 3
    assert b"%PDF \x00" in bodies[-1] and b'name="consolidateCitations"\r\n\r\n2' in bodies[-1]
    assert parser("bad.pdf", b"") == (None, "HTTP 400: no text") and asked["bad.pdf"] == 1
    assert parser("busy.pdf", b"")[1].startswith("HTTP 503") and asked["busy.pdf"] == 5
    with pytest.raises(OSError):
        remote.LayoutParser("http://127.0.0.1:1", wait=0)("x.pdf", b"")


def test_a_search_program_as_a_baseline(spark, tmp_path):
    program = remote.Command((sys.executable, "-c", "import sys; q = sys.argv[1]; sys.exit(1) if q == 'no' else print(q, 'b', '', q, sep='\\n')"))
    found = remote.fetch(spark.createDataFrame([("a", None), ("no", None)], "id string, content binary"), remote.outcomes(spark, str(tmp_path / "c")), program)
    assert sorted(map(tuple, remote.ranked_lines(found).collect())) == [("a", "a", 1), ("a", "b", 2)]
    assert found.filter("id = 'no'").first().error.startswith("CalledProcessError")


def test_papers_are_added_from_articles_and_served(spark, service, tmp_path, capsys):
    address, asked, _ = service
    papers = tmp_path / "p" / "data" / "manuscripts"
    papers.mkdir(parents=True)
    (papers / "Ash 2001 - Owls.md").write_text("# Owls\n- PMCID: PMC1\n## Extracted Full Text\n## Page 1\nPlain.\n")
    at = projects.find({projects.VARIABLE: str(tmp_path / "p")})
    with pytest.raises(FileNotFoundError):
        add.resolved("none.pdf", at, tmp_path)
    (tmp_path / "here.txt").write_text("x")
    assert add.resolved("here.txt", at, tmp_path) == str((tmp_path / "here.txt").resolve()) and add.resolved("10.1/x", at, tmp_path) == "10.1/x"
    asking = gather.Connectors(remote.Publisher(address), remote.LayoutParser(address, wait=0))
    build.ingest(spark, at, connectors=asking)
    script = "import sys, pathlib; d = pathlib.Path('data/manuscripts'); (d / 'Elm 2002 - Moss.md').write_text('# Moss\\n## Extracted Full Text\\n## Page 1\\nPlain.\\n'); (d / 'Elm 2002 - Moss.pdf').write_bytes(b'%PDF'); sys.exit(3)"
    status, told = add.add(spark, at, [sys.executable, "-c", script], ["x"], Path.cwd(), asking)
    assert status == 3 and len(told) == 1 and "(grobid, key none): Moss" in told[0]
    rows = {r.source_file: r for r in stores.read_papers(build.paper_table(spark, at)).collect()}
    assert rows["Ash 2001 - Owls.md"].source == "jats" and rows["Ash 2001 - Owls.md"].title == "Owls of the north"
    assert rows["Elm 2002 - Moss.md"].sections[0]["paragraphs"][0]["text"].startswith("Moss holds water")

    server, out = tools.Server(at, build.shelf(spark, at)), io.StringIO()
    call = lambda number, tool, **given: json.dumps({"jsonrpc": "2.0", "id": number, "method": "tools/call", "params": {"name": tool, "arguments": given}})
    lines = [json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize"}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/list"})]
    lines += [call(2, "search_library", question="owls hunting voles", citable_only=False), call(3, "search_library", question="x", k=21), call(4, "search_notes", text="x"), call(5, "get_context", chunk_id="none"), "{", json.dumps({"id": 6, "method": "no"})]
    server.serve(lines, out)
    replies = [json.loads(line) for line in out.getvalue().splitlines()]
    by_id = {r["id"]: r for r in replies}
    assert len(replies) == 8 and by_id[0]["result"]["serverInfo"]["name"] == "passagemill"
    assert [t["name"] for t in by_id[1]["result"]["tools"]] == ["search_library", "get_context"]
    hit = json.loads(by_id[2]["result"]["content"][0]["text"])
    assert hit["source_file"] == "Ash 2001 - Owls.md" and by_id[3]["error"]["code"] == by_id[4]["error"]["code"] == -32602
    assert by_id[5]["result"]["isError"] and by_id[None]["error"]["code"] == -32700 and by_id[6]["error"]["code"] == -32601
    near = server.call("get_context", {"chunk_id": hit["chunk_id"], "window": 0})
    assert [r["chunk_id"] for r in near] == [hit["chunk_id"]] and "score" not in near[0]
