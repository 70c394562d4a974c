"""What other programs answer: each id is asked for once, and its outcome is stored, refusals included."""

from __future__ import annotations

import subprocess
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.shipping import ship_package
from passagemill.sources.stores import StampedTable

#: Requests under way at once, over the whole cluster: each task sends one after the other.
CONCURRENT = 4
OUTCOMES = "id string, content binary, failure string, error string"
#: A connector takes an id and what to send, and gives (content, None) or (None, why there is none). What it raises says nothing about the id.
Connector = Callable[[str, bytes | None], tuple[bytes | None, str | None]]


def _send(request: urllib.request.Request | str, timeout: float) -> tuple[int, bytes]:
    """Status and body of an answer of any status; TimeoutError if it does not come in time."""
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as answer:
        return answer.code, answer.read()
    except urllib.error.URLError as error:
        if isinstance(error.reason, TimeoutError):
            raise error.reason from error
        raise


@dataclass(frozen=True)
class Publisher:
    """Articles of an open-access repository by their id."""

    # The public service's address, and the statuses by which it says that it has no full text.
    address: str = "https://www.ebi.ac.uk/europepmc/webservices/rest"
    none_there: tuple[int, ...] = (404, 500)
    timeout: float = 60

    def __call__(self, article: str, content: bytes | None = None) -> tuple[bytes | None, str | None]:
        status, body = _send(f"{self.address}/{article}/fullTextXML", self.timeout)
        if status == 200:
            return body, None
        if status in self.none_there:
            return None, f"HTTP {status}"
        raise OSError(f"{self.address}: HTTP {status}")


@dataclass(frozen=True)
class LayoutParser:
    """A service that reads the layout of a PDF. While it is busy it is asked again, a little later each time."""

    address: str = "http://localhost:8070"
    timeout: float = 1800
    wait: float = 2
    # The service's options, the status of a busy one, and how often it is asked.
    options: tuple[tuple[str, str], ...] = (("consolidateHeader", "1"), ("consolidateCitations", "2"), ("includeRawCitations", "1"))
    busy: int = 503
    tries: int = 5

    def alive(self) -> bool:
        try:
            return _send(f"{self.address}/api/isalive", 5)[1].strip() == b"true"
        except OSError:
            return False

    def _form(self, name: str, pdf: bytes) -> urllib.request.Request:
        edge, quoted = uuid.uuid4().hex, name.replace('"', "%22").replace("\r", " ").replace("\n", " ")
        parts = [f'Content-Disposition: form-data; name="{k}"\r\n\r\n{v}'.encode() for k, v in self.options]
        parts.append(f'Content-Disposition: form-data; name="input"; filename="{quoted}"\r\nContent-Type: application/pdf\r\n\r\n'.encode() + pdf)
        body = b"".join(b"--%b\r\n%b\r\n" % (edge.encode(), part) for part in parts) + f"--{edge}--\r\n".encode()
        return urllib.request.Request(f"{self.address}/api/processFulltextDocument", body, {"Content-Type": f"multipart/form-data; boundary={edge}"})

    def __call__(self, name: str, content: bytes | None) -> tuple[bytes | None, str | None]:
        for turn in range(1, self.tries + 1):
            try:
                status, body = _send(self._form(name, content or b""), self.timeout)
            except TimeoutError:
                return None, f"timed out after {self.timeout} s"
            if status != self.busy or turn == self.tries:
                break
            time.sleep(self.wait * turn)
        return (body, None) if status == 200 else (None, f"HTTP {status}: {body.decode(errors='replace')[:500]}")


@dataclass(frozen=True)
class Command:
    """A program that every worker has, called with the id as its last word; what it prints is the content."""

    words: tuple[str, ...]
    timeout: float = 300

    def __call__(self, query: str, content: bytes | None = None) -> tuple[bytes | None, str | None]:
        return subprocess.run([*self.words, query], capture_output=True, check=True, timeout=self.timeout).stdout, None


def outcomes(spark: SparkSession, path: str, settings: str = "") -> StampedTable:
    """The stored outcomes of a connector; other ``settings`` make them void."""
    return StampedTable(spark, path, OUTCOMES, settings)


def fetch(wanted: DataFrame, stored: StampedTable, connector: Connector) -> DataFrame:
    """(id, content, failure, error), one row for each id of ``wanted`` (id, content).

    Ids with a content or a failure in ``stored`` are not asked for again. What
    goes wrong otherwise is that id's error, which stops no other id and is
    asked for again at the next call. Null ids are left out; of rows with one
    id any one is sent. A task that is run twice may ask twice.
    """
    spark = wanted.sparkSession
    ship_package(spark)
    known, ids = stored.read().filter("error IS NULL"), wanted.filter("id IS NOT NULL").dropDuplicates(["id"])
    missing = ids.join(known.select("id"), "id", "left_anti").select("id", "content")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, failure, error = None, None, None
                try:
                    found, failure = connector(name, content)
                except Exception as raised:  # noqa: BLE001 - any error belongs to its id
                    error = repr(raised)[:500]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([found], pa.binary()), pa.array([failure], pa.string()), pa.array([error], pa.string())], names=["id", "content", "failure", "error"])

    if not missing.isEmpty():
        # Files are long and answers slow, so few rows go to a worker at once.
        name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set(name, "4")
        try:
            stored.replace(known.unionByName(missing.repartition(CONCURRENT, "id").mapInArrow(ask, OUTCOMES)))
        finally:
            spark.conf.set(name, before)
    return stored.read().join(ids.select("id"), "id", "left_semi")


def ranked_lines(found: DataFrame) -> DataFrame:
    """(id, item, rank): the lines that a search program printed, best first; a line counts where it comes first."""
    lines = found.filter("content IS NOT NULL").select("id", F.posexplode(F.array_distinct(F.filter(F.transform(F.split(F.col("content").cast("string"), "\n"), F.trim), lambda x: x != ""))).alias("n", "item"))
    return lines.select("id", "item", (F.col("n") + 1).cast("long").alias("rank"))
