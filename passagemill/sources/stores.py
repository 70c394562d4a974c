"""Tables that are replaced as a whole, and stamped with what they were made by.

A new version is written in full beside the others; then one small file, the
pointer, is renamed over its predecessor. Readers see the old version or the
new one, never a part. An earlier version stays until the next replacement, so
that a reader that has planned on it can finish.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "CURRENT"


@dataclass
class StampedTable:
    """``stamp`` describes what made the rows, such as a model's settings; rows made by another stamp count as absent."""

    spark: SparkSession
    path: str
    schema: str
    stamp: str = ""

    def _files(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def pointer(self) -> dict | None:
        files, place = self._files(_POINTER)
        if not files.exists(place):
            return None
        stream = files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> str | None:
        """Changes whenever the table is replaced."""
        current = self.pointer()
        return current and current["version"]

    def read(self) -> DataFrame:
        """The rows; none if the table is missing, was made by another stamp, or lost files since."""
        current = self.pointer()
        if current and current["stamp"] == self.stamp:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{current['version']}")
            if rows.count() == current["rows"]:
                return rows
        return self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> int:
        """Write a new version and point at it; the number of its rows."""
        before, version = self.pointer(), f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        count = self.spark.read.parquet(f"{self.path}/{version}").count()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        files, new = self._files(f"{_POINTER}.{version}")
        stream = files.create(new, True)
        stream.write(bytearray(json.dumps({"version": version, "stamp": self.stamp, "rows": count, "previous": before and before["version"]}).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, self._files(_POINTER)[1], options)
        if before and before.get("previous"):
            files, old = self._files(before["previous"])
            files.delete(old, True)
        return count

    def add(self, rows: DataFrame) -> int:
        """A new version with more rows."""
        return self.replace(self.read().unionByName(rows))


def write_papers(store: StampedTable, papers: DataFrame) -> int:
    """Replace the papers; how many earlier ones are gone."""
    earlier = store.read().select("paper_id").distinct()
    gone = earlier.join(papers.select("paper_id"), "paper_id", "left_anti").count()
    store.replace(papers)
    return gone


def read_papers(store: StampedTable) -> DataFrame:
    return store.read().orderBy("paper_id")


VECTORS = "text_hash string, vector array<float>"


def vector_store(spark: SparkSession, folder: str, collection: str, model: str, settings: str) -> StampedTable:
    """The vectors of a collection by a model; other settings of the model make them stale."""
    return StampedTable(spark, f"{folder}/vectors/{collection}/{model}", VECTORS, settings)


def halved(vectors: DataFrame) -> DataFrame:
    """Vectors with the precision of 16-bit floats: eleven significant bits."""
    scale = lambda x: F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 10)
    rounded = F.transform("vector", lambda x: F.when(x == 0, x).otherwise(F.rint(x / scale(x)) * scale(x)).cast("float"))
    return vectors.withColumn("vector", rounded)
