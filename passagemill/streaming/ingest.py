"""Incremental ingest: new texts of a stream are encoded once and appended to the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.functions import text as T
from passagemill.operators.vectors import encode_missing


def with_hashes(docs: DataFrame, title: str | None = None, section: str = "source") -> DataFrame:
    header = T.index_header(F.col(title) if title else F.lit(""), F.col(section))
    return docs.withColumn("header", header).withColumn("text_hash", T.text_hash(F.col("header"), F.coalesce("text", F.lit(""))))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The vector table, empty if it has not been written yet."""
    schema = "text_hash string, vector array<float>"
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def ingest_stream(docs: DataFrame, store_path: str, checkpoint: str, encoder=None, available_now: bool = True) -> StreamingQuery:
    """Append vectors of unseen texts. A batch that is replayed after a failure finds its texts stored and adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        store = read_store(batch.sparkSession, store_path)
        encode_missing(with_hashes(batch), store, encoder).write.mode("append").parquet(store_path)

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
