"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost
executor costs a re-read and never a recomputation of earlier stages.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_recorders: list[list[str]] = []
_written: list[str] = []


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """Collect the paths written inside the block, to be released once nothing reads them."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set and driver and executors are one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='passagemill-')}"
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    for paths in _recorders:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables and empty the list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        name = paths.pop()
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        for noted in (_written, *_recorders):
            if noted is not paths and name in noted:
                noted.remove(name)


def release_all(spark: SparkSession) -> None:
    """Delete every table written so far; call it once the results that read them have been stored."""
    release(spark, list(_written))


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for table in tables:
        release(spark, [f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]])
