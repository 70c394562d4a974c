"""Send this package to the Python workers of executors, which need not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows in an Arrow batch, unless the session sets them: texts of a batch are held whole, several times over, in the executor and in its Python workers.
BATCH_ROWS = 1_000


def ship_package(spark: SparkSession) -> None:
    """Add a zip of the package to the application once, and bound the session's Arrow batches where it leaves Spark's default."""
    context = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(BATCH_ROWS))
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="passagemill-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "passagemill.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(path)
    _sent.add(context.applicationId)
