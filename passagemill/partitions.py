"""Enough partitions for the cores at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes under which a scan is too small to be worth dealing out.
LEAST_BYTES = 1 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files, dealt out evenly if it has fewer partitions than the cluster has cores.

    Only small inputs, such as one file with one row group, have so few; a
    large table keeps the partitions of its files. ``scan`` must not hold a
    shuffle: its plan is asked for its partitions without running anything.
    """
    context, planned = scan.sparkSession.sparkContext, scan._jdf.queryExecution()
    if int(str(planned.optimizedPlan().stats().sizeInBytes())) < LEAST_BYTES:
        return scan
    cores, files = context.defaultParallelism, len(scan.inputFiles())
    return scan.repartition(cores) if files < cores else scan
