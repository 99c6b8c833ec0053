"""Sizes of the batches in which rows go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of texts or of lists of words in an Arrow batch.
TEXT_ROWS = 1000


def small_batches() -> None:
    """Texts go to Python in batches of at most TEXT_ROWS rows, so that what a worker holds doesn't grow with its partition.

    It lowers the active session's setting, which other queries share, and never raises it."""
    spark = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(name, "10000")) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
