"""Tables in the folder that all executors share, which cut a job's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of texts in an Arrow batch.
TEXT_ROWS = 1000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that the driver and all executors share. Where it is unset, a session on one machine gets a temporary one; any other has to set it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of at most TEXT_ROWS rows, so that two or three batches in flight stay small beside an executor's heap.

    It lowers the session's setting, which other queries share, and never raises it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def free(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Tables:
    """Written tables of one run of an operator. They are removed by drop(), or when Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{folder(spark)}/loomline-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._remove, self.root)

    def put(self, df: DataFrame) -> DataFrame:
        """df, written and read again. The shuffle files of the write go once it is done."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.root.split(":")[-1] in path:
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already; the files are then left
            pass
