"""A table in buckets of a key's hash, into which batches are merged: a batch rewrites only the buckets that it changes.

A bucket is a partition of a Parquet folder. A merge reads the buckets of the batch's keys, puts the new rows of each key in
place of all its old ones, keeps the result under spark.checkpoint.dir, and then overwrites the buckets whose rows have changed.
Merging the same batch again therefore changes nothing, and a merge that broke off is made good by merging its batch again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

#: Buckets of a table; choose them so that one is a few hundred MB.
BUCKETS = 64


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's rows; None before its first merge."""
    where, files = _files(spark, f"{path}/rows")
    return spark.read.parquet(f"{path}/rows").drop("_bucket") if files.exists(where) and any(s.getPath().getName().startswith("_bucket=") for s in files.listStatus(where)) else None


def merge(path: str, keys: DataFrame, rows: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """Put rows (key, ...) in place of all that the keys (key) had; keys without rows go. Returns the numbers of the buckets that changed.

    Keys may repeat; a null key is a key like any other. What is collected is a number for each bucket of the batch."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    keys = cut(keys.select(key).union(rows.select(key)).distinct().withColumn("_bucket", bucket))
    touched = sorted(r[0] for r in keys.select("_bucket").distinct().collect())
    if not touched:
        return []
    new = rows.withColumn("_bucket", bucket)
    old = None
    if current(spark, path) is not None:
        old = spark.read.parquet(f"{path}/rows").where(F.col("_bucket").isin(touched))
        other = keys.select(F.col(key).alias("_key"))
        new = old.join(other, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new)
    new = cut(new)

    def signs(table: DataFrame) -> dict[int, tuple]:
        h = F.xxhash64(*sorted(c for c in table.columns if c != "_bucket"))
        return {r[0]: tuple(r)[1:] for r in table.groupBy("_bucket").agg(F.count("*"), F.sum(h % 1_000_000_007), F.bit_xor(h)).collect()}

    before, after = signs(old) if old is not None else {}, signs(new)
    changed = [b for b in touched if before.get(b) != after.get(b)]
    written = [b for b in changed if b in after]
    if written:
        part = new.where(F.col("_bucket").isin(written)).repartition("_bucket")
        part.write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
    for b in changed:
        if b not in after:  # nothing is left of it, and an overwrite doesn't remove what it doesn't write
            where, files = _files(spark, f"{path}/rows/_bucket={b}")
            files.delete(where, True)
    return changed
