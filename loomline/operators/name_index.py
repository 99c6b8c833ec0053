"""A written trigram index of names: similar names without a scan.

Rows of one name are worked on once, and so are questions. The table has a row for each trigram of each name, in
buckets by the trigram's hash. Names whose similarity (shared trigrams over all distinct ones) passes a threshold t
share more than t * n of the question's n trigrams, so they hold one of any n - floor(t * n) of them: the rarest are
asked, and only their rows are read. Of these, names with too few or too many trigrams go; the others are verified by
all of theirs, and only then get their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from .fulltext import bucket_of

#: Buckets of the table.
BUCKETS = 64


def write(names: DataFrame, path: str, id_: str, name: str, buckets: int = BUCKETS) -> None:
    """Write the index of names: ids by name, the trigrams of each name once, and how many names have each. Null and empty names have none."""
    spark = names.sparkSession
    named = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(id_).alias("id")).withColumn("bucket", bucket_of(F.col("name"), buckets))
    # a frequent bucket's rows are split, so that no task writes all of them
    named.hint("rebalance", "bucket").sortWithinPartitions("bucket", "name").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/ids")
    once = spark.read.parquet(f"{path}/ids").select("name").distinct().withColumn("_t", T.trigrams(F.col("name")))
    rows = once.select(F.explode("_t").alias("term"), "name", F.size("_t").alias("size")).withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count("*").alias("names"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/counts")


def _codes(trigrams: Column) -> Column:
    """Each trigram (three ASCII characters) as a number, which is compared faster."""
    at = lambda x, i: F.ascii(F.substring(x, i, 1))
    return F.transform(trigrams, lambda x: (at(x, 1) * 256 + at(x, 2)) * 256 + at(x, 3))


def asked(questions: DataFrame, counts: DataFrame, id_: str, name: str, threshold: float) -> DataFrame:
    """(question, term, bucket, _t): of each question's trigrams the rarest that are enough; one that no name has is the rarest."""
    cut = questions.select(F.col(id_).alias("question"), T.trigrams(F.col(name)).alias("_t")).where(F.size("_t") > 0)
    each = cut.select("question", "_t", F.explode("_t").alias("term")).join(counts, "term", "left")
    rare = Window.partitionBy("question").orderBy(F.coalesce("names", F.lit(0)), "term")
    enough = F.size("_t") - F.floor(F.size("_t") * threshold + 1e-9)
    return each.withColumn("_r", F.row_number().over(rare)).where(F.col("_r") <= enough).where("names IS NOT NULL").select("question", "term", "bucket", "_t")


def similar(spark: SparkSession, path: str, questions: DataFrame, id_: str, name: str, threshold: float = 0.3, k: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(question, id, name, similarity) of names whose similarity to a question's name is over the threshold, the k best of each, if asked.

    The numbers of the asked trigrams' buckets (at most `buckets`) are collected, so that other buckets' files aren't opened."""
    every = questions.where(F.col(name).isNotNull()).select(F.col(name).alias("asked"), F.col(id_).alias("question"))
    texts = every.select("asked").distinct()
    all_terms = texts.select(F.explode(T.trigrams(F.col("asked"))).alias("term")).select(bucket_of(F.col("term"), buckets).alias("b")).distinct()
    counts = spark.read.parquet(f"{path}/counts").where(F.col("bucket").isin([r.b for r in all_terms.collect()]))
    want = asked(texts.select("asked", F.col("asked").alias("_n")), counts, "asked", "_n", threshold).withColumn("n", F.size("_t"))
    read = sorted(r.bucket for r in want.select("bucket").distinct().collect())
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(read))
    met = rows.join(want.select("bucket", "term", F.col("question").alias("asked"), "n"), ["bucket", "term"])
    near = met.where((F.col("size") >= F.col("n") * threshold - 1e-9) & (F.col("size") * threshold <= F.col("n") + 1e-9)).select("asked", "name").distinct()
    held = spark.read.parquet(f"{path}/ids").select("id", "name")
    sides = (held.select("name").distinct(), "name", "_a"), (texts, "asked", "_b")
    for side, by, codes in sides:
        near = near.join(side.withColumn(codes, _codes(T.trigrams(F.col(by)))), by)
    near = near.select("asked", "name", F.size(F.array_intersect("_a", "_b")).alias("_i"), (F.size("_a") + F.size("_b")).alias("_n"))
    pairs = near.select("asked", "name", F.round(F.col("_i") / (F.col("_n") - F.col("_i")), 6).alias("similarity")).where(F.col("similarity") > threshold)
    once = held.distinct()
    if k is not None:  # no more than the k least of a name can be among the best
        once = once.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("_r") <= k).drop("_r")
    found = pairs.join(once, "name")
    if k is not None:
        best = Window.partitionBy("asked").orderBy(F.desc("similarity"), "id")
        found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    return found.join(every.distinct(), "asked").select("question", "id", "name", "similarity")
