"""Operational and retrieval metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def latency(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, exact interpolated percentiles, mean, least and most. Percentiles are found by narrowing ranges, so that no task holds a group."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    p = quantiles(rows, by, value, (0.5, 0.95, 0.99)).select(*[F.col(c).alias(f"_{c}") for c in by], *(F.round(f"q{i}", 6).alias(x) for i, x in enumerate(("p50", "p95", "p99"))))
    return out.join(p, [out[c].eqNullSafe(p[f"_{c}"]) for c in by]).select(*by, "n", "p50", "p95", "p99", "mean", "least", "most")


def recent(rows: DataFrame, ts: str, id_: str, span: str, most: int) -> DataFrame:
    """The newest rows, at most so many, inside a span before the last."""
    last = rows.agg(F.max(ts).alias("_last"))
    inside = rows.join(F.broadcast(last), F.expr(f"{ts} > _last - {span}")).drop("_last")
    return inside.orderBy(F.desc(ts), id_).limit(most)


def bucket(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    out = F.when(value < steps[0][0], steps[0][1])
    for below, name in steps[1:]:
        out = out.when(value < below, name)
    return out.otherwise(rest)


def sessions(rows: DataFrame, user: str, ts: str, id_: str, gap: str) -> DataFrame:
    """(user, sessions, events): a session begins after a gap."""
    before = rows.withColumn("_b", F.lag(ts).over(Window.partitionBy(user).orderBy(ts, id_)))
    new = F.coalesce(F.expr(f"{ts} - _b > {gap}"), F.lit(True))
    return before.groupBy(user).agg(F.count_if(new).alias("sessions"), F.count("*").alias("events"))


def first_places(ranked: DataFrame, query: str, item: str, rank: str) -> DataFrame:
    """ranked with only the first place of each item, ranked anew."""
    first = ranked.groupBy(query, item).agg(F.min(rank).alias("_r"))
    return first.select(query, item, F.row_number().over(Window.partitionBy(query).orderBy("_r")).alias(rank))


def retrieval(ranked: DataFrame, gold: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """(query, n_gold, hit_k, recall_k, mrr) of each query with gold items."""
    hits = ranked.join(gold, [query, item]).groupBy(query).agg(F.min(rank).alias("_first"), F.count_if(F.col(rank) <= k).alias("_in"))
    out = gold.groupBy(query).agg(F.count("*").alias("n_gold")).join(hits, query, "left")
    return out.select(
        query, "n_gold", F.coalesce((F.col("_first") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}"), F.round(F.coalesce("_in", F.lit(0)) / F.col("n_gold"), 6).alias(f"recall_{k}"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("mrr")
    )


def compare(rows: DataFrame, by: str, arm: str, value: str) -> DataFrame:
    """Means of arms a and b, their change, absolute and in percent, whether it is over 5 %, and a verdict."""
    m = rows.groupBy(by).pivot(arm, ["a", "b"]).agg(F.avg(value))
    percent = (F.col("b") - F.col("a")) / F.col("a") * 100
    return m.select(
        by, F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("b") - F.col("a"), 6).alias("change"), F.round(percent, 4).alias("percent"),
        (F.abs(percent) > 5).alias("notable"), F.when(F.col("b") > F.col("a"), "better").when(F.col("b") < F.col("a"), "worse").otherwise("same").alias("verdict"),
    )


def perfect_rate(rows: DataFrame, by: str, checks: Sequence[Column]) -> DataFrame:
    every = checks[0]
    for c in checks[1:]:
        every = every & c
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(every.cast("int")), 6).alias("perfect"))


def best_mode(rows: DataFrame, by: str, mode: str, value: str, modes: Sequence[str]) -> DataFrame:
    """Means by mode side by side, and the best mode; the first wins a tie."""
    m = rows.groupBy(by).pivot(mode, list(modes)).agg(F.avg(value))
    most = F.greatest(*modes)
    best = F.lit(None).cast("string")
    for name in reversed(modes):
        best = F.when(F.col(name) == most, name).otherwise(best)
    return m.select(by, *(F.round(x, 6).alias(x) for x in modes), best.alias("best"))


def fingerprint(ranked: DataFrame, query: str, name: Column, rank: str) -> DataFrame:
    """(query, fingerprint): the first 16 hex digits of SHA-1 over the names in rank order."""
    lists = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank), name.alias("_name")))).alias("_l"))
    return lists.select(query, F.substring(F.sha1(F.array_join("_l._name", "|")), 1, 16).alias("fingerprint"))


def without_nan(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, least and most of the values that are numbers, and their share."""
    x = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(by).agg(F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x.isNotNull().cast("int")), 6).alias("success"))


def hit_rate(rows: DataFrame, by: Sequence[str], hit: str) -> DataFrame:
    """(by, n, hits, rate): how often a cache was hit."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.avg(F.col(hit).cast("int")), 6).alias("rate"))


def retrieval_at(ranked: DataFrame, gold: DataFrame, query: str, item: str, rank: str, ks: Sequence[int]) -> DataFrame:
    """(query, hit_k and recall_k of each k, mrr) of all queries of ranked; null for those without gold items."""
    first = F.min(rank).alias("_first")
    hits = ranked.join(gold, [query, item]).groupBy(query).agg(first, *[F.count_if(F.col(rank) <= k).alias(f"_in{k}") for k in ks])
    n = gold.groupBy(query).agg(F.count("*").alias("_n"))
    out = ranked.select(query).distinct().join(n, query, "left").join(hits, query, "left")
    known = F.col("_n").isNotNull()
    columns = [F.when(known, F.coalesce((F.col("_first") <= k).cast("int"), F.lit(0))).alias(f"hit_{k}") for k in ks]
    columns += [F.when(known, F.round(F.coalesce(f"_in{k}", F.lit(0)) / F.col("_n"), 6)).alias(f"recall_{k}") for k in ks]
    return out.select(query, *columns, F.when(known, F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6)).alias("mrr"))


def averages(rows: DataFrame, but: Sequence[str]) -> DataFrame:
    """The mean of every column but those, over the rows that have it, in one row."""
    return rows.agg(*[F.round(F.avg(c), 6).alias(c) for c in rows.columns if c not in but], F.count("*").alias("n"))


def coverage(edges: DataFrame, evidence: DataFrame, keys: Sequence[str], weight: str, least: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(relations_total, relations_with_evidence, evidence_coverage_pct) in one row, and the heaviest edges without evidence."""
    marked = edges.join(evidence.select(*keys).distinct().withColumn("_e", F.lit(True)), list(keys), "left").withColumn("_e", F.coalesce("_e", F.lit(False)))
    share = marked.agg(F.count("*").alias("relations_total"), F.count_if("_e").alias("relations_with_evidence"), F.coalesce(F.round(F.avg(F.col("_e").cast("int")) * 100, 4), F.lit(0.0)).alias("evidence_coverage_pct"))
    return share, marked.where(~F.col("_e") & (F.col(weight) >= least)).orderBy(F.desc(weight), *keys).limit(most).select(*keys, weight)


def document_name(path: Column) -> Column:
    """A document's name for matching: of a path or address the last part, decoded, in small letters; null if nothing is left."""
    x = F.trim(path)
    x = F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.regexp_replace(F.regexp_replace(x, r"^[^:]+://[^/?#]*", ""), r"[?#].*$", "")).otherwise(x)
    x = F.regexp_replace(F.translate(F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x), "\\", "/"), "/+$", "")
    x = F.lower(F.trim(F.element_at(F.split(x, "/"), -1)))
    return F.when(x != "", x)


def document_variants(path: Column) -> Column:
    """Names under which a document may be known: with and without its ending, and each without joining signs."""
    name = document_name(path)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    both = F.array_distinct(F.array(name, stem))
    compact = F.filter(F.transform(both, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")), lambda x: x != "")
    return F.when(name.isNotNull(), F.array_distinct(F.concat(both, F.transform(compact, lambda x: F.concat(F.lit("compact:"), x))))).otherwise(F.array().cast("array<string>"))


def document_sets(expected: Column, retrieved: Column) -> Column:
    """struct<matched, missed, extra> of arrays of paths: how many expected documents are among the retrieved by any of their names, how many are not, and how many were not asked for."""
    names = lambda paths: F.transform(paths, document_variants)
    found = lambda own, others: F.size(F.filter(names(own), lambda x: F.exists(names(others), lambda y: F.arrays_overlap(x, y))))
    return F.struct(found(expected, retrieved).alias("matched"), (F.size(expected) - found(expected, retrieved)).alias("missed"), (F.size(retrieved) - found(retrieved, expected)).alias("extra"))


def set_quality(expected: Column, found: Column) -> Column:
    """struct<precision, recall, noise> of two arrays as sets; nothing found has precision 0, nothing expected recall 1."""
    e, f = F.array_distinct(expected), F.array_distinct(found)
    both = F.size(F.array_intersect(e, f))
    precision = F.when(F.size(f) > 0, F.round(both / F.size(f), 6)).otherwise(0.0)
    return F.struct(precision.alias("precision"), F.when(F.size(e) > 0, F.round(both / F.size(e), 6)).otherwise(1.0).alias("recall"), F.when(F.size(f) > 0, F.round(1 - both / F.size(f), 6)).otherwise(0.0).alias("noise"))


# Words that are no keywords.
KEYWORD_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "must", "can", "could", "of", "in", "to", "for", "with", "on",
    "at", "from", "by", "about", "as", "into", "through", "during", "before", "after", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other",
    "some", "such", "no", "only", "own", "same", "than", "too", "very", "that", "this", "these", "those", "it", "its", "what", "which", "who", "whom", "how", "when", "where", "why", "if", "then", "also", "just",
)


def keywords(text: Column, most: int = 6) -> Column:
    """The first distinct words of three letters or more that are no stop words, in small letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][\p{L}\p{N}_\-]*)"), 1)
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*KEYWORD_STOPWORDS))), 1, most)


def keyword_hits(expected: Column, content: Column, most: int = 8) -> Column:
    """struct<keywords, hits>: how many keywords of an expected answer there are, and how many the content holds."""
    words = keywords(expected, most)
    return F.struct(F.size(words).alias("keywords"), F.size(F.filter(words, lambda w: F.contains(F.lower(content), w))).alias("hits"))


def rolling(rows: DataFrame, ts: str, by: Sequence[str], seconds: int, value: str) -> DataFrame:
    """rows with n and mean of the same `by` inside the last so many seconds, itself included."""
    w = Window.partitionBy(*by).orderBy(F.col("_s")).rangeBetween(-seconds, 0)
    timed = rows.withColumn("_s", F.unix_timestamp(F.col(ts).cast("timestamp")))
    return timed.withColumn("n", F.count("*").over(w)).withColumn("mean", F.round(F.avg(value).over(w), 6)).drop("_s")
