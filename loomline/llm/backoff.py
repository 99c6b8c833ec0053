"""Stupid-backoff scores of texts under a bigram model of the whole corpus.

Words are lower-cased (A-Z) runs of ASCII letters, digits and characters outside ASCII; every word of the
corpus counts. A text begins after a start symbol. A text is scored under the pairs of all other texts:
with n(u v) the occurrences of a pair less those in the text itself, and n(u), n(v) those of words in all
texts, the score of a word v after u is n(u v) / n(u) if n(u v) > 0, else BACKOFF * n(v) / all words; a
text's score is the sum of logarithms. (Under its own pairs too, a text never backs off.)

Counts are relational. Texts are exploded to rows (text, n-gram, times), partitioned by the hash of the
n-gram; there each n-gram is counted, and each row gets what other texts have of it; what the rows add is
summed by text. Words of over 1 / HOT_WORDS of all words (at most so many) have short numbers, and tasks
get their counts; the counts of the others are a table, joined by the word's hash. Pairs of over
1 / HOT_PAIRS of all pairs are counted first: every stretch of a task's pairs offers those of over half
that share in it, so that no such pair is missed and at most twice as many are counted exactly. They go
to the tasks and are added before the shuffle, so no n-gram's rows are many.

Defined results: null texts and texts without words have no words, score 0 and a null mean; rows that
share an id are scored each and added up; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import Tables, small_batches

#: Words and pairs that tasks are given outright: those with over 1 / HOT_WORDS and 1 / HOT_PAIRS of all.
HOT_WORDS, HOT_PAIRS = 2_000_000, 100_000
BACKOFF = 0.4
#: Distinct pairs of a stretch, about.
HELD = 700_000
#: Kinds of rows: a pair, a word that is not frequent, what a text scores without the others, its number of words; of counts: texts with words.
PAIR, WORD, SCORE, COUNT, TEXTS = range(5)
_RARE = 1 << 62
_START = np.uint64(0x5151515151515151)


def _hash(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(2) | np.uint64(_RARE)).astype(np.int64)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, of the pair that ends in it, and the first word of each text."""
    data = K.LOWER[data]
    starts, ends = K.spans(K.ALNUM[data], offs)
    h, first = K.run_hashes(data, starts, ends), K.owners(starts, offs)[0]
    before = np.concatenate(([_START], h[:-1])) if len(h) else h
    before[first[:-1][first[:-1] < first[1:]]] = _START
    return _hash(h), _hash(K.mix(K.mix(before) * np.uint64(3) + h)), first


class Words:
    """hashes: sorted, of the frequent words, whose numbers are their places; counts: of them; total: of all words; texts: with words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, texts: int):
        self.hashes, self.total = hashes, total
        self.logs = np.log(np.append(counts, max(texts, 1)).astype(float))  # the last: of the start symbol
        self.off = math.log(BACKOFF) - math.log(max(total, 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of a frequent word, the hash of another (_RARE and more)."""
        if not len(self.hashes):
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, hashes)

    def log(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the counts of frequent words, 0 for others."""
        return np.where(x < _RARE, self.logs[np.minimum(x, len(self.hashes))], 0.0)


def _added(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, with the sums of n."""
    if not len(n):
        return columns, n
    order = np.lexsort(columns)
    columns, n = [c[order] for c in columns], n[order]
    at = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))))
    return [c[at] for c in columns], np.add.reduceat(n, at)


def _batch(kind: int | np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int8(kind), len(h))), pa.array(h), pa.array(n)], ["kind", "h", "n"])


def first_counts(docs: DataFrame, text: str = "text", hot_pairs: int = HOT_PAIRS, held: int = HELD) -> DataFrame:
    """(kind, h, n): how often each word occurs, how many texts have words, and which pairs may be frequent (with a part of their count)."""

    def count(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        tokens = 0

        def offered(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal tokens
            if not end and sum(len(p) for p, _ in parts) <= held:
                return
            (p,), n = _added([np.concatenate([x for x, _ in parts])], np.concatenate([x for _, x in parts]))
            parts[:] = [(p, n)]
            if end or 2 * len(p) > held:
                many = n > tokens / (2 * hot_pairs)
                yield _batch(PAIR, p[many], n[many])
                parts.clear()
                tokens = 0

        for batch in batches:
            each, texts = [], 0
            for _, _, data, offs in K.slices(batch.column(0)):
                h, p, first = _words(data, offs)
                texts += int((np.diff(first) > 0).sum())
                each.append(np.unique(h, return_counts=True))
                parts.append(np.unique(p, return_counts=True))
                tokens += len(p)
                yield from offered(False)
            if each:
                (h,), n = _added([np.concatenate([x for x, _ in each])], np.concatenate([x for _, x in each]))
                yield _batch(WORD, h, n)
            yield _batch(TEXTS, np.zeros(1, np.int64), np.array([texts]))
        if parts:
            yield from offered(True)

    return docs.select(F.col(text).alias("t")).mapInArrow(count, "kind byte, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, hot_words: int = HOT_WORDS) -> Words:
    """At most `hot_words` rows reach the driver."""
    sums = dict(map(tuple, counts.where(F.col("kind") != PAIR).groupBy("kind").agg(F.sum("n")).collect()))
    total = sums.get(WORD, 0)
    top = counts.where((F.col("kind") == WORD) & (F.col("n") > total / hot_words)).select("h", "n").toArrow().sort_by("h")
    h, n = (np.asarray(top.column(i).combine_chunks()) for i in range(2)) if len(top) else (np.zeros(0, np.int64),) * 2
    return Words(h, n, total, sums.get(TEXTS, 0))


def frequent_pairs(docs: DataFrame, counts: DataFrame, total: int, text: str = "text", hot_pairs: int = HOT_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and exact counts of the pairs that may be frequent: at most twice hot_pairs rows on the driver."""
    offered = counts.where((F.col("kind") == PAIR) & (F.col("n") >= total / (2 * hot_pairs))).select("h").toArrow().sort_by("h")
    keys = np.asarray(offered.column(0).combine_chunks()) if len(offered) else np.zeros(0, np.int64)
    if not len(keys):
        return keys, keys

    def count(batches):
        n = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, data, offs in K.slices(batch.column(0)):
                p = _words(data, offs)[1]
                at = np.minimum(np.searchsorted(keys, p), len(keys) - 1)
                n += np.bincount(at[keys[at] == p], minlength=len(keys))
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(n[some])], ["h", "n"])

    exact = docs.select(F.col(text).alias("t")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow().sort_by("h")
    return tuple(np.asarray(exact.column(i).combine_chunks()) for i in range(2))


def _exploded(texts: DataFrame, words: Words, pairs: tuple[np.ndarray, np.ndarray], rare: bool) -> DataFrame:
    """Rows of texts (id, t): (id, kind, key, x), and of rare n-grams more.

    Not rare: pairs of frequent words, x times each, key u << 32 | v (the start symbol behind the last number); what a text scores without the rows of
    this and the other kind; how many words it has. Rare: pairs with another word (key: their hash; u, v; base: what seen pairs add but for log n and
    the counts of words that are not frequent), and the words that are not frequent (u)."""
    keys, n = pairs
    few = len(words.hashes)

    def own_keys(at: int, size: int, salt: int) -> np.ndarray:
        """Keys that are dealt evenly and met by no other row."""
        return K.mix((at + np.arange(size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)).view(np.int64)

    def explode(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, end, data, offs in K.slices(batch.column(1)):
                h, p, first = _words(data, offs)
                texts = np.arange(end - at)
                row, v = np.repeat(texts, np.diff(first)), words.numbers(h)
                u = np.concatenate(([few], v[:-1])) if len(v) else v
                u[first[:-1][first[:-1] < first[1:]]] = few
                odd = (u >= _RARE) | (v >= _RARE)
                if rare:
                    one = np.flatnonzero(v >= _RARE)
                    (row1, w), often = _added([row[one], v[one]], np.ones(len(one), np.int64))
                    (row, p, u, v), times = _added([row[odd], p[odd], u[odd], v[odd]], np.ones(int(odd.sum()), np.int64))
                    kinds = np.repeat(np.array((PAIR, WORD), np.int8), (len(row), len(w)))
                    none = np.zeros(len(w), np.int64)
                    base = np.concatenate((-words.log(u) - words.log(v) - words.off, none))
                    rows, columns = np.concatenate((row, row1)) + at, [kinds, np.concatenate((p, own_keys(at, len(w), len(data)))), np.concatenate((times, often)).astype(float), np.concatenate((u, w)), np.concatenate((v, none)), base]
                else:
                    score = np.bincount(row, words.off + words.log(v), minlength=end - at)
                    (row, u, v, p), times = _added([row[~odd], u[~odd], v[~odd], p[~odd]], np.ones(int((~odd).sum()), np.int64))
                    place = np.minimum(np.searchsorted(keys, p), max(len(keys) - 1, 0))
                    hot = keys[place] == p if len(keys) else np.zeros(len(p), bool)
                    left = n[place[hot]] - times[hot]  # in other texts
                    gain = np.log(np.maximum(left, 1)) - words.logs[u[hot]] - words.logs[v[hot]] - words.off
                    score += np.bincount(row[hot], np.where(left > 0, times[hot] * gain, 0.0), minlength=end - at)
                    own = own_keys(at, len(texts), len(data))
                    kinds = np.repeat(np.array((PAIR, SCORE, COUNT), np.int8), (int((~hot).sum()), len(texts), len(texts)))
                    rows, columns = np.concatenate((row[~hot], texts, texts)) + at, [kinds, np.concatenate((u[~hot] << 32 | v[~hot], own, own)), np.concatenate((times[~hot], score, np.diff(first))).astype(float)]
                for a in range(0, len(rows), 1 << 17):
                    part = slice(a, a + (1 << 17))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[part])), *(pa.array(c[part]) for c in columns)], names)

    names = ["id", "kind", "key", "x", *(["u", "v", "base"] if rare else [])]
    return texts.mapInArrow(explode, f"id {texts.schema['id'].dataType.simpleString()}, kind byte, key long, x double" + ", u long, v long, base double" * rare)


def _seen(grams: DataFrame) -> DataFrame:
    """grams with n: the occurrences of a pair in all texts; pairs that no other text has are left out."""
    counted = grams.withColumn("n", F.sum("x").over(Window.partitionBy("key")))
    return counted.where((F.col("kind") != PAIR) | (F.col("n") > F.col("x")))


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS, held: int = HELD) -> DataFrame:
    """(key, n_words, score, mean_score) of each id."""
    small_batches(docs.sparkSession)
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    counts = tables.put(first_counts(docs, text, hot_pairs, held))
    words = frequent_words(counts, hot_words)
    hot = frequent_pairs(docs, counts, words.total, text, hot_pairs)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    kind, x, few = F.col("kind"), F.col("x"), len(words.hashes)

    # rare n-grams: what they add, and how often the logarithm of a word's count does
    part = lambda w, c: F.struct(w.cast("long").alias("w"), c.alias("c"))
    pair = F.array(part(F.lit(None), x * (F.log(F.col("n") - x) + F.col("base"))), part(F.col("u"), -x), part(F.col("v"), -x))
    pair = F.filter(pair, lambda s: s.w.isNull() | (s.w >= _RARE))
    odd = _seen(_exploded(texts, words, hot, True)).select("id", F.explode(F.when(kind == PAIR, pair).otherwise(F.array(part(F.col("u"), x)))).alias("s"))
    odd = tables.put(odd.groupBy("id", "s.w").agg(F.sum("s.c").alias("c")))
    rare = counts.where((kind == WORD) & (F.col("n") <= words.total / hot_words)).select("h", F.log("n").alias("log"))
    logs = odd.where("w IS NOT NULL").join(rare, F.col("w") == F.col("h")).select("id", (F.col("c") * F.col("log")).alias("add"))

    # pairs of frequent words: their counts by the words' numbers, a table of at most hot_words + 1 rows
    known = spark.createDataFrame(pa.table({"h": np.arange(few + 1), "log": words.logs}))
    log_of = lambda n: F.broadcast(known.select(F.col("h").alias(f"_{n}"), F.col("log").alias(f"log_{n}")))
    seen = _seen(_exploded(texts, words, hot, False))
    # what isn't a pair takes the place of the start symbol, which is always there
    u, v = (F.when(kind == PAIR, c).otherwise(few) for c in (F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit((1 << 32) - 1))))
    seen = seen.join(log_of("u"), u == F.col("_u")).join(log_of("v"), v == F.col("_v"))
    adds = F.when(kind == SCORE, x).when(kind == PAIR, x * (F.log(F.col("n") - x) - F.col("log_u") - F.col("log_v") - words.off))
    every = seen.select("id", F.when(kind == COUNT, x).alias("words"), adds.alias("add"))
    for more in (odd.where("w IS NULL").select("id", F.lit(None).cast("double"), "c"), logs.select("id", F.lit(None).cast("double"), "add")):
        every = every.union(more)
    total = every.groupBy("id").agg(F.sum("words").cast("long").alias("n_words"), F.sum("add").alias("score"))
    return total.select(F.col("id").alias(key), "n_words", "score", (F.col("score") / F.when(F.col("n_words") > 0, F.col("n_words"))).alias("mean_score"))


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT r, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY p), ' start') AS u FROM t),
one AS (SELECT w, count(*) AS n FROM t GROUP BY w UNION ALL SELECT ' start', count(DISTINCT r) FROM t),
total AS (SELECT count(*) AS n FROM t),
two AS (SELECT u, w, count(*) AS n FROM g GROUP BY u, w),
own AS (SELECT r, u, w, count(*) AS n FROM g GROUP BY r, u, w),
s AS (SELECT r, sum(own.n) AS n, sum(own.n * CASE WHEN two.n > own.n THEN ln((two.n - own.n) / cu.n) ELSE ln({BACKOFF} * cw.n / total.n) END) AS score
  FROM own JOIN two ON own.u = two.u AND own.w = two.w JOIN one cu ON cu.w = own.u JOIN one cw ON cw.w = own.w, total GROUP BY r),
x AS (SELECT doc_id, sum(coalesce(n, 0)) AS n, sum(coalesce(score, 0.0)) AS score FROM d LEFT JOIN s USING (r) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, round(score, 4) AS score, round(score / CASE WHEN n > 0 THEN n END, 6) AS mean_score FROM x
"""
