"""Document quality from a linear-chain CRF over lines.

Each line with a word is described by binned measures (length, words, shares of capitals, digits
and signs, repetition inside the line, whether the line comes again in its text) of itself and of
its neighbours. The CRF labels every line good or bad; the lines of a labelled text all get its
label for training. A text's raw quality is the mean of its lines' forward-backward marginals of
good, weighted by their bytes; a logistic curve fitted on the same labelled texts turns it into a
score. Texts without words count as one empty line.

Defined results: null and empty texts get the score of the empty line; labels that are null are
left out, several labels of a text count by their least; with labels of one kind only (or none)
every score is the share of good labels (1 without labels). Long texts are worked on whole, in slices;
repeated rows get the same score each; an empty table gives no rows. Columns named like the results are
replaced; all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf as C
from . import kernels as K
from .shared import free, small_batches

#: Labelled texts to learn from, at most (the first by a hash of the key).
FIT_TEXTS = 3000
#: Lines of a text that are learned from, at most: of a longer one a run of so many, begun at a place that its number of lines gives.
FIT_LINES = 256
_BINS = 8
#: Lines of a chain in training; longer texts are cut into several chains.
_CHAIN = 64
_MEASURES = 13
_UPPER, _DIGIT, _SIGN, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SIGN[list(b".,'\"-:;()?")] = False
_STOP[list(b".!?")] = True


def measure(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines, their bytes, and the first line of each text."""
    starts, ends = K.spans(data != 10, offs)
    word_at, word_end = K.spans(K.NOT_WHITE[data], offs)
    # words never span lines: a line break is white space
    line_of = np.searchsorted(starts, word_at, "right") - 1
    words = np.bincount(line_of, minlength=len(starts))
    keep = words > 0
    renumber = np.cumsum(keep) - 1
    starts, ends, words, line_of = starts[keep], ends[keep], words[keep], renumber[line_of]
    n = len(starts)
    size = (ends - starts).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[data])))
        return (total[ends] - total[starts]).astype(float)

    hashes = K.run_hashes(data, word_at, word_end)
    own = K.mix(hashes + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(line_of[np.unique(own, return_index=True)[1]], minlength=n)
    same_line = line_of[1:] == line_of[:-1]
    repeats = np.bincount(line_of[1:][same_line & (hashes[1:] == hashes[:-1])], minlength=n)
    twos = K.mix(own[:-1] * np.uint64(3) + own[1:])[same_line]
    two_line = line_of[1:][same_line]
    two_distinct = np.bincount(two_line[np.unique(twos, return_index=True)[1]], minlength=n)
    first, owner = K.owners(starts, offs)
    line_hash = K.mix(K.run_hashes(data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(line_hash, return_inverse=True, return_counts=True)
    letters = np.maximum(size - words, 1)
    out = np.stack(
        [
            np.log2(size),
            np.log2(words),
            (size - words) / words,
            share(_UPPER) / letters,
            share(_DIGIT) / letters,
            share(_SIGN) / letters,
            share(_SIGN) / words,
            share(_STOP) / words,
            distinct / words,
            repeats / words,
            np.minimum(count[back] if n else np.zeros(0), 3),
            _STOP[data[ends - 1]].astype(float) if n else np.zeros(0),
            np.where(words > 1, two_distinct / np.maximum(words - 1, 1), 1.0),
        ],
        axis=1,
    )
    empty = np.flatnonzero(np.diff(first) == 0)
    if len(empty):  # one line of zeros for each text without words
        out = np.insert(out, first[empty], 0.0, axis=0)
        size = np.insert(size, first[empty], 1.0)
        first = first + np.concatenate(([0], np.cumsum(np.diff(first) == 0)))
    return out, size, first


@dataclass(frozen=True)
class Quality:
    """edges: of each measure's bins; slope, shift: of the logistic curve over the raw quality's log-odds."""

    edges: tuple[np.ndarray, ...]
    crf: C.Crf | None
    slope: float
    shift: float

    def features(self, measures: np.ndarray, first: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, measures[:, k], "right") for k, e in enumerate(self.edges)], axis=1)
        ids = bins + np.arange(_MEASURES) * _BINS
        none = 3 * _MEASURES * _BINS
        before, after = np.full(ids.shape, none), np.full(ids.shape, none)
        before[1:] = ids[:-1] + _MEASURES * _BINS
        after[:-1] = ids[1:] + 2 * _MEASURES * _BINS
        before[first[:-1]] = none
        after[first[1:] - 1] = none
        return np.concatenate((ids, before, after), axis=1)

    def raw(self, measures: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        marginals, *_ = self.crf.forward_backward(self.crf.scores(self.features(measures, first)), first)
        good = np.add.reduceat(marginals[:, 1] * size, first[:-1]) / np.add.reduceat(size, first[:-1])
        good = np.clip(good, 1e-6, 1 - 1e-6)
        return np.log(good / (1 - good))

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.crf is None:
            return np.full(len(offs) - 1, self.shift)
        return 1 / (1 + np.exp(-(self.slope * self.raw(*measure(data, offs)) + self.shift)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", texts: int = FIT_TEXTS) -> Quality:
    """Learn from at most `texts` labelled texts; the measures of at most FIT_LINES lines of each reach the driver.

    An id with several labels has the least; one with several texts gives the one whose hash is least (ties: the smaller text), so there is a row an id at most."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(texts)

    @F.arrow_udf("struct<measures:array<double>,size:array<double>>")
    def lines(column: pa.Array) -> pa.Array:
        one, two = [], []
        for _, _, data, offs in K.slices(column):
            m, size, first = measure(data, offs)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a > FIT_LINES:
                    a += (b - a) * 2654435761 % (1 << 32) % (b - a - FIT_LINES + 1)
                    b = a + FIT_LINES
                one.append(m[a:b].ravel())
                two.append(size[a:b])
        return pa.StructArray.from_arrays([pa.array(one, pa.list_(pa.float64())), pa.array(two, pa.list_(pa.float64()))], ["measures", "size"])

    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    one = docs.join(F.broadcast(chosen), F.col("id") == F.col("_key")).groupBy("_key", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_t"))
    picked = one.select("_key", "_label", lines(F.col("_t.text")).alias("_lines"))
    rows = picked.select("_key", "_label", "_lines.measures", "_lines.size").toArrow().sort_by("_key").combine_chunks()
    y = np.array(rows.column("_label").to_pylist(), float)
    if len(np.unique(y)) < 2:
        return Quality((), None, 1.0, float(y.mean()) if len(y) else 1.0)
    n_lines = np.array([len(x) for x in rows.column("size")])
    measures = np.array(rows.column("measures").combine_chunks().flatten()).reshape(-1, _MEASURES)
    size = np.array(rows.column("size").combine_chunks().flatten())
    first = np.concatenate(([0], np.cumsum(n_lines)))
    edges = tuple(np.unique(np.quantile(measures[:, k], np.arange(1, _BINS) / _BINS)) for k in range(_MEASURES))
    model = Quality(edges, None, 1.0, 0.0)
    cuts = np.concatenate([np.arange(a, b, _CHAIN) for a, b in zip(first[:-1], first[1:], strict=True)] + [first[-1:]])
    field = C.train(model.features(measures, first), np.repeat(y.astype(int), n_lines), cuts, 3 * _MEASURES * _BINS + 1, 2)
    raw = Quality(edges, field, 1.0, 0.0).raw(measures, size, first)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method with a weak pull to slope 1
        p = 1 / (1 + np.exp(-(slope * raw + shift)))
        w = p * (1 - p)
        grad = np.array([((p - y) * raw).sum() + (slope - 1), (p - y).sum() + 0.01 * shift])
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.01]])
        slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return Quality(edges, field, float(max(slope, 0.05)), float(shift))


def predict(text: Column, model: Quality) -> Column:
    """The score of each text."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.scores(data, offs) for _, _, data, offs in K.slices(column)] or [np.zeros(0)]))

    return score(text)


def score(docs: DataFrame, model: Quality, text: str = "text") -> DataFrame:
    """docs with score (higher: better) and predicted (1: good)."""
    kept = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    return kept.withColumn("score", predict(F.col(text), model)).select(*kept.columns, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, model: Quality, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches `least`, with their own columns."""
    small_batches(docs.sparkSession)
    new = free(docs, "_score")
    return docs.withColumn(new, predict(F.col(text), model)).where(F.col(new) >= least).drop(new)


def trained(spark: SparkSession, sf_dir: str) -> Quality:
    """The model from the labels whose crc32(doc_id) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels.select("doc_id", "quality"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs.select("doc_id", "text", held.alias("held_out")), trained(spark, sf_dir)).drop("text")
