"""Language identification by rank-order n-gram profiles.

A text's n-grams (1 to 3 characters, letters lower-cased, every run of other characters one
word boundary) are ranked by frequency. Each language has such a ranking from labelled texts. A
text gets the language whose ranking is nearest by out-of-place distance: the sum over the text's
n-grams of the difference of ranks, or of the largest difference where the language lacks it.

Defined results: a null or empty text, or one without letters (marks alone are none), is `und` with
score 0; ties between n-grams go to the smaller code, ties between languages to the smaller name;
without a labelled text everything is `und`. Texts are worked through in slices, so long ones only take
longer. Repeated rows give the same result each, and count each in learning; an empty table gives no
rows. Columns named like the results are replaced; all others stay.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import free, small_batches

#: N-grams of a profile.
TOP = 300
#: Labelled texts of a language, about, from which its profile is learned (by a hash of key and text); all if it has fewer.
FIT_TEXTS = 1000
_EDGE = (1 << 21) - 1
#: Behind the last letters of Unicode.
_TABLE = 0x33500
_tables: list[np.ndarray] = []


def _lower() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code point of letters and marks, 0 for other characters; whether it is a letter."""
    if not _tables:
        kind = [unicodedata.category(chr(i))[0] for i in range(_TABLE)]
        low = np.array([ord(chr(i).lower()[0]) if k in "LM" else 0 for i, k in enumerate(kind)], np.uint32)
        _tables.extend((low, np.array([k == "L" for k in kind])))
    return _tables[0], _tables[1]


def _grams(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram codes of one text, and how often each occurs."""
    code = np.where(letters == 0, _EDGE, letters).astype(np.int64)
    code = np.concatenate(([_EDGE], code, [_EDGE]))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _EDGE) | (code[:-1] != _EDGE)
    code = code[keep]
    two = code[:-1] << 21 | code[1:]
    three = two[:-1] << 21 | code[2:]
    every = np.sort(np.concatenate((code[code != _EDGE], two, three)))
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[at], np.diff(np.concatenate((at, [len(every)])))


def _texts(column: pa.Array):
    """(row, letters and marks of the text) for each row; none if it has no letter."""
    low, letter = _lower()
    for at, _, data, offs in K.slices(column):
        points, cut = np.minimum(K.codepoints(data), _TABLE - 1), K.char_offsets(data, offs)
        letters = low[points]
        so_far = np.concatenate(([0], np.cumsum(letter[points])))[cut]
        for i in range(len(offs) - 1):
            yield at + i, letters[cut[i] : cut[i + 1] if so_far[i + 1] > so_far[i] else cut[i]]


@dataclass(frozen=True)
class Profiles:
    """Per language its TOP n-gram codes, most frequent first."""

    languages: tuple[str, ...]
    codes: tuple[tuple[int, ...], ...]
    top: int = TOP

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of all profiles, and by language the rank of each (-1: not in it)."""
        every = np.unique(np.concatenate([np.asarray(c, np.int64) for c in self.codes] or [np.zeros(0, np.int64)]))
        ranks = np.full((len(self.languages), len(every)), -1, np.int64)
        for k, codes in enumerate(self.codes):
            ranks[k, np.searchsorted(every, np.asarray(codes, np.int64))] = np.arange(len(codes))
        return every, ranks


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", top: int = TOP, texts: int = FIT_TEXTS) -> Profiles:
    """Learn profiles from labelled texts, from about `texts` of each language.

    What is broadcast is a count a language; what reaches the driver is `top` codes a language."""
    small_batches(labelled.sparkSession)
    labelled = labelled.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    counts = labelled.groupBy("l").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("id", "t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(F.broadcast(counts), "l").where(draw * F.col("n") < texts)

    def count(batches):
        for batch in batches:
            out: dict[str, list] = {}
            langs = batch.column(1).to_pylist()
            for i, letters in _texts(batch.column(0)):
                if letters.any():
                    out.setdefault(langs[i], []).append(_grams(letters))
            for name, found in out.items():
                codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in found]).astype(float)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    counts = chosen.select("t", "l").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).orderBy("lang", "rank").collect()
    codes: dict[str, list[int]] = {}
    for r in rows:
        codes.setdefault(r.lang, []).append(r.code)
    return Profiles(tuple(codes), tuple(map(tuple, codes.values())), top)


def predict(text: Column, profiles: Profiles) -> Column:
    """A struct (lang_pred string, score double) for each text."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def rank(column: pa.Array) -> pa.Array:
        every, ranks = profiles.tables()
        names, scores = ["und"] * len(column), np.zeros(len(column))
        if len(profiles.languages):
            for i, letters in _texts(column):
                if not letters.any():
                    continue
                codes, n = _grams(letters)
                codes = codes[np.argsort(-n, kind="stable")[: profiles.top]]
                at = np.minimum(np.searchsorted(every, codes), len(every) - 1)
                there = ranks[:, at]
                off = np.where((every[at] == codes) & (there >= 0), np.abs(there - np.arange(len(codes))), profiles.top)
                far = off.sum(axis=1) / (profiles.top * len(codes))
                best = int(far.argmin())
                names[i], scores[i] = profiles.languages[best], max(0.0, 1.0 - float(far[best]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return rank(text)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    kept = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    new = free(docs, "_lang")
    return docs.withColumn(new, predict(F.col(text), profiles)).select(*kept.columns, f"{new}.lang_pred", f"{new}.score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned where crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    profiles = fit(docs.where(~held).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
