"""Fingerprints of texts by winnowing, and how alike those of neighbouring texts are.

Every run of GRAM code points is hashed (a polynomial, rolled up by doubling); of every WINDOW hashes in a
row the least is kept, the rightmost of equal ones, with its position. So two texts that share
GRAM + WINDOW - 1 code points in a row share an entry, and none shorter than GRAM is ever seen. A text of
fewer than GRAM code points is one gram; one of fewer than WINDOW grams is one window. Hashes don't depend
on the text around them, so equal texts have equal fingerprints. The likeness of two fingerprints is the
share of their distinct hashes that both have (two empty ones: 1).

Texts meet the one before them in the order of ids without a window over the table: ids alone are dealt by
range into parts of about PART_CHARS code points (at most PARTS_MOST), and the largest id of every part is
known to all tasks. A part gets its own texts and the one just before it, sorted; a task
then reads its parts in order and holds no more than a batch and the text before. Each text is
shuffled once, the last of a part twice.

Defined results: a null text is empty, and an empty text has no entries; ids descend, null ids come last;
rows that share an id get a row each, and what precedes them is the row of the next smaller id with the
smallest text in code-point order; the document after the last is the first. Texts are read whole, in
blocks of BLOCK code points that overlap by what a window needs. An empty table gives no rows; columns of
other names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import mix
from .shared import small_batches

#: Code points of a gram, and grams of a window.
GRAM, WINDOW = 16, 32
#: Code points of a block of one text, whose positions fit beside the hash.
BLOCK = 1 << 18
#: Code points of a part, and the most parts.
PART_CHARS, PARTS_MOST = 1 << 20, 65_536

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 19) - 1)


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all runs of `gram` code points (a shorter text: of all of it), a polynomial in the code points, scrambled."""
    size = min(gram, len(points))
    if not size:
        return np.zeros(0, np.uint64)
    have, length, power = mix(points.astype(np.uint64) + np.uint64(1)), 1, int(_BASE)
    out, done = None, 0
    while True:  # runs of 1, 2, 4, ... points; those of the bits of size in a row
        if size & length:
            tail = have[done : done + len(points) - size + 1]
            out = tail.copy() if out is None else out * np.uint64(power) + tail
            done += length
        if done == size:
            return mix(out + np.uint64(size))
        have = have[:-length] * np.uint64(power) + have[length:]
        length, power = 2 * length, power * power % 2**64


def least_of_windows(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of every `window` in a row (fewer: of all), the rightmost of equal ones."""
    n = len(hashes)
    size = min(window, n)
    if not n:
        return np.zeros(0, np.int64)
    keys = (hashes & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))  # of equal hashes the rightmost is the least
    have, length = keys, 1
    while 2 * length <= size:
        have = np.minimum(have[:-length], have[length:])
        length *= 2
    if length < size:
        have = np.minimum(have[: n - size + 1], have[size - length :])
    least = have[np.concatenate(([True], have[1:] != have[:-1]))]
    return (_LOW - (least & _LOW)).astype(np.int64)


def winnowed(text: str | None, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (44 bits of them, as long) and positions of a text's fingerprint, in order of position."""
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    found_h, found_p, last = [], [], -1
    for at in range(0, max(1, len(points)), BLOCK):
        if at and at + gram + window - 2 >= len(points):
            break  # the block before has all of its windows
        hashes = gram_hashes(points[at : at + BLOCK + gram + window - 2], gram)
        where = least_of_windows(hashes, window)
        if at:
            where = where[where + at > last]
        if len(where):
            found_h.append((hashes[where] >> np.uint64(20)).astype(np.int64))
            found_p.append(where + at)
            last = int(found_p[-1][-1])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_h), np.concatenate(found_p)) if found_h else (none, none)


def fingerprints(docs: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> Column:
    """A column of arrays of (hash long, position long): the fingerprints of a text column of docs."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<hash:long,position:long>>")
    def entries(column: pa.Array) -> pa.Array:
        found = [winnowed(t, gram, window) for t in column.to_pylist()]
        offsets = np.cumsum([0, *(len(h) for h, _ in found)])
        none = np.zeros(0, np.int64)
        both = [np.concatenate([none, *(f[k] for f in found)]) for k in range(2)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in both], ["hash", "position"]))

    return entries(F.col(text))


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Ten hex digits an entry: the first 32 bits of its hash, and its steps from the entry before (from 0 for the first)."""
    rows = np.empty((len(hashes), 5), np.uint8)
    rows[:, :4] = (hashes >> 12).astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4] = np.diff(positions, prepend=0)
    return rows.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the distinct values of both that both have."""
    one, two = set(a.tolist()), set(b.tolist())
    return len(one & two) / len(one | two) if one or two else 1.0


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (part, before, doc_id, text), sorted so; the row `before` leads each part and gives no result."""
    part = ident = first = previous = None  # first, previous: text and entries of the least row of this id, and of the id before
    started = led = False
    for batch in batches:
        out = []
        for at, lead, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if at != part or not started:
                part, started, fresh = at, True, True
                previous = first = None
            else:
                fresh = doc != ident or (led and not lead)
            led = lead
            entries = winnowed(text)
            if fresh:
                previous, first, ident = first, (text, entries), doc
            if lead:
                continue
            other, others = previous
            half = len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            edits = winnowed(edited)
            out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(*entries), written(*edits), likeness(entries[0], edits[0]), likeness(entries[0], others[0])))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _parts(ids: Column, ends: list[int], largest: int | None) -> Column:
    """For each id the part it belongs to, and whether it leads that part: the last id of a part also leads the next, the largest id the first.

    Null ids are below all others, so the first part holds them; where there are no others, they lead it too."""

    @F.arrow_udf("array<struct<part:int,before:boolean>>")
    def parts(column: pa.Array) -> pa.Array:
        null = np.asarray(column.is_null())
        x = np.asarray(column.fill_null(0))
        cut = np.array(ends, np.int64)
        part = np.where(null, 0, np.searchsorted(cut, x, "left"))
        again = ~null & (part < len(cut)) & (cut[np.minimum(part, len(cut) - 1)] == x) if len(cut) else np.zeros(len(x), bool)
        wraps = null if largest is None else ~null & (x == largest)
        rows = np.concatenate((np.arange(len(x)), np.flatnonzero(again), np.flatnonzero(wraps)))
        at = np.concatenate((part, part[again] + 1, np.zeros(wraps.sum(), np.int64)))
        lead = np.concatenate((np.zeros(len(x), bool), np.ones(again.sum() + wraps.sum(), bool)))
        order = np.argsort(rows, kind="stable")
        offsets = np.searchsorted(rows[order], np.arange(len(x) + 1))
        values = pa.StructArray.from_arrays([pa.array(at[order], pa.int32()), pa.array(lead[order])], ["part", "before"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return parts(ids)


def neighbours_compared(docs: DataFrame, key: str = "doc_id", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """For every document its fingerprint, that of its text with the second half taken from the next document, and the likeness to both."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    n, largest = rows.agg(F.sum(F.length("text") + 1), F.max("doc_id")).first()
    parts = min(PARTS_MOST, (n or 0) // part_chars + 1)
    ends: list[int] = []
    if parts > 1:
        ids = rows.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(parts, "doc_id")
        ends = sorted(r[0] for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("m")).select("m").collect())
        ends = [e for e in ends if e != largest]
    placed = rows.withColumn("_p", F.explode(_parts(F.col("doc_id"), ends, largest))).select("_p.part", "_p.before", "doc_id", "text")
    order = [F.col("part"), F.col("before").desc(), F.col("doc_id").asc_nulls_first(), F.col("text")]
    return placed.repartition("part").sortWithinPartitions(*order).mapInArrow(_compared, _SCHEMA)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return neighbours_compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
