"""Vectors as short codes: a codebook for each part of a vector, learned by Yinyang rounds in whole numbers.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook
that starts as that part of the first vectors. A round assigns every part to its nearest entry and moves
the entries to the means of their parts. The entries of a codebook are put into groups (a few k-means
rounds over the entries themselves). With every part is kept its entry and, for each group, a lower bound of
its distance to all other entries of the group. When entries move, a group's bound falls by the
longest move in the group; the distance to the part's own entry is taken anew, and only groups whose bound
doesn't exceed it are scanned. Scanned distances are compared as whole numbers, so that ties go to the lower
index; bounds are rounded down, so that a tie is never passed over.

What a part knows is written with its vector after each round and read by the next: a lost task is done
again from it. Sums of entries are made in each task and added up; the driver gets a row for each entry.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do empty
ones, ones of another length than most (ties: the longer), and ones with a component of LARGEST or more in
size, whose errors a long could not hold. Where the length is no multiple of the parts, zeros are added at the
end. Null ids come last among the first vectors; rows that share an id are ordered by their vectors and get a
row each. With fewer vectors than entries there are as many entries as vectors. An empty table gives no rows;
columns of other names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables

#: Steps in one unit; parts of a vector; entries of a codebook; rounds; groups of a codebook's entries.
SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 256, 16, 64, 2, 8
#: Components of this size or more are not coded.
LARGEST = float(1 << 18)
#: Vectors that a kernel call takes, and labels whose sums are broadcast.
ROWS, LABELS_MOST = 4096, 100_000


@dataclass(frozen=True)
class Codebooks:
    """Entries (part, entry, position), the group of each entry, and how far each has moved in the last round."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        """sha256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """A group for each entry of each part: k-means over the entries, from evenly spaced ones."""
    out = np.zeros(entries.shape[:2], np.int64)
    for p, own in enumerate(entries.astype(float)):
        centre = own[np.linspace(0, len(own) - 1, min(groups, len(own))).astype(int)]
        for _ in range(rounds):
            out[p] = ((own[:, None] - centre) ** 2).sum(2).argmin(1)
            centre = np.stack([own[out[p] == g].mean(0) if (out[p] == g).any() else centre[g] for g in range(len(centre))])
    return out


def _down(x: np.ndarray) -> np.ndarray:
    """As float32, never larger (a whole share of rounding below)."""
    return np.nextafter((x * (1 - 1e-7)).astype(np.float32), np.float32(-np.inf))


def assign(x: np.ndarray, books: Codebooks, own: np.ndarray | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries, squared distances and group bounds of the parts x (row, part, position), and how many distances were taken.

    own and bound are those of the last round (None: the first, in which every group is scanned)."""
    n, parts = x.shape[:2]
    groups = int(books.group.max(initial=0)) + 1
    best, far, low, taken = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64), np.full((n, parts, groups), np.inf), 0
    rows = np.arange(n)
    for p in range(parts):
        entries, group = books.entries[p], books.group[p]
        if own is None:
            a, d, lb = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full((n, groups), -1.0)
        else:
            a = own[:, p].astype(np.int64)
            d = ((x[:, p] - entries[a]) ** 2).sum(1)
            taken += n
            fall = np.array([books.moved[p][group == g].max(initial=0.0) for g in range(groups)])
            lb = bound[:, p].astype(float) - fall * (1 + 1e-9)
        was, was_far = a.copy(), d.copy()
        scan = lb <= np.sqrt(d.astype(float))[:, None] * (1 + 1e-9)
        for g in range(groups):
            members = np.flatnonzero(group == g)
            r = np.flatnonzero(scan[:, g])
            if not len(members):
                lb[:, g] = np.inf
                continue
            if not len(r):
                continue
            every = ((x[r, p][:, None] - entries[members]) ** 2).sum(2)
            taken += every.size
            first = every.argmin(1)  # the lowest index of equal ones
            near, at = every[np.arange(len(r)), first], members[first]
            if own is not None:  # a part's own entry is what it is measured against, not one of the others
                every = np.where(members == was[r][:, None], np.iinfo(np.int64).max, every)
                first = every.argmin(1)
            lb[r, g] = np.sqrt(every[np.arange(len(r)), first].astype(float))
            if own is None:
                every[np.arange(len(r)), first] = np.iinfo(np.int64).max
                second = np.sqrt(every.min(1).astype(float))
            better = (near < d[r]) | ((near == d[r]) & (at < a[r]))
            if own is None:
                # the bound leaves the chosen entry out: it is put back when a later group has a nearer one
                gone = r[better]
                old = a[gone]
                held = d[gone] < np.iinfo(np.int64).max
                lb[gone[held], group[old[held]]] = np.minimum(lb[gone[held], group[old[held]]], np.sqrt(d[gone[held]].astype(float)))
                lb[gone, g] = second[better]
            a[r[better]], d[r[better]] = at[better], near[better]
        if own is not None:
            new = np.flatnonzero(a != was)
            if len(new):
                # the entry left is now one of the others of its group; the entry taken is none of its own group's
                lb[new, group[was[new]]] = np.minimum(lb[new, group[was[new]]], np.sqrt(was_far[new].astype(float)))
                for g in np.unique(group[a[new]]):
                    r = new[group[a[new]] == g]
                    members = np.flatnonzero(group == g)
                    every = ((x[r, p][:, None] - entries[members]) ** 2).sum(2)
                    taken += every.size
                    lb[r, g] = np.sqrt(np.where(members == a[r][:, None], np.iinfo(np.int64).max, every).min(1).astype(float))
        best[rows, p], far[rows, p], low[:, p] = a, d, lb
    return best, far, _down(low), taken


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    return flat.reshape(len(column), parts, -1).astype(np.int64)


_STATE = "vec_id long, x array<int>, own binary, low binary, far array<long>"


def _assigned(books: Codebooks, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    groups = int(books.group.max(initial=0)) + 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = part.num_rows
                x, own, low = _parts(part.column("x"), parts), None, None
                if "own" in part.schema.names:
                    own = np.frombuffer(b"".join(part.column("own").to_pylist()), np.uint8).reshape(n, parts)
                    low = np.frombuffer(b"".join(part.column("low").to_pylist()), np.float32).reshape(n, parts, groups)
                best, far, bound, _ = assign(x, books, own, low)
                codes, bounds = best.astype(np.uint8), bound.reshape(n, -1)
                found = [pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in bounds], pa.binary())]
                offsets = pa.array(np.arange(n + 1) * parts, pa.int32())
                far = pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("x"), *found, far], ["vec_id", "label", "x", "own", "low", "far"])

    return step


def _sums(parts: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and sums of the parts of every entry, one row for each that has any, for each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column("x"), parts)
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(len(x), parts)
            if total is None:
                total, count = np.zeros((parts, entries, x.shape[2]), np.int64), np.zeros((parts, entries), np.int64)
            for p in range(parts):
                np.add.at(total[p], own[:, p], x[:, p])
                count[p] += np.bincount(own[:, p], minlength=entries)
        if count is not None:
            p, e = np.nonzero(count)
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    return add


def valid(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v array<double>) of the rows whose components can be coded."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < LARGEST)))  # NaN is above all


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the mean of its parts, rounded down; unused ones stay."""
    parts, entries, width = books.entries.shape
    rows = state.select("x", "own").mapInArrow(_sums(parts, entries), "part int, entry int, n long, total array<long>")
    sums = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    new = books.entries.copy()
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        new[r.part, r.entry] = [int(r[f"s{k}"]) // r.n for k in range(width)]
    far = np.sqrt(((new - books.entries).astype(float) ** 2).sum(2))
    return Codebooks(new, books.group, far)


def compressed(vectors: DataFrame, tables: Tables, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, x, own, low, far) with the entry and the squared distance of every part, and the codebooks. At most 256 entries."""
    rows = valid(vectors, key, vector, label)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        kind = rows.schema["label"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], _STATE.replace("x array", f"label {kind}, x array", 1)), None
    dim = sizes[0].dim
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("int"))
    whole = F.concat(whole, F.array_repeat(F.lit(0), -dim % parts)) if dim % parts else whole
    state = rows.where(F.size("v") == dim).select("vec_id", "label", whole.alias("x"))
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Codebooks(start, grouped(start, groups), np.zeros(start.shape[:2]))
    kind = rows.schema["label"].dataType.simpleString()
    schema = _STATE.replace("x array", f"label {kind}, x array", 1)
    for k in range(rounds + 1):
        new = tables.put(state.mapInArrow(_assigned(books, parts), schema))
        if k:
            tables.drop(state)
        state = new
        if k < rounds:
            books = _moved(state, books)
    return state, books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every embedding, and the digest of the codebooks."""
    tables = Tables(spark)
    state, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), tables)
    error = F.aggregate("far", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = state.select("vec_id", "label", F.lower(F.hex("own")).alias("code"), error.alias("error"))
    sums = tables.put(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    if sums.count() <= LABELS_MOST:
        sums = F.broadcast(sums)
    on = rows["label"].eqNullSafe(sums["label"])
    return rows.join(sums, on).select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment to the codebooks of round k, and the codebooks after it."""
    return f"""
near{k} AS (
  SELECT v, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.v, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d
    FROM parts p JOIN book{k} b ON p.part = b.part) GROUP BY v, part),
book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY pos) AS x FROM (
      SELECT n.part, n.entry, pos, sum(p.x[pos])::DOUBLE AS s, count(*) AS n FROM near{k} n JOIN parts p ON n.v = p.v AND n.part = p.part, range(1, 5) r(pos) GROUP BY ALL)
    GROUP BY ALL) m ON b.part = m.part AND b.entry = m.entry),"""


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS v, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT v, part, x[4 * part + 1 : 4 * part + 4] AS x FROM kept, range(16) r(part)),
book0 AS (SELECT part, v - 1 AS entry, x FROM parts WHERE v <= 64),{_round(0)}{_round(1)}{_round(2)}
codes AS (SELECT v, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY v)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM kept JOIN codes USING (v)
"""
