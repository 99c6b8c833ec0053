"""Connected components of link tables, and whole groups of rows from sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables

#: Copies of a node's row in joins on nodes, so that a node with very many links is dealt to several tasks.
SALT = 8
#: Links of which one task finds the components: so few that rounds of joins would be all overhead, for tasks and for the driver that keeps their plans.
FEW = 20_000


class Union:
    """Union-find over any values; the smaller root stays."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def link(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to the least node of what is connected inside the partition."""
    every = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            every.link(a, b)
    nodes = [x for x in every.up if every.root(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([every.root(x) for x in part], pa.int64())], ["a", "b"])


def _least(links: DataFrame, of: str, to: str) -> DataFrame:
    """links with _m: the least of each `of` node itself and its `to` nodes."""
    least = links.groupBy(of).agg(F.least(F.col(of), F.min(to)).alias("_m")).select(of, "_m", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s"))
    return links.withColumn("_s", F.pmod(F.xxhash64(to), F.lit(SALT)).cast("int")).join(least, [of, "_s"])


def components(links: DataFrame, tables: Tables, most: int = 40) -> DataFrame:
    """(node, root): the least node of its component, for every node of the links (a, b).

    Large-star and small-star steps in turn until no link changes; each round is written. Links are
    first contracted inside each partition, whose links a task holds as two numbers each; if at most FEW are left, one task contracts them whole."""
    now = tables.put(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long").distinct())
    if now.count() <= FEW:
        now = tables.put(now.coalesce(1).mapInArrow(_contract, "a long, b long"))
        return _rooted(now)
    nodes = now
    last = None
    for _ in range(most):
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum("b")).first())
        if sign == last or not sign[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _least(down, "a", "b")
        small = small.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(small.select("a", F.col("_m").alias("b"))).where("a <> b").distinct()
        new = tables.put(small)
        if now is not nodes:
            tables.drop(now)
        now, last = new, sign
    else:
        raise RuntimeError("components did not settle")
    return _rooted(now)


def _rooted(stars: DataFrame) -> DataFrame:
    """(node, root) of links from nodes to their roots, the roots themselves too."""
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], np.ndarray], most_rows: int = 4096, most_bytes: int = 8 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches that are sorted by group, and where each group begins (and the last ends).

    A table ends at a group's end once it has so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    tail: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = np.concatenate([key(x) for x in parts])
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return table, np.concatenate((starts, [len(keys)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < most_rows and size < most_bytes:
            continue
        table, starts = cut(held)
        if len(starts) > 2:  # all but the last group are whole
            yield table.slice(0, starts[-2]), starts[:-1]
            tail = table.slice(starts[-2]).combine_chunks().to_batches()
            held, rows, size = tail, sum(x.num_rows for x in tail), sum(x.nbytes for x in tail)
    if held:
        yield cut(held)
