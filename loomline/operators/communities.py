"""Communities of a graph by modularity: Louvain by blocks of edges.

A level begins with a community for each node. In a round every node weighs the communities around it
by the gain in modularity of moving there; about half of the nodes (by a hash, another half each round) move to the best,
so that neighbours rarely move past each other. A round is kept if modularity rises; after IDLE rounds without a rise the
level ends, its communities become the nodes of the next, and levels follow until none rises.

Nodes go by numbers in the order of their names, and are dealt to parts by a hash. A level's edges are written once, in blocks:
a row holds those from one part to another, as arrays. In a round each part tells the others, block by block, the communities of its
nodes, in one shuffle of a row a block, and weighs what it is told; the modularity before the round falls out of it. What a task
holds is a part of some PART_EDGES edges (beyond some 110,000,000 a part grows with their root), or a node's edges if these are more.
Nothing but sums reaches the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cleaned, cut

#: Rounds without a rise that end a level; the least rise of a round, and the least gain of a move.
IDLE, RISE, GAIN = 3, 1e-4, 1e-9
#: Buckets of a level's edges; edges of a part, about, and edges of a block, on average, at least.
BUCKETS, PART_EDGES, BLOCK_EDGES = 64, 1 << 18, 1600
#: Pairs that are packed at a time.
PACKED = 1 << 20
#: Turns after which the halves that may move come again: a bit each.
TURNS = 60


def weighted(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(a, b, w): an undirected graph, both directions of each pair, parallel edges summed; a loop once, with twice its weight."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = edges.where("src IS NOT NULL AND tgt IS NOT NULL").select(F.col("src").alias("a"), F.col("tgt").alias("b"), w.alias("w")).where("w > 0")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(graph: DataFrame, own: DataFrame) -> float:
    """Of communities own (id, community) over a graph (a, b, w); 0 for a graph without edges."""
    ca, cb = own.select(F.col("id").alias("a"), F.col("community").alias("_ca")), own.select(F.col("id").alias("b"), F.col("community").alias("_cb"))
    each = graph.join(ca, "a").join(cb, "b").groupBy("_ca").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("_ca") == F.col("_cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    found = each.agg(F.sum("inside"), F.sum("total"), F.sum(F.col("total") * F.col("total"))).first()
    return found[0] / found[1] - found[2] / found[1] ** 2 if found[1] else 0.0


class _Tables:
    """Tables of one run, in the warehouse. They are dropped when it ends, or sooner."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, {}

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df, written and read again; in buckets of the column `by`, by which its tasks are dealt already."""
        name = f"links_{uuid.uuid4().hex}"
        with cleaned(self.spark):
            (df.write.bucketBy(BUCKETS, by) if by else df.write).saveAsTable(name)
        made = self.spark.table(name)
        self.names[id(made)] = name, made
        return made

    def drop(self, df: DataFrame) -> None:
        name, _ = self.names.pop(id(df))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def __enter__(self) -> _Tables:
        return self

    def __exit__(self, *_) -> None:
        for _, made in list(self.names.values()):
            self.drop(made)


def _part(n: np.ndarray, parts: int) -> np.ndarray:
    return ((n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _parts(edges: int) -> int:
    """Parts of a graph of so many edges, each direction counted."""
    return max(1, min(edges // PART_EDGES, int((edges / BLOCK_EDGES) ** 0.5)))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _joined(table: pa.Table, **kinds: type) -> list[np.ndarray]:
    """The numbers of columns of bytes, all rows in a row."""
    return [np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in table.column(name).to_pylist())]) for name, t in kinds.items()]


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, *first: np.ndarray) -> list[np.ndarray]:
    """Rows in the order of `first`, a and b, those that are alike as one, with the sum of w."""
    order = np.lexsort((b, a, *first))
    a, b, w, first = a[order], b[order], w[order], [x[order] for x in first]
    at = _starts(a, b, *first)
    return [a[at], b[at], np.add.reduceat(w, at) if len(at) else w, *(x[at] for x in first)]


_PACKED = "part int, a binary, b binary, w binary"
_BLOCK = "part int, to int, a binary, b binary, w binary"
_TOLD = "to int, own boolean, a binary, c binary, tot binary, w binary, loop binary, moves binary"


def _cut_by(keys: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """Sorted keys, each once, and columns as the bytes of each key's rows."""
    cuts = [*_starts(keys).tolist(), len(keys)]
    cut_ = {name: pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for name, x in columns.items()}
    return {"": pa.array(keys[cuts[:-1]], pa.int32())} | cut_


def _packed(a: np.ndarray, b: np.ndarray, w: np.ndarray, parts: int) -> pa.Table:
    """Edges (a, b, w): a row for each part that their b are in."""
    part = _part(b, parts)
    order = np.argsort(part, kind="stable")
    found = _cut_by(part[order], a=a[order], b=b[order], w=w[order])
    return pa.table({"part": found.pop("")} | found)


def _pack(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, w) as edges both ways, PACKED pairs at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += len(batch)
            if rows and (batch is None or rows >= PACKED):
                a, b, w = (_numbers(pa.Table.from_batches(held), x) for x in "abw")
                held, rows = [], 0
                yield from _packed(np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w)), parts).to_batches()

    return pack


def _blocks(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Of all packed edges whose b is in a part: a row for each part that they lead to."""

    def blocks(table: pa.Table) -> pa.Table:
        a, b, w = _joined(table, a=np.int64, b=np.int64, w=np.float64)
        b, a, w, to = _summed(b, a, w, _part(a, parts))
        found = _cut_by(to, a=a, b=b, w=w)
        to = found.pop("")
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(to), pa.int32()), "to": to} | found)

    return blocks


def _strengths(table: pa.Table) -> pa.Table:
    """(part, n, k) of a part's nodes from its blocks: k is the sum of a node's edges."""
    b, w = _joined(table, b=np.int64, w=np.float64)
    n, at = np.unique(b, return_inverse=True)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(n), pa.int32()), "n": n, "k": np.bincount(at, w, len(n))})


def _tell(loops: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Blocks and nodes of a part: to each part that its edges lead to, the communities of their ends here; to itself, its nodes. With loops, or those apart, as sums of nodes."""

    def tell(blocks: pa.Table, nodes: pa.Table) -> pa.Table:
        order = np.argsort(_numbers(nodes, "n"))
        n, k, c, tot, moves = (_numbers(nodes, x)[order] for x in ("n", "k", "community", "tot", "moves"))
        loop, rows = np.zeros(len(n)), []
        for row in zip(*(blocks.column(x).to_pylist() for x in ("to", "a", "b", "w")), strict=True):
            a, b, w = np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int64), np.frombuffer(row[3])
            same = a == b
            if not loops and same.any():
                np.add.at(loop, np.searchsorted(n, b[same]), w[same])
                a, b, w = a[~same], b[~same], w[~same]
            at = np.searchsorted(n, b)
            rows.append((row[0], False, a.tobytes(), c[at].tobytes(), tot[at].tobytes(), w.tobytes(), None, None))
        rows.append((nodes.column("part")[0].as_py(), True, *(x.tobytes() for x in (n, c, tot, k, loop, moves))))
        kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["to", "own", "a", "c", "tot", "w", "loop", "moves"])

    return tell


def _heard(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of what a part was told: its nodes (n, community, tot, k, loop, moves), and its edges (place of a among the nodes, community, tot, w)."""
    own = np.asarray(table.column("own"))
    kinds = {"a": np.int64, "c": np.int64, "tot": np.float64, "w": np.float64}
    mine = table.filter(pa.array(own))
    nodes = [np.frombuffer(mine.column(x)[0].as_py(), kinds.get(x, np.int64 if x == "moves" else np.float64)) for x in ("a", "c", "tot", "w", "loop", "moves")]
    rest = table.filter(pa.array(~own))
    a, *edges = _joined(rest, **kinds)
    return nodes, [np.searchsorted(nodes[0], a), *edges]


def _weigh(total: float, turn: int) -> Callable[[pa.Table], pa.Table]:
    """(part, n, k, moves, community, inside, next) of a part's nodes: the weight of each to its own community, and its community after one round; turn says which half may move."""

    def weigh(table: pa.Table) -> pa.Table:
        (n, c0, tot0, k, loop, moves), (at, c, tot, w) = _heard(table)
        order = np.lexsort((c, at))
        at, c, tot, w = at[order], c[order], tot[order], w[order]
        first = _starts(at, c)
        at, c, tot, to = at[first], c[first], tot[first], np.add.reduceat(w, first) if len(first) else w
        # its own community is always a choice, with or without a neighbour in it
        own = c == c0[at]
        stay = np.zeros(len(n))
        stay[at[own]] = to[own]
        stays = np.round(stay - k * (tot0 - k) / total, 9)
        at, c, gain = at[~own], c[~own], np.round(to - k[at] * tot / total, 9)[~own]
        after = c0.copy()
        first = _starts(at)
        if len(first):
            best, who = np.maximum.reduceat(gain, first), at[first]
            alike = gain == np.repeat(best, np.diff(np.append(first, len(at))))
            least = np.minimum.reduceat(np.where(alike, c, np.iinfo(np.int64).max), first)
            goes = (moves[who] >> (turn % TURNS) & 1 == 1) & (best > stays[who] + GAIN)
            after[who[goes]] = least[goes]
        return pa.table({"part": pa.array([table.column("to")[0].as_py()] * len(n), pa.int32()), "n": n, "k": k, "moves": moves, "community": c0, "inside": stay + loop, "next": after})

    return weigh


def _merge(parts: int) -> Callable[[pa.Table], pa.Table]:
    """The edges of a part between communities, packed."""

    def merge(table: pa.Table) -> pa.Table:
        (_, c0, *_), (at, c, _, w) = _heard(table)
        return _packed(*_summed(c0[at], c, w), parts)

    return merge


def _of_parts(links: DataFrame, nodes: DataFrame, loops: bool = False) -> DataFrame:
    """What the nodes (part, n, k, moves, community) of every part are told over the links, by part."""
    sums = nodes.groupBy("community").agg(F.sum("k").alias("tot"))
    known = nodes.join(sums, "community").select("part", "n", "k", "community", "tot", "moves")
    return links.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_tell(loops), _TOLD)


def _modularity(weighed: DataFrame, total: float) -> float:
    """Of the communities that a round began with."""
    found = weighed.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("k").alias("tot")).agg(F.sum("inside"), F.sum(F.col("tot") * F.col("tot"))).first()
    return found[0] / total - found[1] / total**2


def louvain(edges: DataFrame, weight: str | None = None, rounds: int = 16, levels: int = 6) -> tuple[DataFrame, float]:
    """(id, community) for every node with an edge, a community named by one of its nodes, and the modularity.

    At most so many rounds a level and levels; deterministic."""
    with _Tables(edges.sparkSession) as tables:
        return _louvain(edges, weight, rounds, levels, tables)


def _louvain(edges: DataFrame, weight: str | None, rounds: int, levels: int, tables: _Tables) -> tuple[DataFrame, float]:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = tables.put(edges.where("src IS NOT NULL AND tgt IS NOT NULL").select("src", "tgt", w.alias("w")).where("w > 0"))
    # numbers in the order of names, which ties of gain go by
    names = tables.put(e.select(F.col("src").alias("id")).union(e.select("tgt")).distinct().orderBy("id").select(F.monotonically_increasing_id().alias("n"), "id"))
    named = lambda name, n: names.select(F.col("id").alias(name), F.col("n").alias(n)).hint("shuffle_hash")
    pairs = e.join(named("src", "x"), "src").join(named("tgt", "y"), "tgt").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
    pairs = tables.put(pairs)
    tables.drop(e)
    total, n = pairs.agg(F.sum("w") * 2, F.count("*")).first()
    if not n:
        return cut(names.select("id", F.col("id").alias("community"))), 0.0
    parts = _parts(2 * n)
    packed = pairs.mapInArrow(_pack(parts), _PACKED)
    every = tables.put(names.select("n", F.col("n").alias("community")))
    best, made_of = None, [pairs]
    for level in range(levels):
        links = tables.put(packed.repartition(BUCKETS, "part").groupBy("part").applyInArrow(_blocks(parts), _BLOCK), "part")
        for x in made_of:
            tables.drop(x)
        # the halves that move, by a hash of the name: a bit a turn
        may = [F.shiftleft((F.pmod(F.xxhash64(F.col("id"), F.lit(level * rounds + t)), F.lit(2)) == 0).cast("long"), (level * rounds + t) % TURNS) for t in range(max(1, min(rounds, TURNS)))]
        moves = may[0]
        for x in may[1:]:
            moves = moves.bitwiseOR(x)
        strengths = links.groupBy("part").applyInArrow(_strengths, "part int, n long, k double")
        weighed = tables.put(strengths.join(names, "n").select("part", "n", "k", moves.alias("moves"), F.col("n").alias("next")))
        top, top_nodes, idle = None, None, 0
        for turn in range(rounds + 1):
            nodes = weighed.select("part", "n", "k", "moves", F.col("next").alias("community"))
            told = _of_parts(links, nodes)
            before, weighed = weighed, tables.put(told.groupBy("to").applyInArrow(_weigh(total, level * rounds + turn), "part int, n long, k double, moves long, community long, inside double, next long"))
            if before is not top_nodes:
                tables.drop(before)
            now = _modularity(weighed, total)
            if top is None or now > top + RISE:
                if top_nodes is not None:
                    tables.drop(top_nodes)
                best = now if best is None else best
                top, idle, top_nodes = now, 0, weighed
            else:
                idle += 1
                if idle == IDLE:
                    break
        if weighed is not top_nodes:
            tables.drop(weighed)
        if top <= best + RISE:
            break
        best = top
        into = top_nodes.select(F.col("n").alias("community"), F.col("community").alias("_c"))
        before, every = every, tables.put(every.join(into, "community").select("n", F.col("_c").alias("community")))
        tables.drop(before)
        if level + 1 < levels:
            packed = _of_parts(links, top_nodes, loops=True).groupBy("to").applyInArrow(_merge(parts), _PACKED)
            made_of = [links, top_nodes]
    found = every.join(names, "n").select("id", F.col("community").alias("n")).join(names.withColumnRenamed("id", "community"), "n")
    return cut(found.select("id", "community")), best
