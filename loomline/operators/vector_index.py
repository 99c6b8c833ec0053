"""A written vector index: an inverted file whose lists are partitions, with product-quantised residuals.

Build: centroids are learned by k-means from a sample of at most FIT_VECTORS; every vector goes to the list of
its nearest centroid. What is left of it there (the residual) is cut into parts, each written as the number of the
nearest of 256 learned entries. A list is a partition of the table, with ids, codes and the vectors themselves;
beside it lie the centroids with each list's size and radius (the farthest member), and the entries.

Search reads only the lists that it probes. Approximate: codes of the `probes` nearest lists give the SHORTLIST
best, whose vectors give the exact distance; `probes` is measured when the index is built, as the least that finds
TARGET of the sample's own neighbours; questions meet groups of lists, of which there are so many at most, whatever the rows. Exact: the nearest lists give a k-th distance, then every list is read
(in groups that hold some BLOCK rows) whose centroid is no farther than that and its radius; no other can hold a nearer vector.

Lists and their questions meet in blocks of bounded size, so neither a large list nor many questions are one
task. Distances are cosine (of unit vectors; zero vectors take no part) or l2. Vectors that are null, empty, hold
components that are null or not finite, or have another length than most (ties: the longer) take no part, neither
in the table nor as questions. Ties of distance, rounded to six decimals, go to the smaller id.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lineage

#: Vectors of a list, and the most lists. Beyond LISTS_MOST * LIST_ROWS vectors lists grow.
LIST_ROWS, LISTS_MOST = 128, 4096
#: Most vectors that the fit sees, and the sample's share of neighbours that probes have to find.
FIT_VECTORS, FIT_QUERIES, TARGET = 50_000, 400, 0.97
#: Parts of a residual and entries for each; candidates of which exact distances are taken, times k.
PARTS, ENTRIES, SHORTLIST = 16, 256, 12
#: Vectors and questions that meet in one group.
BLOCK, QUESTIONS = 8192, 512
#: Lists that give an exact search its first k-th distance, questions that meet a group of lists, and numbers that a kernel holds at once.
FIRST, MANY, CELLS = 8, 4096, 1 << 22
#: Groups of lists, and blocks of questions that meet each, that an approximate search has at most, so that what it shuffles grows with its rows alone.
GROUPS, ASKERS = 32, 16


@dataclass(frozen=True)
class Index:
    """What a search knows: of each list its centroid, rows and radius; the entries of each part; and how many lists to probe."""

    path: str
    metric: str
    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    entries: np.ndarray
    probes: int


def usable(rows: DataFrame, id_: str, vector: str, metric: str) -> DataFrame:
    """(id, vector) of the rows that can be compared."""
    v = F.col("vector")
    found = rows.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0))
    found = found.where(F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    return found.where(F.exists(v, lambda c: c != 0)) if metric == "cosine" else found


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in the space of Euclidean distances: for cosine, of length one."""
    return x / np.sqrt((x * x).sum(1))[:, None] if metric == "cosine" else x


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _means(x: np.ndarray, k: int, rounds: int, seed: int = 1) -> np.ndarray:
    """k-means centres; an empty one goes to a vector drawn anew."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centre)
        n = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), len(centre))])
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_squares(x[i : i + step], centre).argmin(1) for i in range(0, len(x), step))])


def _cuts(dim: int, parts: int) -> list[slice]:
    edges = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """How many nearest lists hold TARGET of the k nearest in the sample of some of its vectors."""
    own = _nearest(sample, centroids)
    asked = sample[:: max(1, len(sample) // FIT_QUERIES)]
    near = np.argsort(_squares(asked, sample), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(_squares(asked, centroids), axis=1, kind="stable"), axis=1)
    seen = place[np.arange(len(asked))[:, None], own[near]].ravel()
    return int(np.quantile(seen, TARGET, method="higher")) + 1 if len(seen) else 1


def build(rows: DataFrame, path: str, id_: str, vector: str = "embedding", metric: str = "cosine", k: int = 10, list_rows: int = LIST_ROWS, parts: int = PARTS) -> Index | None:
    """Write an index of all usable rows (None if there are none). What is collected is the sample and a row a list."""
    spark = rows.sparkSession
    found = usable(rows, id_, vector, metric)
    sizes = found.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return None
    dim, n = sizes[0].dim, sizes[0]["count"]
    found = found.where(F.size("vector") == dim)
    drawn = found.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_VECTORS / n))).limit(2 * FIT_VECTORS)
    sample = _unit(_matrix(drawn.toArrow().sort_by("id").column("vector"), dim), metric)
    if not len(sample):
        sample = _unit(_matrix(found.limit(1).toArrow().column("vector"), dim), metric)
    centroids = _means(sample, int(max(1, min(LISTS_MOST, n // list_rows, len(sample) // 8))), 6)
    left = sample - centroids[_nearest(sample, centroids)]
    cuts = _cuts(dim, parts)
    entries = np.zeros((len(cuts), ENTRIES, max(c.stop - c.start for c in cuts)))
    for p, cut in enumerate(cuts):
        learned = _means(left[:20_000, cut], ENTRIES, 6, seed=p)
        entries[p, :, : cut.stop - cut.start] = learned[np.arange(ENTRIES) % len(learned)]

    @F.arrow_udf("struct<list:int,code:binary,far:double>")
    def placed(column: pa.Array) -> pa.Array:
        x = _unit(_matrix(column, dim), metric)
        own = _nearest(x, centroids)
        rest = x - centroids[own]
        code = np.stack([_nearest(rest[:, c], entries[p, :, : c.stop - c.start]) for p, c in enumerate(cuts)], axis=1).astype(np.uint8)
        far = np.sqrt((rest * rest).sum(1))
        return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(far)], ["list", "code", "far"])

    # partitions of one list that grow large are split, small ones put together
    table = found.withColumn("_p", placed(F.col("vector"))).select("id", "_p.code", "_p.far", "vector", "_p.list").hint("rebalance", "list")
    table.write.partitionBy("list").mode("overwrite").parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count("*").alias("rows"), F.max("far").alias("radius")).collect()
    held = {r.list: (r.rows, r.radius) for r in lists}
    known = {"metric": metric, "probes": _probes(sample, centroids, k)}
    numbers = [(i, c.tolist(), held.get(i, (0, 0.0))[0], held.get(i, (0, 0.0))[1]) for i, c in enumerate(centroids)]
    spark.createDataFrame(numbers, "list int, centroid array<double>, rows long, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(json.dumps(known), e.tolist()) for e in [entries]], "known string, entries array<array<array<double>>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/entries")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """What build has written: a row a list, and the entries."""
    lists = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    rest = spark.read.parquet(f"{path}/entries").first()
    known = json.loads(rest.known)
    centroids = np.array([r.centroid for r in lists])
    return Index(path, known["metric"], centroids, np.array([r.rows for r in lists]), np.array([r.radius for r in lists]), np.array(rest.entries), known["probes"])


def _measured(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the original vectors, rounded to six decimals."""
    if metric == "l2":
        return np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)).round(6)
    size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None]
    return (1 - x @ y.T / size).round(6) + 0.0


def _met(index: Index, questions: DataFrame, lists: DataFrame, kernel: Callable, out: str, most: int = QUESTIONS, block: int = BLOCK) -> DataFrame:
    """kernel(questions, entries) for each pair of blocks of a list's questions (list, question, ...) and entries (list, id, ...)."""
    counts = questions.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias("_nq"))
    blocks = [(int(i), int(-(-n // block))) for i, n in enumerate(index.rows) if n]
    sizes = questions.sparkSession.createDataFrame(blocks, "list int, _ne int")  # a row a list
    sizes = F.broadcast(sizes.join(counts, "list"))
    left = questions.join(sizes, "list").withColumn("_i", F.pmod(F.xxhash64("question"), F.col("_nq"))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_ne") - 1)))
    right = lists.join(sizes, "list").withColumn("_j", F.pmod(F.xxhash64("id"), F.col("_ne"))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
    by = ["list", "_i", "_j"]
    left = left.select(F.col("list"), F.col("_i").cast("int").alias("_i"), F.col("_j").cast("int").alias("_j"), *[c for c in questions.columns if c != "list"])
    right = right.select(F.col("list"), F.col("_i").cast("int").alias("_i"), F.col("_j").cast("int").alias("_j"), *[c for c in lists.columns if c != "list"])
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(kernel, out)


def _best(index: Index, k: int, ids: pa.DataType, asks: pa.DataType) -> Callable:
    """The k nearest by the vectors themselves."""
    metric, dim = index.metric, index.centroids.shape[1]

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["question", "id", "distance"], [asks, ids, pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        q, e = left.column("question").combine_chunks(), right.column("id").combine_chunks()
        order = np.argsort(np.asarray(pa.compute.rank(e, tiebreaker="first")))  # ids in order, so that ties of distance go by place
        x, y = _matrix(left.column("vector"), dim), _matrix(right.column("vector"), dim)[order]
        most = min(k + 1, len(y))  # one more: the question itself may be among them
        step = max(1, CELLS // (len(y) * (dim if metric == "l2" else 1)))
        rows, places, fars = [], [], []
        for i in range(0, len(x), step):
            far = _measured(x[i : i + step], y, metric)
            r, c = np.nonzero(far <= np.partition(far, most - 1, axis=1)[:, most - 1 : most])
            by = np.lexsort((c, far[r, c], r))
            by = by[np.arange(len(r)) - np.searchsorted(r, r) < most]
            rows.append(r[by] + i)
            places.append(order[c[by]])
            fars.append(far[r[by], c[by]])
        return pa.table([q.take(pa.array(np.concatenate(rows))), e.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(fars))], names=names)

    return kernel


def _shortlisted(index: Index, most: int, ids: pa.DataType, asks: pa.DataType) -> Callable:
    """The nearest of the lists that a question asks, by codes: its distances to what the codes of a list stand for. Ties go to the smaller id."""
    metric, centroids, entries = index.metric, index.centroids, index.entries
    cuts = _cuts(centroids.shape[1], len(entries))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["question", "id", "list", "rough"], [asks, ids, pa.int32(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        q, e = left.column("question").combine_chunks(), right.column("id").combine_chunks()
        x, own = _unit(_matrix(left.column("vector"), centroids.shape[1]), metric), np.asarray(right.column("own"))
        order = np.lexsort((np.asarray(pa.compute.rank(e, tiebreaker="first")), own))
        own, place = own[order], np.asarray(pa.compute.rank(e, tiebreaker="first"))[order]
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, len(cuts))[order]
        y = centroids[own]
        for p, c in enumerate(cuts):
            y[:, c] += entries[p, :, : c.stop - c.start][code[:, p]]
        asked = left.column("lists").combine_chunks()
        asker = np.repeat(np.arange(len(x)), np.diff(np.asarray(asked.offsets)))
        wanted = np.asarray(asked.flatten())
        by = np.lexsort((asker, wanted))
        asker, wanted = asker[by], wanted[by]
        at = [(i, *np.searchsorted(own, (i, i + 1)), *np.searchsorted(wanted, (i, i + 1))) for i in np.intersect1d(own, wanted)]
        rows, places, roughs = [], [], []
        step = max(1, CELLS // len(y))
        for i in range(0, len(x), step):
            far = np.full((min(step, len(x) - i), len(y)), np.inf)
            for _, a, b, f, g in at:
                some = asker[f:g]
                some = some[np.searchsorted(some, i) : np.searchsorted(some, i + step)]
                if len(some):
                    far[some - i, a:b] = _squares(x[some], y[a:b]).round(9)
            few = min(most, len(y))
            r, c = np.nonzero((far <= np.partition(far, few - 1, axis=1)[:, few - 1 : few]) & (far < np.inf))
            by = np.lexsort((place[c], far[r, c], r))
            by = by[np.arange(len(r)) - np.searchsorted(r, r) < few]
            rows.append(r[by] + i)
            places.append(c[by])
            roughs.append(far[r[by], c[by]])
        c = np.concatenate(places)
        return pa.table([q.take(pa.array(np.concatenate(rows))), e.take(pa.array(order[c])), pa.array(own[c].astype(np.int32)), pa.array(np.concatenate(roughs))], names=names)

    return kernel


def _asked(index: Index, questions: DataFrame, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """questions (question, vector) with each list for which wanted(distances to centroids) holds."""
    dim, metric, centroids, some = index.centroids.shape[1], index.metric, index.centroids, index.rows > 0

    @F.arrow_udf("array<int>")
    def lists(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        far = np.sqrt(_squares(_unit(_matrix(column, dim), metric), centroids))
        return pa.array([np.flatnonzero(w).astype(np.int32) for w in wanted(np.where(some, far, np.inf)) & some], pa.list_(pa.int32()))

    return questions.where(F.size("vector") == dim).select("question", "vector", F.explode(lists(F.col("vector"))).alias("list"))


def _asked_groups(index: Index, questions: DataFrame, wanted: Callable[[np.ndarray], np.ndarray], group: np.ndarray) -> DataFrame:
    """questions (question, vector) once with each group (list) of lists for which wanted(distances to centroids) holds, and these lists."""
    dim, metric, centroids, some = index.centroids.shape[1], index.metric, index.centroids, index.rows > 0

    @F.arrow_udf("array<struct<list:int,lists:array<int>>>")
    def lists(column: pa.Array) -> pa.Array:
        far = np.sqrt(_squares(_unit(_matrix(column, dim), metric), centroids))
        r, c = np.nonzero(wanted(np.where(some, far, np.inf)) & some if len(far) else far > 0)
        g = group[c]
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])]) if len(r) else np.zeros(0, np.int64)
        inner = pa.ListArray.from_arrays(pa.array(np.r_[first, len(r)], pa.int32()), pa.array(c, pa.int32()))
        each = pa.StructArray.from_arrays([pa.array(g[first], pa.int32()), inner], ["list", "lists"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(r[first], np.arange(len(column) + 1)), pa.int32()), each)

    return questions.where(F.size("vector") == dim).select("question", "vector", F.explode(lists(F.col("vector"))).alias("_g")).select("question", "vector", "_g.*")


def _read(index: Index, asked: DataFrame, *columns: str) -> DataFrame:
    """Columns of the lists that are asked: their partitions are the only ones read."""
    numbers = sorted(r[0] for r in asked.select("list").distinct().collect())
    return asked.sparkSession.read.parquet(f"{index.path}/lists").where(F.col("list").isin(numbers)).select("list", *columns)


def search(index: Index, questions: DataFrame, k: int, id_: str, vector: str = "embedding", exact: bool = False, probes: int | None = None) -> DataFrame:
    """(question, rank, id, distance): the k nearest of every usable row of questions, itself left out."""
    spark = questions.sparkSession
    asked = lineage.cut(usable(questions, id_, vector, index.metric).withColumnRenamed("id", "question"))
    schema = spark.read.parquet(f"{index.path}/lists").schema
    kinds = {c: schema[c].dataType.simpleString() for c in ("id",)} | {"question": dict(asked.dtypes)["question"]}
    arrow = {c: spark.createDataFrame([], f"x {t}").toArrow().schema.field(0).type for c, t in kinds.items()}
    order = Window.partitionBy("question").orderBy("distance", "id")
    probes = max(1, min(probes or index.probes, len(index.centroids), FIRST if exact else len(index.centroids)))

    def nearest(far: np.ndarray) -> np.ndarray:
        last = np.partition(far, probes - 1, axis=1)[:, probes - 1 : probes]
        return far <= last

    def ranked(found: DataFrame) -> DataFrame:
        found = found.where(~F.col("question").eqNullSafe(F.col("id"))).dropDuplicates(["question", "id"])
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question", "rank", "id", "distance")

    out = f"question {kinds['question']}, id {kinds['id']}, distance double"
    if exact:
        first = _asked(index, asked, nearest)
        found = lineage.cut(ranked(_met(index, first, _read(index, first, "id", "vector"), _best(index, k, arrow["id"], arrow["question"]), out)))
        last = found.where(F.col("rank") == k).select("question", F.col("distance").alias("limit"))
        # a question goes once to a group of lists, not to each of them
        group = _groups(index)
        rest = _beyond(index, asked.join(last, "question", "left"), probes, group)
        rows = _read_groups(index, rest, group).select(_number(group).alias("list"), "id", "vector")
        grouped = replace(index, rows=np.bincount(group, index.rows).astype(np.int64))
        more = _met(grouped, rest, rows, _best(index, k, arrow["id"], arrow["question"]), out, MANY)
        return ranked(found.drop("rank").unionByName(more))
    block = max(BLOCK, int(-(-index.rows.sum() // GROUPS)))
    group = _groups(index, block)
    first = _asked_groups(index, asked, nearest, group)
    grouped = replace(index, rows=np.bincount(group, index.rows).astype(np.int64))
    near = _read_groups(index, first, group)
    kernel, most = _shortlisted(index, SHORTLIST * k, arrow["id"], arrow["question"]), max(MANY, -(-asked.count() // ASKERS))
    # a group has more rows than a block only where one list has
    rough = _met(grouped, first, near.select(_number(group).alias("list"), "id", "code", F.col("list").alias("own")), kernel, f"question {kinds['question']}, id {kinds['id']}, list int, rough double", most, block)
    close = Window.partitionBy("question").orderBy("rough", "id")
    short = rough.withColumn("_r", F.row_number().over(close)).where(F.col("_r") <= SHORTLIST * k).select("question", "id", "list")
    whole = short.join(near.select("list", "id", "vector"), ["list", "id"]).join(asked.withColumnRenamed("vector", "_q"), "question")

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        dim = index.centroids.shape[1]
        x, y = _matrix(a, dim), _matrix(b, dim)
        if index.metric == "l2":
            return pa.array(np.sqrt(((x - y) ** 2).sum(1)).round(6))
        return pa.array((1 - (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))).round(6) + 0.0)

    return ranked(whole.select("question", "id", distance(F.col("vector"), F.col("_q")).alias("distance")))


def _number(group: np.ndarray) -> Column:
    """The group of a row's list."""
    return F.element_at(F.lit(group.tolist()), F.col("list") + 1).cast("int")


def _read_groups(index: Index, asked: DataFrame, group: np.ndarray) -> DataFrame:
    """The lists of the groups (list) that are asked."""
    wanted = sorted(r[0] for r in asked.select("list").distinct().collect())
    return asked.sparkSession.read.parquet(f"{index.path}/lists").where(F.col("list").isin(np.flatnonzero(np.isin(group, wanted)).tolist()))


def _groups(index: Index, block: int = BLOCK) -> np.ndarray:
    """The group of each list: lists in order, as many as have a block of rows together."""
    group, held, at = np.zeros(len(index.rows), np.int64), 0, 0
    for i, n in enumerate(index.rows):
        if held and held + n > block:
            at, held = at + 1, 0
        group[i], held = at, held + n
    return group


def _beyond(index: Index, asked: DataFrame, probes: int, group: np.ndarray) -> DataFrame:
    """questions (question, vector, limit) with each group (list) of a list not yet read that may hold a vector nearer than the limit (null: all lists)."""
    dim, metric, centroids, some, radius = index.centroids.shape[1], index.metric, index.centroids, index.rows > 0, index.radius

    @F.arrow_udf("array<int>")
    def lists(column: pa.Array, limit: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        far = np.where(some, np.sqrt(_squares(_unit(_matrix(column, dim), metric), centroids)), np.inf)
        read = far <= np.partition(far, probes - 1, axis=1)[:, probes - 1 : probes]
        most = np.asarray(limit.fill_null(np.inf), float) + 2e-6
        most = np.sqrt(2 * most) if metric == "cosine" else most
        return pa.array([np.unique(group[w]).astype(np.int32) for w in some & ~read & (far - radius <= most[:, None] + 1e-6)], pa.list_(pa.int32()))

    return asked.where(F.size("vector") == dim).select("question", "vector", F.explode(lists(F.col("vector"), F.col("limit"))).alias("list"))
