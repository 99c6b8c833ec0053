"""Property graphs as two tables: nodes (id, ...) and directed edges (src, tgt, ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, written


def endpoints(edges: DataFrame) -> DataFrame:
    """(id): both ends of every edge; a loop twice."""
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("tgt").alias("id")))


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of all nodes, 0 without edges."""
    return nodes.select("id").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """edges with the sum of their ends' degrees."""
    d = degrees(edges)
    out = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("_a")), "src").join(d.select(F.col("id").alias("tgt"), F.col("degree").alias("_b")), "tgt")
    return out.withColumn("degree", F.col("_a") + F.col("_b")).drop("_a", "_b")


def popular(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).distinct(), "id", "left_anti")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "id", "left_semi")


def sparse(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    return node_degrees(nodes, edges).where(F.col("degree") <= most)


def neighbours(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, src, tgt): the edges of each id, in both directions."""
    out = edges.select("src", "tgt")
    return ids.join(out, ids.id == out.src).select("id", "src", "tgt").unionByName(ids.join(out, ids.id == out.tgt).select("id", "src", "tgt"))


def lookup(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, src, tgt): the edge of each asked pair, whichever way it points; one from b to a goes before one from a to b."""
    e = edges.select("src", "tgt")
    forward = pairs.join(e, (pairs.a == e.src) & (pairs.b == e.tgt)).withColumn("_p", F.lit(1))
    backward = pairs.join(e, (pairs.a == e.tgt) & (pairs.b == e.src)).withColumn("_p", F.lit(0))
    best = forward.unionByName(backward).groupBy("a", "b").agg(F.min(F.struct("_p", "src", "tgt")).alias("x"))
    return best.select("a", "b", "x.src", "x.tgt")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "tgt").unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()


#: Nodes of a level whose neighbours are looked up in plain edges by broadcast.
NARROW = 10_000
#: Neighbours of a node that are read by one task, and buckets of an adjacency table.
HUB, BUCKETS = 100_000, 32


class Adjacency:
    """A graph's neighbours as a table in buckets by node, written once: joins on the node read it without a shuffle.

    The neighbours of a node with more than HUB of them are dealt to several parts. Use it in a with statement, or drop() it."""

    def __init__(self, edges: DataFrame, buckets: int = BUCKETS, hub: int = HUB):
        self.spark, self.name, self.buckets = edges.sparkSession, f"adjacency_{uuid.uuid4().hex}", buckets
        both = cut(both_ways(edges))
        hub = max(hub, both.count() // 100_000)  # so at most so many hubs
        sizes = both.groupBy("src").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts")).where("parts > 1")
        self.hubs = cut(sizes)
        part = F.pmod(F.xxhash64("tgt"), F.coalesce("parts", F.lit(1))).cast("int")
        rows = both.join(F.broadcast(self.hubs), "src", "left").select("src", part.alias("part"), "tgt")
        # one file a bucket, sorted as the joins want it
        rows.repartition(buckets, "src", "part").write.bucketBy(buckets, "src", "part").sortBy("src", "part").saveAsTable(self.name)

    def __enter__(self) -> Adjacency:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def around(self, front: DataFrame) -> DataFrame:
        """(id): the neighbours of front (id), each once."""
        parts = front.join(F.broadcast(self.hubs), front["id"] == self.hubs["src"], "left").select("id", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("_part"))
        kept = self.spark.table(self.name)
        return kept.join(parts, (kept["src"] == parts["id"]) & (kept["part"] == parts["_part"]), "left_semi").select(F.col("tgt").alias("id")).distinct()


def _around_few(edges: DataFrame, front: DataFrame) -> DataFrame:
    """(id): the neighbours of few nodes (id), each once."""
    few = F.broadcast(front)
    out = edges.join(few, edges["src"] == few["id"], "left_semi").select(F.col("tgt").alias("id"))
    return out.unionByName(edges.join(few, edges["tgt"] == few["id"], "left_semi").select(F.col("src").alias("id"))).distinct()


def bfs(edges: DataFrame | Adjacency, start: DataFrame, depth: int, max_nodes: int | None = None) -> tuple[DataFrame, bool]:
    """(id, level) of what is reached from start (id) in at most depth undirected steps, and whether max_nodes cut it.

    Edges are written once. A level of at most NARROW nodes is looked up in them by broadcast, without a shuffle; for a wider one their adjacency is
    written (give one that is there already to search it again), which a level joins with the nodes of the level before.
    Of the level that passes max_nodes the least ids stay, and the search ends there."""
    kept = edges if isinstance(edges, Adjacency) else None
    plain = None if kept else written(edges.select("src", "tgt"))
    made = None
    try:
        seen = cut(start.select("id").distinct().withColumn("level", F.lit(0)))
        front, size = seen, seen.count()
        n = size
        for level in range(1, depth + 1):
            if kept is None and n > NARROW:
                kept = made = Adjacency(plain)
            near = _around_few(plain, front.select("id")) if n <= NARROW and plain is not None else kept.around(front.select("id"))
            front = cut(near.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level)))
            n = front.count()
            if not n:
                break
            if max_nodes is not None and size + n > max_nodes:
                return seen.unionByName(front.orderBy("id").limit(max(0, max_nodes - size))), True
            seen = seen.unionByName(front)
            size += n
        return seen, False
    finally:
        if made:
            made.drop()


def subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, level) with db_degree, their degree in the whole graph, and the edges among them, each undirected pair once."""
    near = endpoints(edges).join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("db_degree"))
    return nodes.join(near, "id", "left").withColumn("db_degree", F.coalesce("db_degree", F.lit(0).cast("long"))), induced(edges, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with both ends among nodes (id), each undirected pair once."""
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    return inside.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes gone (id) and their edges."""
    g = gone.select("id").distinct()
    kept = edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "tgt"), "tgt", "left_anti")
    return nodes.join(g, "id", "left_anti"), kept


def merge_nodes(edges: DataFrame, into: DataFrame) -> DataFrame:
    """(src, tgt, weight, n): edges redirected by into (id, canonical), loops dropped, equal undirected pairs summed."""
    a = into.select(F.col("id").alias("src"), F.col("canonical").alias("_a"))
    b = into.select(F.col("id").alias("tgt"), F.col("canonical").alias("_b"))
    moved = edges.join(a, "src", "left").join(b, "tgt", "left").select(F.coalesce("_a", "src").alias("src"), F.coalesce("_b", "tgt").alias("tgt"), "weight")
    pairs = moved.where("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "weight")
    return pairs.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with the properties (a map) of new laid over the old ones."""
    both = nodes.select("id", F.col("properties").alias("_old")).join(new.select("id", F.col("properties").alias("_new")), "id", "full")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old = F.map_filter(F.coalesce("_old", none), lambda k, v: ~F.map_contains_key(F.coalesce("_new", none), k))
    return both.select("id", F.map_concat(old, F.coalesce("_new", none)).alias("properties"))


def upsert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges (src, tgt, weight) with new ones laid over them; new edges need both ends among nodes."""
    valid = new.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    both = edges.select("src", "tgt", F.col("weight").alias("_old")).join(valid.select("src", "tgt", F.col("weight").alias("_new")), ["src", "tgt"], "full")
    return both.select("src", "tgt", F.coalesce("_new", "_old").alias("weight"))


def labels(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, label): groups by so many rounds of taking the least label around (a plain stand-in for modularity communities). Each round's labels are kept."""
    both = cut(both_ways(edges))
    now = endpoints(edges).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        around = both.join(now.select(F.col("id").alias("tgt"), "label"), "tgt").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("_l"))
        now = cut(now.join(around, "id", "left").select("id", F.least("label", F.coalesce("_l", "label")).alias("label")))
    return now


def exists(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with found: whether there is an edge between both, whichever way it points."""
    known = edges.select(F.least("src", "tgt").alias("_x"), F.greatest("src", "tgt").alias("_y")).distinct().withColumn("_f", F.lit(True))
    return pairs.join(known, (F.least("a", "b") == F.col("_x")) & (F.greatest("a", "b") == F.col("_y")), "left").select(*pairs.columns, F.coalesce("_f", F.lit(False)).alias("found"))


def related(edges: DataFrame, focus: DataFrame, k: int) -> DataFrame:
    """edges of the focus nodes (id), the most related first: those with both ends in focus, then by the sum of degrees, then by weight; k of them with their rank."""
    known = focus.select("id").distinct()
    near = edges.join(known.select(F.col("id").alias("src"), F.lit(1).alias("_s")), "src", "left").join(known.select(F.col("id").alias("tgt"), F.lit(1).alias("_t")), "tgt", "left")
    near = near.withColumn("ends", F.coalesce("_s", F.lit(0)) + F.coalesce("_t", F.lit(0))).where("ends > 0")
    d = degrees(edges)
    near = near.join(d.select(F.col("id").alias("src"), F.col("degree").alias("_a")), "src").join(d.select(F.col("id").alias("tgt"), F.col("degree").alias("_b")), "tgt").withColumn("degree", F.col("_a") + F.col("_b"))
    order = (F.desc("ends"), F.desc("degree"), F.desc("weight"), "src", "tgt")
    return near.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("src", "tgt", "weight", "ends", "degree", "rank")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """(value, n): how many rows have each value."""
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def remove_relations(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those between the pairs of gone (src, tgt), whichever way they point."""
    g = gone.select(F.least("src", "tgt").alias("_x"), F.greatest("src", "tgt").alias("_y")).distinct()
    return edges.join(g, (F.least("src", "tgt") == F.col("_x")) & (F.greatest("src", "tgt") == F.col("_y")), "left_anti")


def create_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with those of new that aren't there yet; existing ones stay as they are."""
    return nodes.unionByName(new.join(nodes.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def relation_info(pairs: DataFrame, edges: DataFrame, records: DataFrame, evidence: DataFrame) -> DataFrame:
    """pairs (a, b) with their edge's weight, whichever way it points, the text of their vector record and their pieces of evidence, where there are any.

    records: (src, tgt, content); evidence: (src, tgt, span); all join on the undirected pair."""
    key = lambda df, x, y: df.withColumn("_x", F.least(x, y)).withColumn("_y", F.greatest(x, y))
    e = key(edges, "src", "tgt").groupBy("_x", "_y").agg(F.sum("weight").alias("weight"))
    r = key(records, "src", "tgt").groupBy("_x", "_y").agg(F.min("content").alias("content"))
    s = key(evidence, "src", "tgt").groupBy("_x", "_y").agg(F.count("span").alias("spans"))
    out = key(pairs, "a", "b")
    for part in (e, r, s):
        out = out.join(part, ["_x", "_y"], "left")
    return out.select("a", "b", "weight", "content", F.coalesce("spans", F.lit(0).cast("long")).alias("spans"))


def edited_relations(edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (src, tgt, properties) with the properties (a map) of edits (src, tgt, properties) laid over those of the pair, whichever way either points; and the edits whose pair has no edge, which change nothing.

    Of several edits of a pair the greatest map by its entries counts. An edge keeps its direction and the properties that an edit does not name."""
    pair = [F.least("src", "tgt").alias("_a"), F.greatest("src", "tgt").alias("_b")]
    new = edits.select(*pair, F.col("properties").alias("_new")).groupBy("_a", "_b").agg(F.max_by("_new", F.array_sort(F.map_entries("_new"))).alias("_new"))
    old = edges.select("*", *pair)
    kept = F.map_filter("properties", lambda k, v: ~F.map_contains_key("_new", k))
    out = old.join(new, ["_a", "_b"], "left").withColumn("properties", F.when(F.col("_new").isNull(), F.col("properties")).otherwise(F.map_concat(F.coalesce(kept, F.map_filter("_new", lambda k, v: F.lit(False))), "_new")))
    lost = edits.select("*", *pair).join(old.select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")
    return out.select(*edges.columns), lost
