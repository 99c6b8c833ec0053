"""Near-duplicate groups by SuperMinHash.

1. A text's set is its distinct word shingles, as 64-bit hashes. Texts with equal sets (128-bit
   digests) are one class from here on, stood for by its least id.
2. SuperMinHash signature: each element walks a random permutation of the VALUES places, step j
   offering j + r (r uniform) to the place it reaches; a place keeps its least offer. All elements
   of a text step together, and the text stops as soon as no place can still fall.
3. Bands of the signature: classes that share a band hash meet in a bucket. Inside a bucket only the
   links of a spanning forest over pairs with near enough signatures are kept; large buckets are
   worked on as pairs of blocks.
4. Components of these candidate links are clusters. Full sets are compared inside each cluster, again
   as a spanning forest: a pair is left out only when both already are connected by confirmed links. A
   cluster that is too large for one task, by texts or by their words, is first compared in parts, each
   text beside the one of least id among its candidate links, which costs each text once or twice; only
   texts outside the largest part that this connects are then compared with all others, in pairs of blocks.
5. Components of confirmed links give the groups.

The number of rows per band is the largest at which a pair at the threshold shares no band with a
chance of at most 1e-6; signatures count as near enough down to six standard errors below it.

Defined results: null texts and texts without words have an empty set and no links; a text with
fewer words than a shingle has one element, its words; repeated ids count as texts of their own, and
share a group's number if linked; a row without an id is linked with nothing; an empty table gives no
rows. The result has its four columns alone, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .groups import components, whole_groups
from .shared import Tables, free, small_batches

#: Places of a signature.
VALUES = 120
#: Classes of a block, where a bucket or a cluster is cut, and elements of their sets.
BLOCK, BLOCK_ELEMENTS = 1500, 3_000_000
#: Hash values by which texts are sifted before full sets are compared.
SLOTS = 1 << 19


def shingles(data: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    data = K.LOWER[data]
    starts, ends = K.spans(K.NOT_WHITE[data], offs)
    hashes = K.run_hashes(data, starts, ends)
    first, _ = K.owners(starts, offs)
    runs = K.join_hashes(hashes, words)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(runs[a : b - words + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            yield K.join_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], values: int = VALUES) -> np.ndarray:
    """SuperMinHash signatures, a row of 16-bit values for each set (65535 throughout for an empty one)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    held = np.full(n * values, 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(n), sizes)
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    place = None
    for j in range(values):
        if not len(element):
            break
        x = K.mix(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        offer = (x >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24)
        to = j + ((x & np.uint64(0xFFFFFF)) % np.uint64(values - j)).astype(np.int64)
        if place is None:
            reached = to
        else:
            row = np.arange(len(element))
            reached = place[row, to].astype(np.int64)
            place[row, to] = place[:, j]
        np.minimum.at(held, owner * values + reached, offer)
        open_ = held.reshape(n, values).max(axis=1) >= np.uint32(min(j + 1, 255) << 24)
        keep = open_[owner]
        if place is None:  # only now are permutations written out, for the texts that go on
            element, owner, to = element[keep], owner[keep], to[keep]
            place = np.tile(np.arange(values, dtype=np.uint8), (len(element), 1))
            place[np.arange(len(element)), to] = 0
        elif not keep.all():
            element, owner, place = element[keep], owner[keep], place[keep]
    return (held & np.uint32(0xFFFF)).astype(np.uint16).reshape(n, values)


def rows_per_band(percent: int, values: int = VALUES) -> int:
    t = percent / 100
    return max(r for r in (1, 2, 3, 4, 5, 6, 8, 10) if r == 1 or (1 - t**r) ** (values // r) <= 1e-6)


def _sketch(text: Column, words: int) -> Column:
    @F.arrow_udf("struct<n:bigint,digest:binary,signature:binary>")
    def sketch(column: pa.Array) -> pa.Array:
        n, digests, signs = [], [], []
        for _, _, data, offs in K.slices(column):
            sets = list(shingles(data, offs, words))
            n += [len(s) for s in sets]
            digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signs += [row.tobytes() if len(s) else None for s, row in zip(sets, signatures(sets), strict=True)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["n", "digest", "signature"])

    return sketch(text)


def _blocks(count: Column, elements: Column, block: int) -> Column:
    return F.ceil(F.greatest(count / block, elements / (BLOCK_ELEMENTS * block / BLOCK))).cast("int")


def _tiled(rows: DataFrame, group: str, count: str, member: str, block: int = BLOCK) -> DataFrame:
    """rows with _tile: a row for each pair of blocks of its group that its own block is in."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("_tile", F.xxhash64(group, F.least("_own", "_with"), F.greatest("_own", "_with")))


def _forest(n: int, near) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over 0..n-1; near(i, others) tells which others are linked with i."""
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            for j in left[hit].tolist():
                yield int(i), j
                queue.append(j)
            left = left[~hit]


def _bucket_links(least: int):
    """Candidate links inside buckets (_tile, id, signature)."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, lambda b: np.asarray(b.column(0))):
            ids = np.asarray(table.column(1).combine_chunks())
            raw = table.column(2).combine_chunks()
            signs = np.frombuffer(b"".join(raw.to_pylist()), np.uint16).reshape(len(ids), -1)
            size = np.diff(starts)
            group = np.repeat(np.arange(len(size)), size)
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            small = size <= 8
            for lag in range(1, int(size[small].max(initial=0))):
                at = np.flatnonzero((group[lag:] == group[:-lag]) & small[group[lag:]])
                near = (signs[at] == signs[at + lag]).sum(axis=1) >= least
                one.append(ids[at[near]])
                two.append(ids[at[near] + lag])
            for g in np.flatnonzero(~small):
                a, b = starts[g], starts[g + 1]
                part = signs[a:b]
                found = list(_forest(b - a, lambda i, o, part=part: (part[o] == part[i]).sum(axis=1) >= least))
                if found:
                    i, j = np.array(found).T
                    one.append(ids[a + i])
                    two.append(ids[a + j])
            a, b = np.concatenate(one), np.concatenate(two)
            pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return links


def _confirmed_links(words: int, percent: int):
    """Links of confirmed pairs inside tiles (_tile, id, text): the least id of what is connected, with each other id."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, lambda b: np.asarray(b.column(0)), most_rows=2048):
            ids = np.asarray(table.column(1).combine_chunks())
            sets = [s for _, _, data, offs in K.slices(table.column(2)) for s in shingles(data, offs, words)]
            out: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                size = np.array([len(s) for s in sets[a:b]])
                _, code = np.unique(np.concatenate(sets[a:b]), return_inverse=True)
                cut = np.concatenate(([0], np.cumsum(size)))
                by_code = np.argsort(code, kind="stable")
                owner = np.repeat(np.arange(b - a), size)[by_code]
                begin = np.searchsorted(code[by_code], np.arange(code.max() + 2)) if len(code) else np.zeros(1, int)

                def near(i: int, others: np.ndarray) -> np.ndarray:
                    own = code[cut[i] : cut[i + 1]]
                    lo, n = begin[own], begin[own + 1] - begin[own]
                    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=b - a)[others]
                    return 100 * both >= percent * (size[i] + size[others] - both)

                up = np.arange(b - a)
                for i, j in _forest(b - a, near):
                    up[j] = up[i]
                for root in np.unique(up[up != np.arange(b - a)]):
                    members = ids[a:b][up == root]
                    least = members.min()
                    out += [(int(x), int(least)) for x in members if x != least]
            x, y = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return links


def _large_links(large: DataFrame, candidates: DataFrame, confirmed: Callable[[DataFrame], DataFrame], tables: Tables, block: int) -> DataFrame:
    """Confirmed links (a, b) of clusters that are cut in blocks: (node, root, size)."""
    weigh = [F.count("*").alias("n"), F.sum("size").alias("w")]
    # each text beside the least of its candidates
    beside = candidates.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("hub")).join(large.select("node", "size"), "node")
    hubs = beside.groupBy("hub").agg(*weigh).select("hub", _blocks(F.col("n"), F.col("w"), block).alias("blocks"))
    own = beside.join(hubs, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("_tile"), "node")
    tiles = own.union(hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_k")).select(F.xxhash64("hub", "_k"), "hub"))
    links = confirmed(tiles)
    part = components(links, tables).select("node", F.col("root").alias("part"))
    parted = tables.put(large.select("node", "root", "size").join(part, "node", "left").withColumn("part", F.coalesce("part", "node")))
    most = parted.groupBy("root", "part").count().groupBy("root").agg(F.max(F.struct("count", "part")).alias("m")).select("root", F.col("m.part").alias("main"))
    parted = tables.put(parted.join(most, "root").withColumn("rest", F.col("part") != F.col("main")))
    weight = lambda rest: (F.count(F.when(rest, 1)), F.coalesce(F.sum(F.when(rest, F.col("size"))), F.lit(0)))
    counts = parted.groupBy("root").agg(*(x.alias(n) for x, n in zip((*weight(F.col("rest")), *weight(~F.col("rest"))), ("nr", "wr", "nm", "wm"), strict=True)))
    counts = counts.where("nr > 0").select("root", _blocks(F.col("nr"), F.col("wr"), block).alias("rests"), _blocks(F.col("nm"), F.col("wm"), block).alias("mains"))
    rows = parted.join(counts, "root").withColumn("_own", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    main = rows.where("NOT rest").withColumn("_with", F.explode(upto("rests"))).select(F.xxhash64("root", F.lit("main"), "_with", "_own").alias("_tile"), "node")
    rest = rows.where("rest")
    to_main = rest.withColumn("_with", F.explode(upto("mains"))).select(F.xxhash64("root", F.lit("main"), "_own", "_with").alias("_tile"), "node")
    to_rest = rest.withColumn("_with", F.explode(upto("rests"))).select(F.xxhash64("root", F.lit("rest"), F.least("_own", "_with"), F.greatest("_own", "_with")).alias("_tile"), "node")
    return links if counts.isEmpty() else links.union(confirmed(main.union(to_main).union(to_rest)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every text; kept: it is its group's least id."""
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    rows = rows_per_band(percent)
    t = percent / 100
    least = int(VALUES * t - 6 * (VALUES * t * (1 - t)) ** 0.5)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = tables.put(docs.withColumn("s", _sketch(F.col("text"), words)).select("id", "s.n", "s.digest", "s.signature"))
    classes = sketched.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("n").alias("size"))
    classes = tables.put(classes)

    bands = F.transform(F.sequence(F.lit(0), F.lit(VALUES // rows - 1)), lambda i: F.xxhash64(i, F.col("signature").substr(i * (2 * rows) + 1, F.lit(2 * rows))))
    met = tables.put(classes.select("id", F.explode(bands).alias("band")))
    often = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(often, "band").join(classes.select("id", "signature"), "id")
    met = _tiled(met, "band", "n", "id", block).select("_tile", "id", "signature")
    candidates = tables.put(met.repartition("_tile").sortWithinPartitions("_tile").mapInArrow(_bucket_links(least), "a long, b long"))
    clusters = components(candidates, tables).join(classes.select(F.col("id").alias("node"), "size"), "node")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("w")).select("root", _blocks(F.col("n"), F.col("w"), block).alias("blocks"))
    members = tables.put(clusters.join(sizes, "root"))
    # texts of no cluster are mostly left out before the shuffle, by a set of id hashes of bounded size
    slots = members.select(_slot(F.col("node")).alias("slot")).distinct()
    wanted = docs.join(F.broadcast(slots), _slot(F.col("id")) == F.col("slot"), "left_semi")

    def confirmed(tiles: DataFrame) -> DataFrame:
        """Links (a, b) of the texts of each tile (_tile, node)."""
        rows = tiles.hint("merge").join(wanted, tiles.node == wanted.id).select("_tile", "id", "text")
        return tables.put(rows.repartition("_tile").sortWithinPartitions("_tile", "id").mapInArrow(_confirmed_links(words, percent), "a long, b long"))

    links = confirmed(members.where("blocks = 1").select(F.col("root").alias("_tile"), "node"))
    groups = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    large = members.where("blocks > 1")
    if not large.isEmpty():
        groups = groups.union(components(_large_links(large, candidates, confirmed, tables, block), tables).select(F.col("node").alias("id"), "root"))
    of_class = classes.select("digest", "id").join(groups, "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    linked = sketched.where("n > 0 AND id IS NOT NULL").join(of_class, "digest").select("id", "n", "component_id")
    alone = sketched.where("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the least of its group; rows that share an id stay or go together, rows without an id stay.

    Only rows whose id hash meets that of a row to go (a set of at most SLOTS values) are shuffled, the others pass."""
    found = near_duplicates(docs, key, text, words, percent)
    left, slot = free(docs, "_gone"), free(docs, "_slot")
    gone = Tables(docs.sparkSession).put(found.where("NOT kept").select(F.col(key).alias(left)).distinct())
    slots = F.broadcast(gone.select(_slot(F.col(left)).alias(slot)).distinct())
    clear = docs.join(slots, _slot(F.col(key).cast("long")) == F.col(slot), "left_anti")
    unsure = docs.join(slots, _slot(F.col(key).cast("long")) == F.col(slot), "left_semi")
    return clear.union(unsure.join(gone, F.col(key).cast("long") == F.col(left), "left_anti"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingle sets are alike by 85 % or more, directly or by links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(least, n.doc_id)) AS component_id, least(n.doc_id, coalesce(least, n.doc_id)) = n.doc_id AS kept
FROM n LEFT JOIN comp USING (doc_id)
"""
