"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Both sides are lower-cased (A-Z) and cut into words of ASCII letters, digits and characters outside
ASCII. Patterns are all windows of WINDOW consecutive words of the benchmark items; an item with
fewer words is one pattern by itself. A text is read from window end to window end: the last two
words of the place (its block) give, by the shift table, how far the next window end that any
pattern allows is. Where the shift is 0, the patterns that end in the block (a bucket by its hash)
are compared word by word. Texts advance side by side in numpy.

Tasks get all tables if the benchmark has at most MOST_CHARS characters (counted first). A larger one stays
distributed: tasks get the shift tables alone, of a fixed number of slots; the places whose shift is 0
are the rows that are left, and are joined with the patterns by the words of the window.

Defined results: null and empty texts, and those without words, have no words and no hits; equal
windows of several items count for each of them; null items and items without words have no
patterns; repeated rows of a text each get their own result; an empty table gives no rows. Columns named like the results are
replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import Tables, free, small_batches

#: Consecutive words of a pattern.
WINDOW = 10
#: Words of patterns in one table, at most; a larger benchmark is searched table by table.
TABLE_WORDS = 2_000_000
#: Characters of a benchmark that goes to all tasks, at most; about 100 times as many bytes of tables.
MOST_CHARS = 4_000_000
#: Bits of a slot's number in the shift tables of a larger one.
BITS = 22
#: A window with over 1 / HOT_WINDOWS of all places that a large benchmark's shift tables leave is hot; so there are fewer than that.
HOT_WINDOWS = 1000
#: Words that one text advances over in a row; a longer text is read in overlapping stretches.
STRETCH = 256


def _words(data: np.ndarray, offs: np.ndarray):
    """Word hashes, word starts and ends, first word of each text."""
    data = K.LOWER[data]
    starts, ends = K.spans(K.ALNUM[data], offs)
    first, _ = K.owners(starts, offs)
    return data, K.run_hashes(data, starts, ends), starts, ends, first


class Patterns:
    """Shift tables and suffix buckets of patterns of one length of `size` words."""

    def __init__(self, size: int, words: np.ndarray, texts: list[tuple[bytes, ...]], items: list[tuple[int, ...]]):
        self.size, self.words, self.texts, self.items = size, words, texts, items
        free = size - min(2, size) + 1
        self.bits = min(22, max(12, (8 * free * len(words)).bit_length()))
        self.shift = np.full(1 << self.bits, free, np.int16)
        blocks = blocks_of(words, size, self.bits)
        for at in range(free):  # later blocks last: they need the smaller shift
            slot = blocks[:, at]
            self.shift[slot] = np.minimum(self.shift[slot], free - 1 - at)
        last = blocks[:, -1]
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1))

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all places whose word hashes equal a pattern's."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for where, block in ends_of_windows(hashes, first, self.shift, self.size, self.bits):
            lo, n = self.bucket[block], self.bucket[block + 1] - self.bucket[block]
            where = np.repeat(where, n)
            which = self.order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            for k in range(self.size):
                same = hashes[where + k] == self.words[which, k]
                where, which = where[same], which[same]
            places.append(where)
            found.append(which)
        return np.concatenate(places), np.concatenate(found)


def blocks_of(words: np.ndarray, size: int, bits: int) -> np.ndarray:
    """The slot of each block of two words (of one, for patterns of one word)."""
    block = min(2, size)
    h = words[..., : words.shape[-1] - block + 1]
    if block == 2:
        h = K.mix(h * np.uint64(3) + words[..., 1:])
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def ends_of_windows(hashes: np.ndarray, first: np.ndarray, shift: np.ndarray, size: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first words, slots of the last block) of the windows that the shift table does not skip, some at a time."""
    if len(hashes) < size:
        return
    back = min(2, size)
    slot = blocks_of(hashes, size, bits)
    begin, end = [], []
    for a, b in zip(first[:-1], first[1:], strict=True):
        cuts = np.arange(a, max(a + 1, b - size + 1), STRETCH)
        begin.append(cuts)
        end.append(np.minimum(cuts + STRETCH + size - 1, b))
    end = np.concatenate(end)
    at = np.concatenate(begin) + size - 1  # last word of the window
    live = at < end
    at, end = at[live], end[live]
    while len(at):
        block = slot[at - back + 1]
        step = shift[block]
        hit = np.flatnonzero(step == 0)
        if len(hit):
            yield at[hit] - size + 1, block[hit]
        at = at + np.maximum(step, 1)
        live = at < end
        at, end = at[live], end[live]


def patterns(items: list[tuple[int, str]], window: int = WINDOW) -> list[Patterns]:
    """Tables of the windows of these items, one a length."""
    by_size: dict[int, dict[tuple[bytes, ...], list]] = {}
    column = pa.array([t for _, t in items], pa.string())
    for at, _, data, offs in K.slices(column):
        data, hashes, starts, ends, first = _words(data, offs)
        raw = data.tobytes()
        for i in range(len(offs) - 1):
            a, b = first[i], first[i + 1]
            size = min(window, b - a)
            for p in range(a, b - size + 1) if size else ():
                key = tuple(raw[s:e] for s, e in zip(starts[p : p + size], ends[p : p + size], strict=True))
                by_size.setdefault(int(size), {}).setdefault(key, [hashes[p : p + size], set()])[1].add(items[at + i][0])
    return [Patterns(size, np.array([h for h, _ in found.values()]), list(found), [tuple(sorted(s)) for _, s in found.values()]) for size, found in by_size.items()]


def search(column: pa.Array, tables: list[Patterns]) -> Iterator[tuple[int, int, np.ndarray, set[int]]]:
    """(row, words, hit words, items) of each text."""
    for at, _, data, offs in K.slices(column):
        data, hashes, starts, ends, first = _words(data, offs)
        n = len(offs) - 1
        mark = np.zeros(len(hashes) + 1, np.int64)
        items: dict[int, set[int]] = {}
        for table in tables:
            where, which = table.find(hashes, first)
            for p, w in zip(where.tolist(), which.tolist(), strict=True):
                if all(data[starts[p + k] : ends[p + k]].tobytes() == text for k, text in enumerate(table.texts[w])):
                    mark[p] += 1
                    mark[p + table.size] -= 1
                    items.setdefault(int(np.searchsorted(first, p, "right")) - 1, set()).update(table.items[w])
        hit = np.cumsum(mark)[:-1] > 0
        for i in range(n):
            yield at + i, int(first[i + 1] - first[i]), np.flatnonzero(hit[first[i] : first[i + 1]]) if i in items else _NONE, items.get(i, _EMPTY)


_NONE, _EMPTY = np.zeros(0, np.int64), set()


def _scanner(tables: list[Patterns]):
    @F.arrow_udf("struct<n_words:bigint,hit:array<int>,items:array<bigint>>")
    def scan(column: pa.Array) -> pa.Array:
        words, hits, items = [], [], []
        for _, n, hit, found in search(column, tables):
            words.append(n)
            hits.append(hit)
            items.append(sorted(found))
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], ["n_words", "hit", "items"])

    return scan


def tables_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, most: int = TABLE_WORDS) -> Iterator[list[Patterns]]:
    """Pattern tables of the benchmark, each of bounded size."""
    rows, size = [], 0
    for r in benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long"), text).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1]) * window // 4
        if size > most * 4:
            yield patterns(rows, window)
            rows, size = [], 0
    yield patterns(rows, window)


_RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(size, win, item): the words of every window of every item."""

    @F.arrow_udf("array<struct<size:int,win:string>>")
    def cut(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offs in K.slices(column):
            data, _, starts, ends, first = _words(data, offs)
            raw = data.tobytes()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                size = min(window, b - a)
                words = [raw[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                out.append([{"size": size, "win": " ".join(words[p : p + size])} for p in range(b - a - size + 1)] if size else [])
        return pa.array(out, pa.list_(pa.struct([("size", pa.int32()), ("win", pa.string())])))

    rows = benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull())
    return rows.select(F.col(item).cast("long").alias("item"), F.explode(cut(F.col(text))).alias("w")).select("w.size", "w.win", "item").distinct()


def _shift_tables(windows: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """For each size of windows its shift table: a row a slot reaches the driver, at most, and size."""

    @F.arrow_udf("array<struct<slot:int,shift:int>>")
    def slots(size: pa.Array, win: pa.Array) -> pa.Array:
        out = []
        _, hashes, _, _, first = _words(*K.utf8(win))
        for n, a in zip(size.to_pylist(), first[:-1].tolist(), strict=True):
            blocks = blocks_of(hashes[a : a + n], n, bits)
            out.append([{"slot": int(s), "shift": len(blocks) - 1 - k} for k, s in enumerate(blocks)])
        return pa.array(out, pa.list_(pa.struct([("slot", pa.int32()), ("shift", pa.int32())])))

    least = windows.select("size", F.explode(slots("size", "win")).alias("s")).groupBy("size", "s.slot").agg(F.min("s.shift").alias("shift")).toArrow()
    size, slot, shift = (np.asarray(least.column(i).combine_chunks()) if len(least) else np.zeros(0, np.int64) for i in range(3))
    tables = {}
    for n in np.unique(size).tolist():
        tables[n] = np.full(1 << bits, n - min(2, n) + 1, np.int16)
        tables[n][slot[size == n]] = shift[size == n]
    return tables


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, bits: int, hot: int) -> DataFrame:
    """docs with the results, for a benchmark of any size.

    Places are counted by window first. Hot windows, fewer than `hot` by their share, meet the benchmark's by broadcast,
    and their items in as many parts as hold one share of the places each; so no task gets all places of a frequent window."""
    tables = Tables(docs.sparkSession)
    row = free(docs, "_row")
    docs = tables.put(docs.withColumn(row, F.monotonically_increasing_id()))
    windows = tables.put(_windows(benchmark, item, item_text, window))
    shifts = _shift_tables(windows, bits)

    @F.arrow_udf("struct<n_words:bigint,places:array<struct<p:int,size:int,win:string>>>")
    def places(column: pa.Array) -> pa.Array:
        words, out = [], []
        for _, _, data, offs in K.slices(column):
            data, hashes, starts, ends, first = _words(data, offs)
            raw = data.tobytes()
            found: list[list] = [[] for _ in range(len(offs) - 1)]
            for size, shift in shifts.items():
                for where, _ in ends_of_windows(hashes, first, shift, size, bits):
                    of = np.searchsorted(first, where, "right") - 1
                    for i, p in zip(of.tolist(), where.tolist(), strict=True):
                        win = b" ".join(raw[s:e] for s, e in zip(starts[p : p + size].tolist(), ends[p : p + size].tolist(), strict=True))
                        found[i].append({"p": p - int(first[i]), "size": size, "win": win.decode()})
            words += np.diff(first).tolist()
            out += found
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(out, pa.list_(pa.struct([("p", pa.int32()), ("size", pa.int32()), ("win", pa.string())])))], ["n_words", "places"])

    scanned = tables.put(docs.select(F.col(row).alias("row"), places(F.col(text)).alias("s")).select("row", "s.n_words", "s.places"))
    found = scanned.select("row", F.explode("places").alias("x")).select("row", "x.p", "x.size", "x.win")
    key = ["size", "win"]
    known = windows.select(key).distinct()
    total = scanned.agg(F.sum(F.size("places"))).first()[0] or 0
    counts = found.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * hot > total)
    often = tables.put(counts.join(known.withColumn("known", F.lit(True)), key, "left").select(*key, "known", F.ceil(F.col("n") * hot / F.lit(max(total, 1))).cast("int").alias("parts")))
    met = found.join(F.broadcast(often), key, "left")
    rest = met.where("parts IS NULL").join(known, key, "left_semi")
    hits = tables.put(met.where("known").unionByName(rest).drop("known"))
    n_hit = hits.select("row", F.explode(F.sequence("p", F.col("p") + F.col("size") - 1)).alias("w")).groupBy("row").agg(F.countDistinct("w").alias("n_hit"))
    # the items of a window are found once a text, however often it stands there
    once = hits.select("row", *key, "parts").distinct()
    dealt = once.where("parts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    held = windows.join(F.broadcast(often.where("known").select(*key, "parts")), key).select(*key, "item", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = once.where("parts IS NULL").join(windows, key).select("row", "item").unionByName(dealt.join(held, [*key, "part"]).select("row", "item"))
    items = pairs.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    of = free(docs, "_of")
    result = scanned.select("row", "n_words").join(n_hit, "row", "left").join(items, "row", "left").withColumnRenamed("row", of)
    result = result.select(of, *(F.col(c).alias(f"{of}{c}") for c in ("n_words", "n_hit", "items")))
    items = F.coalesce(f"{of}items", F.array().cast("array<string>"))
    columns = [c for c in docs.columns if c.lower() not in (*_RESULTS, row.lower())]
    return docs.join(result, F.col(row) == F.col(of)).select(
        *columns,
        F.col(f"{of}n_words").alias("n_words"),
        F.coalesce(f"{of}n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(items) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = TABLE_WORDS, most_chars: int = MOST_CHARS, bits: int = BITS, hot: int = HOT_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated."""
    kept = docs.drop(*_RESULTS)
    small_batches(docs.sparkSession)
    if (benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0) > most_chars:
        return _joined(docs, benchmark, text, item, item_text, window, bits, hot)
    out, parts = docs, []
    for k, tables in enumerate(tables_of(benchmark, item, item_text, window, most)):
        parts.append(free(docs, f"_scan{k}"))
        out = out.withColumn(parts[-1], _scanner(tables)(F.col(text)))
    hit = F.array_distinct(F.concat(*[f"{p}.hit" for p in parts]))
    items = F.transform(F.array_distinct(F.concat(*[f"{p}.items" for p in parts])), lambda x: x.cast("string"))
    return out.select(
        *kept.columns,
        F.col(f"{parts[0]}.n_words").alias("n_words"),
        F.size(hit).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (F.size(hit) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """The rows of docs without any occurrence of a window, with their own columns."""
    row = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return decontaminate(row, benchmark, **more).where("NOT contaminated").select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


#: Words of an item in DuckDB; a document's likewise.
_SQL_WORDS = r"""string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ')"""
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter({_SQL_WORDS}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter({_SQL_WORDS}, lambda x: x <> '') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM pat) WHERE len(w) >= size)),
hits AS (SELECT doc_id, p, size, item_id FROM places JOIN pat USING (size, win)),
n_hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
