"""Packing of tokenized texts into sequences, by bin completion.

A text's ids (and a closing id 0) are one piece; only longer ones are cut, into full pieces behind a
first one that may be shorter. How pieces share sequences is decided on the table of how many pieces
have each length, at most CAPACITY rows whatever the input: around the largest length left, the
undominated fillings of its sequence are enumerated one by one (a filling gives way to one whose
lengths, in order, are all at least as large), the fullest first, as far as the waste that a better
solution can have; each is taken as often as its lengths allow, then also fewer times. Best-fit decreasing
gives the first incumbent, and a search of likely fillings alone the next; branches are dropped when
the sequences used and the least that the rest needs reach the incumbent's; the search ends at the
lower bound, when all is tried (the solution is then optimal), or after NODES steps (choices, and
lengths tried in fillings) with the best solution so far. Pieces then get their places by their number
among those of their length, counted in parts of about PART_ROWS pieces, so that a hot length is dealt
to many tasks; pieces of full length are sequences of their own and aren't counted at all.

Ids are those of the tokenizer's file by its library, called with add_special_tokens=False; the string
of an added token in a text gives that token's id.

Defined results: null texts are empty and have the closing id alone; repeated rows are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Tables, small_batches
from .tokens import encoder

CAPACITY = 2048
#: Steps of the full search over undominated fillings, and of the search of likely ones before it.
NODES, LIKELY_NODES = 20_000, 5_000
#: Fillings around one piece in the search that goes before the full one, at most.
LIKELY = 24
#: Pieces of one length that are numbered in one part, about.
PART_ROWS = 500_000

Plan = list[tuple[tuple[int, ...], int]]


def _best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, many equal sequences at a time."""
    room: dict[int, list[list]] = {}  # by free room: [lengths, how many sequences]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = min((r for r, x in room.items() if r >= length and x), default=None)
            if free is None:
                times = capacity // length
                if whole := left // times:
                    room.setdefault(capacity - times * length, []).append([(length,) * times, whole])
                if left % times:
                    room.setdefault(capacity - left % times * length, []).append([(length,) * (left % times), 1])
                left = 0
            else:
                lengths, n = room[free].pop()
                take = min(n, left)
                if take < n:
                    room[free].append([lengths, n - take])
                room.setdefault(free - length, []).append([(*lengths, length), take])
                left -= take
    return [(tuple(lengths), n) for x in room.values() for lengths, n in x]


def _likely(room: int, counts: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Some good fillings of the room, the fullest first: a search of these alone goes before the full one."""
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [()]
    if counts[room]:
        return [(room,)]  # it dominates every other
    least = int(have[0])
    found: list[tuple[int, ...]] = []
    # pairs that fill the room exactly, then the largest single lengths completed by the largest that fit
    other = room - have
    exact = have[(other >= have) & (counts[np.maximum(other, 0)] > (other == have))]
    found += [(room - int(x), int(x)) for x in exact[::-1][:most]]
    for first in have[::-1][:most].tolist():
        rest, filling = room - first, [first]
        while rest >= least:
            fit = have[: np.searchsorted(have, min(rest, filling[-1]), "right")][::-1]
            step = next((int(x) for x in fit if counts[x] > filling.count(int(x))), 0)
            if not step:
                break
            filling.append(step)
            rest -= step
        found.append(tuple(filling))
    found = sorted(set(found), key=lambda f: (-sum(f), len(f), [-x for x in f]))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if not any(len(k) >= len(f) and all(a >= b for a, b in zip(k, f, strict=False)) for k in kept):
            kept.append(f)
    return kept[:most]


def _fillings(room: int, counts: np.ndarray, waste: Callable[[], int]) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of the room, the fullest first, made as they are asked for; None is a step that gives none yet.

    waste() is the room that a filling may leave free, at most. A filling is dominated just if a length that is left
    fits into its free room, or fits in place of a shorter one of it.
    """
    have = np.flatnonzero(counts[: room + 1]).tolist()
    number = [min(int(counts[v]), room // v) for v in have]
    reach = [1]  # bit s of reach[k]: some pieces of the k least lengths sum to s
    for v, n in zip(have, number, strict=True):
        bits, part = reach[-1], 1
        while n:
            part = min(part, n)
            bits |= bits << part * v & (1 << room + 1) - 1
            n -= part
            part *= 2
        reach.append(bits)

    def search(k: int, rest: int, low: int, free: int) -> Iterator[tuple[int, ...] | None]:
        """Fillings of rest from the k least lengths; low: the least longer one that is left."""
        if not rest:
            if (have[0] if k else low) > free:
                yield ()
            return
        yield None
        for i in range(k - 1, -1, -1):
            v = have[i]
            if not reach[i + 1] >> rest & 1:
                return
            for m in range(min(number[i], rest // v) if low - v > free else 0, 0, -1):
                still = low if m == number[i] else v
                if still > free and reach[i] >> rest - m * v & 1:
                    for more in search(i, rest - m * v, still, free):
                        yield None if more is None else (v,) * m + more
            low = v
            if low <= free:
                return

    for free in range(room + 1):
        if free > waste():
            return
        if reach[-1] >> room - free & 1:
            yield from search(len(have), room - free, 2 * room + 1, free)


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, likely: int = LIKELY_NODES, told: dict[str, int] | None = None) -> Plan:
    """(lengths of a sequence, how many such sequences) that hold so many pieces of each length.

    Both searches stop after so many steps of their own, with the best solution so far. told gets, under `likely` and `every`, how many fillings each has tried."""
    counts = {k: v for k, v in counts.items() if v}
    best = _best_fit(counts, capacity)
    used = sum(n for _, n in best)
    bound = lambda total: -(-total // capacity)
    total = sum(k * v for k, v in counts.items())
    least = max(bound(total), sum(v for k, v in counts.items() if 2 * k > capacity))
    start = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        start[k] = v
    path: Plan = []
    every = False
    # a level of the stack: counts before it, sequences before it, length of the path before it, choices still to try
    stack: list[tuple[np.ndarray, int, int, int, Iterator]] = []

    def choices(left: np.ndarray, bins: int, sum_left: int, done: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int] | None]:
        """Fillings around the largest length left, each as often as its lengths allow; if all are tried, then also fewer times."""
        top = int(np.flatnonzero(left)[-1])
        others = left.copy()
        others[top] -= 1
        for fewer in (False, True) if every else (False,):
            for filling in _fillings(capacity - top, others, lambda: (used - 1 - bins) * capacity - sum_left) if every else _likely(capacity - top, others, LIKELY):
                if filling is None or (lengths := (top, *filling)) == done:
                    yield None
                    continue
                values, uses = np.unique(lengths, return_counts=True)
                most = int((left[values] // uses).min())
                for times in range(most - 1, 0, -1) if fewer else (most,):
                    yield lengths, times

    def open_level(left: np.ndarray, bins: int, sum_left: int, done: tuple[int, ...]) -> None:
        stack.append((left, bins, sum_left, len(path), choices(left, bins, sum_left, done)))

    for every in (False, True):  # likely fillings alone soon give a good incumbent
        path.clear()
        stack.clear()
        if total and used > least:
            open_level(start, 0, total, ())
        steps = nodes if every else likely
        while stack and steps and used > least:
            left, bins, sum_left, depth, options = stack[-1]
            del path[depth:]
            try:
                choice = next(options)
            except StopIteration:
                stack.pop()
                continue
            steps -= 1
            if choice is None:
                continue
            if told is not None:
                told["every" if every else "likely"] = told.get("every" if every else "likely", 0) + 1
            lengths, times = choice
            values, uses = np.unique(lengths, return_counts=True)
            after = left.copy()
            after[values] -= uses * times
            rest = sum_left - sum(lengths) * times
            if bins + times + bound(rest) >= used:
                continue
            path.append((lengths, times))
            if not rest:
                best, used = list(path), bins + times
                continue
            # the full search doesn't try this filling at the next level: that is the choice of more times
            open_level(after, bins + times, rest, lengths if every else ())
    return best


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each text."""

    @F.arrow_udf("array<struct<start:bigint,length:bigint,crc:bigint>>")
    def cut(column: pa.Array) -> pa.Array:
        starts, lengths, sums, offs = [], [], [], [0]
        for _, ids in encoder(path).encode(column):
            raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
            n = len(raw) // 4
            at = 0
            while at < n:
                size = capacity if at else n % capacity or capacity
                starts.append(at)
                lengths.append(size)
                sums.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                at += size
            offs.append(len(starts))
        items = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["start", "length", "crc"])
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), items)

    cuts = docs.select(F.col(key), cut(F.col(text)).alias("_cuts"))
    return cuts.select(key, F.posexplode("_cuts").alias("piece", "_c")).select(key, "piece", "_c.start", "_c.length", F.col("_c.crc").alias("ids_crc32"))


def place(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, nodes: int = NODES, part_rows: int = PART_ROWS) -> DataFrame:
    """pieces (key, piece, length and more) with sequence_id and offset. pieces is read several times: give a written table.

    A full piece is a sequence of its own, with a number below 0, and needs no shuffle."""
    full = pieces.where(F.col("length") == capacity).select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shorter = pieces.where(F.col("length") < capacity)
    counts = {r.length: r.n for r in shorter.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    parts = np.ones(capacity, np.int64)
    for length, n in counts.items():
        parts[length] = -(-n // part_rows)
    first = np.concatenate(([0], np.cumsum(parts)))  # the number of a length's first part
    salt = F.element_at(F.lit(parts.tolist()), F.col("length").cast("int") + 1)
    salted = shorter.withColumn("_part", F.element_at(F.lit(first.tolist()), F.col("length").cast("int") + 1) + F.pmod(F.xxhash64(key, "piece"), salt))
    ahead = np.zeros(first[-1] + 1, np.int64)  # pieces in earlier parts of the same length
    for part, n in salted.groupBy("_part").agg(F.count("*").alias("n")).collect():  # at most a row a length and one each part_rows pieces
        ahead[part + 1] = n
    ahead = np.cumsum(ahead)
    ahead = ahead[:-1] - np.repeat(ahead[first[:-1]], parts)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequences = 0
    for lengths, times in plan(counts, capacity, nodes):
        at = 0
        for length in lengths:
            slots.setdefault(length, []).append((taken.get(length, 0), sequences, at))
            taken[length] = taken.get(length, 0) + times
            at += length
        sequences += times
    table = np.array([(length << 44 | begin, begin, seq, at) for length in sorted(slots) for begin, seq, at in slots[length]], np.int64).reshape(-1, 4)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def slot(length: pa.Array, part: pa.Array, number: pa.Array) -> pa.Array:
        length, number = np.asarray(length), np.asarray(number) + ahead[np.asarray(part)]
        at = np.searchsorted(table[:, 0], length << 44 | number, "right") - 1
        return pa.StructArray.from_arrays([pa.array(table[at, 2] + number - table[at, 1]), pa.array(table[at, 3])], ["sequence_id", "offset"])

    order = Window.partitionBy("_part").orderBy(key, "piece")
    numbered = salted.withColumn("_k", F.row_number().over(order).cast("long") - 1)
    placed = numbered.withColumn("_slot", slot("length", "_part", "_k"))
    return full.union(placed.select(*pieces.columns, "_slot.sequence_id", "_slot.offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece. path: of the tokenizer's file."""
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    return place(tables.put(token_pieces(docs, path or default_tokenizer(), key, text, capacity)), key, capacity, nodes)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
