"""Groups of spelling variants: words of a corpus that are one edit apart, by bands of letter-parity masks.

Words are counted where they stand (a sum for each task, then one for each word). The mask of a word has a
bit for each letter: whether it holds the letter an odd number of times. One inserted or deleted letter
flips one bit, one replaced letter at most two, so of three bands of bits at least one stays equal. Letters
are dealt to the bands by how often they are odd in the words themselves, the most telling first; rare
letters share the last bit of a band, which keeps the bound. Words meet where a band and the length are
equal, or where the length is one more; masks that differ in more than two bits are passed over, the others
are compared letter by letter, and a pair counts in the first band that it shares. Nothing but near pairs
leaves a group. A group of many words is cut into blocks of BLOCK_BYTES, each pair of blocks is a group of
its own, so that no task holds more than two blocks.

A word's form is its near word of largest n (ties: the smaller in code-point order), if that n is at least
RATIO times its own; its root is the end of the chain of forms, found by doubling the steps: n at least
doubles with each, so chains are short.

Defined results: null and empty texts have no words; a null id is written as an empty text before the
colon; rows that share an id count each; a text is read whole, and a word may be of any length; columns of
other names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import whole_groups
from .shared import Tables, small_batches

#: Code points and occurrences that make a word.
LETTERS, OCCURRENCES = 5, 3
#: One run in so many is respelled.
RESPELLED = 97
#: How much more frequent a form is than the word.
RATIO = 2
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
#: Bits of a band.
BAND = 21
#: Bytes of the words of a block (WORD_BYTES more each).
BLOCK_BYTES, WORD_BYTES = 1 << 20, 48
#: Most groups whose numbers of blocks are broadcast; where there would be more, blocks are larger.
CUT_GROUPS = 100_000
#: Mask comparisons at once, and bytes of words compared at once.
TILE, CHECK_BYTES = 1 << 20, 1 << 22

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")  # shorter runs give no words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of (id, text) and how often, summed over HELD words at a time."""

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            before = crc32(f"{'' if ident is None else ident}:".encode())
            for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                h = crc32(run.encode(), before)
                if h % RESPELLED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LETTERS:
                        continue
                held[run] += n
            if len(held) >= HELD:
                yield out(held)
                held = Counter()
    if held:
        yield out(held)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts, respelled runs included."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 bytes of words, one for each letter, and their lengths."""
    found = column.to_pylist()
    return np.frombuffer("".join(found).encode("latin-1"), np.uint8), np.fromiter(map(len, found), np.int64, len(found))


def _odd(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, letter) for each letter that a word holds an odd number of times."""
    data, n = _flat(column)
    pairs, times = np.unique(np.repeat(np.arange(len(n)), n) * 256 + data, return_counts=True)
    pairs = pairs[times % 2 == 1]
    return pairs // 256, pairs % 256


def _bits(spoken: DataFrame) -> tuple[int, ...]:
    """A bit for each of the 256 letters: the r-th most telling goes to band r mod 3. What is collected is a row a letter."""

    def odd(batches):
        for batch in batches:
            n = np.bincount(_odd(batch.column(0))[1], minlength=256)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["letter", "n"])

    total = max(1, spoken.count())
    share = {r.letter: r.n / total for r in spoken.select("word").mapInArrow(odd, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    order = sorted(range(256), key=lambda c: (abs(share.get(c, 0.0) - 0.5), c))
    bits = [0] * 256
    for r, c in enumerate(order):
        bits[c] = r % 3 * BAND + min(r // 3, BAND - 1)
    return tuple(bits)


def _mask(word: Column, bits: tuple[int, ...]) -> Column:
    @F.arrow_udf("long")
    def mask(column: pa.Array) -> pa.Array:
        values = np.array([1 << b for b in bits], np.uint64)
        data, n = _flat(column)
        return pa.array(np.bitwise_xor.reduceat(values[data], np.cumsum(n) - n).astype(np.int64) if len(n) else np.zeros(0, np.int64))

    return mask(word)


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def _one_more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a are those of b with one letter put in: what is equal from the left and from the right covers b."""
    left, right = np.ones((len(a), a.shape[1]), bool), np.ones((len(a), a.shape[1]), bool)
    left[:, :-1], right[:, :-1] = a[:, :-1] != b, (a[:, 1:] != b)[:, ::-1]
    return left.argmax(1) + right.argmax(1) >= b.shape[1]


_GROUP = ["band", "value", "length", "i", "j"]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, in both directions, of groups of rows (_GROUP, longer, second, mask, word, n)."""

    def key(batch: pa.RecordBatch) -> np.ndarray:
        return np.rec.fromarrays([np.asarray(batch.column(k)) for k in range(len(_GROUP))], names=_GROUP)

    for table, starts in whole_groups(batches, key):
        head = [np.asarray(table.column(k).combine_chunks()) for k in range(len(_GROUP))]
        longer, second = (np.asarray(table.column(k).combine_chunks().cast(pa.int8())).astype(bool) for k in (5, 6))
        mask = np.asarray(table.column(7).combine_chunks()).view(np.uint64)
        spelt, n = table.column(8).combine_chunks(), np.asarray(table.column(9).combine_chunks())
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            band, length = int(head[0][a]), int(head[2][a])
            at = np.arange(a, b)
            own, short, late = at[longer[a:b]], at[~longer[a:b]], second
            tables = {}
            for rows, size in ((own, length), (short, length - 1)):
                where = np.zeros(b - a, np.int64)
                where[rows - a] = np.arange(len(rows))
                tables[size] = (where, _flat(spelt.take(pa.array(rows)))[0].reshape(len(rows), size))
            split = int(head[3][a]) != int(head[4][a])
            if split:
                pairs = [(own[~late[own]], own[late[own]], length), (own[~late[own]], short[late[short]], length - 1), (own[late[own]], short[~late[short]], length - 1)]
            else:
                pairs = [(own, own, length), (own, short, length - 1)]
            for left, right, size in pairs:
                if not len(left) or not len(right):
                    continue
                step = max(1, TILE // len(right))
                for first in range(0, len(left), step):
                    part = left[first : first + step]
                    apart = mask[part][:, None] ^ mask[right][None, :]
                    x, y = np.nonzero(np.bitwise_count(apart) <= 2)
                    bits, x, y = apart[x, y], part[x], right[y]
                    new = np.ones(len(x), bool)
                    for e in range(band):
                        new &= (bits >> np.uint64(e * BAND)) & np.uint64((1 << BAND) - 1) != 0
                    if left is right:
                        new &= x < y
                    x, y = x[new], y[new]
                    some = max(1, CHECK_BYTES // length)
                    for k in range(0, len(x), some):
                        p, q = x[k : k + some], y[k : k + some]
                        (mine, long), (other, rest) = tables[length], tables[size]
                        same = (_one_replaced if size == length else _one_more)(long[mine[p - a]], rest[other[q - a]])
                        p, q = p[same], q[same]
                        if len(p):
                            one, two = pa.array(np.concatenate((p, q))), np.concatenate((q, p))
                            yield pa.RecordBatch.from_arrays([spelt.take(one), spelt.take(pa.array(two)), pa.array(n[two])], ["word", "near", "near_n"])


def near_words(spoken: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of different words (word, n) that are one edit apart, in both directions."""
    rows = spoken.withColumn("mask", _mask(F.col("word"), _bits(spoken))).withColumn("_l", F.length("word"))
    bands = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("mask", k * BAND).bitwiseAND((1 << BAND) - 1).alias("value")) for k in range(3)]
    sides = [F.struct((F.col("_l") + k).alias("length"), F.lit(k == 0).alias("longer")) for k in range(2)]
    rows = rows.withColumn("_b", F.explode(F.array(*bands))).withColumn("_s", F.explode(F.array(*sides))).select("_b.*", "_s.*", "mask", "word", "n")
    sizes = rows.groupBy("band", "value", "length").agg((F.count("*") * (F.col("length") + WORD_BYTES)).alias("_bytes"))
    most = max(BLOCK_BYTES, (sizes.agg(F.sum("_bytes")).first()[0] or 0) // CUT_GROUPS)
    many = sizes.where(F.col("_bytes") > most).withColumn("_n", F.ceil(F.col("_bytes") / most).cast("int")).drop("_bytes")
    dealt = rows.join(F.broadcast(many), ["band", "value", "length"], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.withColumn("_k", F.pmod(F.xxhash64("word"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("band", "value", "length", F.least("_k", "_o").alias("i"), F.greatest("_k", "_o").alias("j"), "longer", (F.col("_k") > F.col("_o")).alias("second"), "mask", "word", "n")
    return dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_near, "word string, near string, near_n long")


def variants(spoken: DataFrame, tables: Tables) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of (word, n), which has to be a written table."""
    # the smallest (-n, word) is the near word of largest n, the smaller word first
    near = near_words(spoken).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("_f"))
    found = spoken.join(near, "word", "left").withColumn("form_n", -F.col("_f.n"))
    formed = F.col("form_n") >= RATIO * F.col("n")
    found = tables.put(found.select("word", F.when(formed, F.col("_f.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n")))
    steps = tables.put(found.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("more")))
    largest = spoken.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(1 + math.log(largest, RATIO))) + 1):  # chains have at most log(largest) steps
        if steps.where("more").isEmpty():
            break
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_r"))
        new = tables.put(steps.join(on, "root", "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("more")))
        tables.drop(steps)
        steps = new
    out = found.join(steps.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of all words of documents."""
    tables = Tables(spark)
    return variants(tables.put(words(spark.read.parquet(f"{sf_dir}/documents.parquet"))), tables)


OP13_SQL = """
WITH RECURSIVE
crc(t) AS (SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(unicode(c) >> 6)::BIGINT | 192, (unicode(c) & 63)::BIGINT | 128] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, p, left(word, p - 1) AS l, substr(word, p + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.p = b.p AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.l || a.r = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.l || a.r = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
