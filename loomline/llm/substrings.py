"""Substring deduplication over sliding spans of sentences.

A text is cut into sentences: after a mark of STOPS (and the quotes and brackets of CLOSERS behind it)
with white space behind, after a mark of WIDE even without, and at line breaks. Sentences of PANE words
or more are cut further at words chosen by what stands around them: in every PANE consecutive words of
a sentence the one of least word value (ties: the last) begins a part. So cuts realign inside any
copied passage wherever it begins. A span is the least run from a sentence (or part) on of at least
SPAN of them and LEAST_WORDS words; every passage of 46 words or more holds one. Spans are hashed over
their words, lower-cased (A-Z), so that white space does not matter. The first place of a span in the
corpus, by text id and position, keeps it; at every later place its sentences are removed.

The least place of each span hash is aggregated map-side first, so a passage that very many texts
share costs a row for each map task. In the join back, the places of a span with over PART_ROWS of them
are dealt over as many parts as that makes.

Defined results: null and empty texts and those without a span have no spans and stay as they are, as do rows
without an id; rows that share an id but not the text are different texts, ordered by a digest of the
text; rows that share both are one text and give the same result each; an empty table gives no rows;
columns named like the results are replaced, all others stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import Tables, free, small_batches

#: Sentences of a span, and words, at least.
SPAN, LEAST_WORDS = 3, 16
#: Words among which one begins a part of a long sentence.
PANE = 8
#: Places of one span that a task gets, about.
PART_ROWS = 200_000
#: Hash values by which repeated ids and frequent spans are told apart from the others.
SLOTS = 1 << 19
WIDE = "。！？｡"
STOPS = ".!?।॥؟۔" + WIDE
CLOSERS = "\"')]}”’»」』）"

_byte = lambda chars: np.isin(np.arange(256), [ord(c) for c in chars if c < "\x80"])
_STOP, _CLOSER = _byte(STOPS), _byte(CLOSERS)
_MARK = re.compile("|".join(c for c in STOPS + CLOSERS if c > "\x7f").encode())
_LEAD = np.isin(np.arange(256), [c.encode()[0] for c in STOPS + CLOSERS if c > "\x7f"])
_WIDE, _CLOSE = {c.encode() for c in WIDE}, {c.encode() for c in CLOSERS}


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and whether a sentence ends with it by a mark."""
    starts, ends = K.spans(K.NOT_WHITE[data], offs)
    stop, close = _STOP[data], _CLOSER[data]
    wide: list[tuple[int, int]] = []
    if _LEAD[data].any():
        for m in _MARK.finditer(data.tobytes()):
            if m.group() in _CLOSE:
                close[m.start() : m.end()] = True
            else:
                stop[m.end() - 1] = True
                if m.group() in _WIDE:
                    wide.append(m.span())
    solid = np.maximum.accumulate(np.where(close, -1, np.arange(len(data))))  # the last byte up to here that is of no closer
    if wide:
        first, end = np.array(wide).T
        marks, tail = np.zeros(len(data), bool), np.zeros(len(data), bool)
        marks[first] = tail[end - 1] = True
        p = np.arange(1, len(data))
        before = np.maximum(solid[:-1], 0)
        cut = p[tail[before] & (solid[:-1] >= 0) & ~close[1:] & K.NOT_WHITE[data[1:]] & ~(marks[1:] & (before == p - 1))]
        starts, ends = np.unique(np.concatenate((starts, cut))), np.unique(np.concatenate((ends, cut)))
    last = solid[ends - 1]
    return starts, ends, (last >= starts) & stop[np.maximum(last, 0)]


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start byte and words of every sentence or part of one, a hash of its words, the first of each text."""
    starts, ends, ended = _words(data, offs)
    n = len(starts)
    if not n:
        return starts, starts, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    low = K.LOWER[data]
    hashes = K.run_hashes(low, starts, ends)
    first, _ = K.owners(starts, offs)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    new = np.ones(n, bool)
    new[1:] = ended[:-1] | (lines[starts[1:]] > lines[ends[:-1]])
    new[first[:-1][first[:-1] < n]] = True
    if n >= PANE:
        final = np.append((data[1:] & 0xC0) != 0x80, True)  # the last byte of a character
        total = np.concatenate(([0], np.cumsum(np.where(final, low & 63, 0), dtype=np.int64)))
        value = (total[ends] - total[starts]) * 2654435761 % (1 << 32)
        least = value << 31 | ((1 << 31) - 1 - np.arange(n))
        for step in (1, 2, 4):
            least = np.minimum(least[:-step], least[step:])
        sentence = np.cumsum(new)
        least = least[sentence[: n - PANE + 1] == sentence[PANE - 1 :]]
        new[(1 << 31) - 1 - (least & (1 << 31) - 1)] = True
    at = np.flatnonzero(new)
    words = np.diff(np.append(at, n))
    # a sum of word hashes, each scrambled with its place in the sentence
    place = np.arange(n) - np.repeat(at, words)
    each = K.mix(hashes + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return starts[at], words, K.mix(np.add.reduceat(each, at)), np.searchsorted(at, first, "left")


def _span_ends(words: np.ndarray, first: np.ndarray, span: int, least: int) -> np.ndarray:
    """For each sentence the end (exclusive) of the span that begins with it, 0 where its text ends before."""
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.maximum(np.searchsorted(total, total[:-1] + least, "left"), np.arange(len(words)) + span)
    return np.where(end <= np.repeat(first[1:], np.diff(first)), end, 0)


def spans_of(text: Column, span: int = SPAN, least: int = LEAST_WORDS) -> Column:
    """(position of its first sentence, hash) of all spans of a text, in order."""

    @F.arrow_udf("array<struct<pos:int,h:bigint>>")
    def hashed(column: pa.Array) -> pa.Array:
        places, values, offs_out = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, _, data, offs in K.slices(column):
            _, words, h, first = sentences(data, offs)
            end = _span_ends(words, first, span, least)
            begin = np.flatnonzero(end)
            values.append(K.value_runs(h, begin, end[begin]).view(np.int64))
            places.append((begin - np.repeat(first[:-1], np.diff(first))[begin]).astype(np.int32))
            offs_out.append(offs_out[-1][-1] + np.searchsorted(begin, first[1:], "left"))
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(values))], ["pos", "h"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(offs_out), pa.int32()), items)

    return hashed(text)


def cut_spans(text: Column, cuts: Column, span: int = SPAN, least: int = LEAST_WORDS) -> Column:
    """(text without the sentences of the spans that begin at the places in cuts, sentences, sentences removed)."""

    @F.arrow_udf("struct<text:string,n_sentences:bigint,n_removed:bigint>")
    def cut(column: pa.Array, places: pa.Array) -> pa.Array:
        texts, total, removed = [], [], []
        null = np.asarray(pc.is_null(column))
        marks = places.to_pylist()
        for row, end, data, offs in K.slices(column):
            begin, words, _, first = sentences(data, offs)
            stop = _span_ends(words, first, span, least)
            for i in range(end - row):
                a, b = int(first[i]), int(first[i + 1])
                cover = np.zeros(b - a + 1, np.int64)
                at = np.array(marks[row + i] or (), np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, stop[a + at] - a, -1)
                gone = np.cumsum(cover)[:-1] > 0
                raw = data[offs[i] : offs[i + 1]].tobytes()
                total.append(b - a)
                removed.append(int(gone.sum()))
                if gone.any():
                    edge = np.append(begin[a + 1 : b], offs[i + 1])  # each sentence with the white space behind it
                    keep = np.flatnonzero(~gone)
                    raw = b"".join(raw[int(begin[a + k] - offs[i]) : int(edge[k] - offs[i])] for k in keep)
                texts.append(None if null[row + i] else raw.decode())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["text", "n_sentences", "n_removed"])

    return cut(text, cuts)


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def _keyed(docs: DataFrame, key: str, text: str, sub: str) -> DataFrame:
    """docs with sub: a digest of the text where the id may be repeated, else 0. With the id it tells texts apart.

    What is broadcast are hash values of the repeated ids, at most SLOTS."""
    slot = free(docs, "_slot")
    often = docs.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL").select(_slot(F.col("id")).alias(slot)).distinct()
    digest = F.conv(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 15), 16, 10).cast("long")
    return docs.join(F.broadcast(often), _slot(F.col(key)) == F.col(slot), "left").withColumn(sub, F.when(F.col(slot).isNotNull(), digest).otherwise(F.lit(0).cast("long"))).drop(slot)


def _repeated_places(keyed: DataFrame, key: str, text: str, sub: str, span: int, least: int, part_rows: int) -> DataFrame:
    """(id, sub, cuts): where the spans begin that are not the first of their kind, for each text that has any."""
    tables = Tables(keyed.sparkSession)
    found = keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(sub).alias("sub"), F.explode(spans_of(F.col(text), span, least)).alias("s"))
    found = tables.put(found.select("id", "sub", "s.pos", "s.h"))
    first = found.groupBy("h").agg(F.min(F.struct("id", "sub", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = tables.put(first.withColumn("slot", _slot(F.col("h"))))
    # frequent spans are dealt over parts; the others with their slot too. At most SLOTS rows are broadcast.
    hot = F.broadcast(first.where(F.col("n") > part_rows).groupBy("slot").agg(F.max(F.ceil(F.col("n") / part_rows)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    first = first.join(hot, "slot", "left").select("h", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = found.withColumn("slot", _slot(F.col("h"))).join(hot, "slot", "left").withColumn("part", F.pmod(F.xxhash64("id", "sub", "pos"), parts).cast("int"))
    again = dealt.join(first, ["h", "part"]).where(F.struct("id", "sub", "pos") > F.col("first"))
    return again.select("id", "sub", "pos").distinct().groupBy("id", "sub").agg(F.collect_list("pos").alias("cuts"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, least: int = LEAST_WORDS, part_rows: int = PART_ROWS) -> DataFrame:
    """docs with clean_text, n_sentences and n_removed."""
    kept = docs.drop("clean_text", "n_sentences", "n_removed")
    small_batches(docs.sparkSession)
    of, of_sub, places, new, sub = (free(docs, x) for x in ("_of", "_of_sub", "_places", "_cut", "_sub"))
    keyed = _keyed(docs, key, text, sub)
    cuts = _repeated_places(keyed, key, text, sub, span, least, part_rows).select(F.col("id").alias(of), F.col("sub").alias(of_sub), F.col("cuts").alias(places))
    some = keyed.where(F.col(key).isNotNull()).join(cuts, (F.col(key) == F.col(of)) & (F.col(sub) == F.col(of_sub)), "left")
    without = docs.where(F.col(key).isNull()).select(*docs.columns, F.lit(None).cast("array<int>").alias(places))
    out = some.select(*docs.columns, places).union(without).withColumn(new, cut_spans(F.col(text), F.col(places), span, least))
    return out.select(*kept.columns, F.col(f"{new}.text").alias("clean_text"), f"{new}.n_sentences", f"{new}.n_removed")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document, those removed as repeats, and what is left (its digest and length)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicate(docs)
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"), F.length("clean_text").cast("long").alias("clean_chars"))


_W = r"\x20\x09-\x0D"
_C = CLOSERS.replace("]", r"\]").replace("'", "''")
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, substr(sha256(coalesce(text, '')), 1, 15)) AS r, doc_id, text
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
p AS (SELECT r, regexp_extract_all(coalesce(text, ''), '[^{_W}{WIDE}]*[{WIDE}]+[{_C}]*[{_W}]*|[^{_W}{WIDE}]+[{_W}]*') AS w FROM d),
w AS (SELECT r, k, x, regexp_extract(x, '^[^{_W}]+') AS bare FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM p)),
n AS (SELECT *, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  CASE WHEN lag(k) OVER o IS NULL OR regexp_matches(lag(bare) OVER o, '[{STOPS}][{_C}]*$') OR contains(lag(x) OVER o, chr(10)) THEN 1 ELSE 0 END AS new FROM w WINDOW o AS (PARTITION BY r ORDER BY k)),
v AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY k) AS sent,
  (CAST(list_sum(list_transform(regexp_extract_all(low, '(?s).'), lambda c: unicode(c) & 63)) AS BIGINT) * 2654435761 % 4294967296) * 2147483648 + 2147483647 - k AS value FROM n),
y AS (SELECT *, CASE WHEN lead(sent, {PANE - 1}) OVER o = sent THEN min(value) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND {PANE - 1} FOLLOWING) END AS least FROM v WINDOW o AS (PARTITION BY r ORDER BY k)),
cut AS (SELECT DISTINCT r, 2147483647 - least % 2147483648 AS k FROM y WHERE least IS NOT NULL),
u AS (SELECT v.*, sum(CASE WHEN new = 1 OR cut.k IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY v.r ORDER BY v.k) AS s FROM v LEFT JOIN cut ON v.r = cut.r AND v.k = cut.k),
sent AS (SELECT r, s, string_agg(x, '' ORDER BY k) AS raw, string_agg(low, ' ' ORDER BY k) AS norm, count(*) AS n FROM u GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY s) AS upto FROM sent),
e AS (SELECT a.r, a.s, greatest(b.s, a.s + {SPAN - 1}) AS e FROM (SELECT r, s, upto - n + {LEAST_WORDS} AS want FROM c) a ASOF JOIN c b ON a.r = b.r AND a.want <= b.upto),
l AS (SELECT r, list(norm ORDER BY s) AS norms FROM sent GROUP BY r),
runs AS (SELECT e.r, e.s, e.e, array_to_string(norms[e.s:e.e], chr(10)) AS run FROM e JOIN l ON e.r = l.r JOIN d ON e.r = d.r WHERE e.e <= len(norms) AND doc_id IS NOT NULL),
again AS (SELECT r, s, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY r, s) AS x FROM runs) WHERE x > 1),
gone AS (SELECT DISTINCT r, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT) + 1)) AS s FROM again),
kept AS (SELECT sent.r, count(*) AS n, count(gone.s) AS cut, string_agg(raw, '' ORDER BY sent.s) FILTER (WHERE gone.s IS NULL) AS clean
  FROM sent LEFT JOIN gone ON sent.r = gone.r AND sent.s = gone.s GROUP BY 1),
t AS (SELECT x.doc_id, coalesce(n, 0) AS n, coalesce(cut, 0) AS cut, CASE WHEN coalesce(cut, 0) = 0 THEN x.text ELSE coalesce(clean, '') END AS clean
  FROM documents x LEFT JOIN d ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.text LEFT JOIN kept ON kept.r = d.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, CAST(cut AS BIGINT) AS n_removed, sha256(clean) AS clean_sha256, CAST(length(clean) AS BIGINT) AS clean_chars FROM t
"""
