"""Citations: answers cut into sentences, the chunks that support them, markers, references and footnotes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import texts as T
from ..functions import vectors as V
from ..functions.batches import small_batches

MARKER = r"\[\d+\]"
#: Words of references that every task holds, at most; each counts once a reference.
MOST_KNOWN = 200_000
#: Hits, and counts of a sentence and a reference, that are held at once, about.
HITS = 1 << 22
# Words that say nothing about a reference, and beginnings of sentences that claim nothing.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "and", "or", "but", "if", "then",
    "else", "when", "where", "why", "how", "what", "which", "who", "whom", "this", "that", "these", "those", "it", "its", "of", "to", "for", "with", "on", "at", "by", "from", "in", "as",
)
META = (
    "based on", "according to the context", "the context shows", "the information provided", "i can", "i cannot", "i don't", "let me", "here is", "here are", "in summary", "to summarize", "in conclusion",
)


def sentences(answers: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, position, sentence): cut after . ! ? before white space and a capital."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")
    return answers.select(id_, F.posexplode(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")).alias("position", "sentence"))


def has_citation(text: Column) -> Column:
    return text.rlike(MARKER)


def is_factual(sentence: Column) -> Column:
    """Whether a sentence makes a claim: of twenty characters or more, no question, heading or list item, and no remark about the answer itself."""
    s = F.trim(sentence)
    meta = F.lit(False)
    for phrase in META:
        meta = meta | F.lower(s).startswith(phrase)
    return (F.length(s) >= 20) & ~s.endswith("?") & ~s.rlike(r"^[#\-*•>]") & ~meta


def with_citation(sentence: Column, reference: Column) -> Column:
    """The sentence with [reference] before its last mark."""
    s = F.rtrim(sentence)
    mark = F.concat(F.lit(" ["), reference.cast("string"), F.lit("]"))
    return F.when(s.rlike(r"[.!?]$"), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), mark, F.substring(s, -1, 1))).otherwise(F.concat(s, mark))


def _whole_words(text: Column, pattern: str) -> Column:
    """Distinct words, of letters and digits of any script and `_`, that match a pattern as a whole."""
    # a word that matches is taken, any other passed over as a whole and empty
    word = r"[\p{L}\p{N}_]"
    return F.array_remove(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern}+)(?!{word})|{word}++"), 1)), "")


def _content_words(text: Column) -> Column:
    return F.filter(_whole_words(text, "[a-z][a-z0-9]+"), lambda w: ~w.isin(*STOPWORDS))


def _best_held(known: list[tuple], kind: DataType) -> Callable[[Column, Column], Column]:
    """Of (by, reference, word) rows, word null if it has none: the best reference of a `by` and a lower-cased sentence, found within the sentence's row."""
    stop, made, most_hits = frozenset(STOPWORDS), to_arrow_type(kind), HITS

    @F.arrow_udf(kind)
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # a word's references as the bytes of their numbers, which count from 0 within a `by`, the least first
        ids: dict = {}
        for q, reference, _ in known:
            ids.setdefault(q, set()).add(reference)
        ids = {q: sorted(x) for q, x in ids.items()}
        number = {q: {reference: i for i, reference in enumerate(x)} for q, x in ids.items()}
        posted: dict = {q: {} for q in ids}
        for q, reference, w in known:
            if w is not None:
                posted[q].setdefault(w, []).append(number[q][reference])
        posted = {q: {w: np.array(x, np.int32).tobytes() for w, x in words.items()} for q, words in posted.items()}
        width = max(map(len, ids.values()), default=1)
        words = re.compile(r"(?<!\w)[a-z][a-z0-9]+(?!\w)").findall

        def most(by: list, hits: list[bytes]) -> list:
            at = np.repeat(np.arange(len(hits)) * width, [len(h) // 4 for h in hits]) + np.frombuffer(b"".join(hits), np.int32)
            counts = np.bincount(at, minlength=len(hits) * width).reshape(-1, width)
            first = counts.argmax(1)
            return [ids[q][i] if n else None for q, i, n in zip(by, first.tolist(), counts[np.arange(len(hits)), first].tolist())]

        for bys, sentences_ in batches:
            out, rows, by, hits, n = [None] * len(bys), [], [], [], 0
            for row, (q, s) in enumerate(zip(bys.to_pylist(), sentences_.to_pylist())):
                if s is None or q not in ids:
                    continue
                found = set(words(s)) - stop
                if not found:
                    out[row] = ids[q][0]
                    continue
                get = posted[q].get
                rows.append(row)
                by.append(q)
                hits.append(b"".join([x for x in map(get, found) if x]))
                n += len(hits[-1]) // 4
                if max(n, len(rows) * width) >= most_hits:
                    for i, x in zip(rows, most(by, hits)):
                        out[i] = x
                    rows, by, hits, n = [], [], [], 0
            for i, x in zip(rows, most(by, hits) if rows else ()):
                out[i] = x
            yield pa.array(out, made)

    return best


def best_references(rows: DataFrame, references: DataFrame, keys: Sequence[str], sentence: str, by: str, text: Sequence[str], id_: str = "reference_id") -> DataFrame:
    """rows (keys, by, sentence) with the reference of the same `by` that shares most words (ties: the least id); null if none shares any.

    A sentence without content words gets the first reference. References of at most MOST_KNOWN words (counted first) are held by every task, and sentences
    stay where they are; with more, sentences meet references by a shared word."""
    references = references.where(F.col(by).isNotNull() & F.col(id_).isNotNull())
    some = references.select(by, id_, F.explode_outer(_content_words(F.concat_ws(" ", *text))).alias("_w")).limit(MOST_KNOWN + 1).collect()
    if len(some) <= MOST_KNOWN:
        small_batches()
        best_of = _best_held([tuple(r) for r in some], references.schema[id_].dataType)
        return rows.withColumn(id_, best_of(F.col(by), F.lower(sentence)))
    words = rows.select(*keys, by, F.explode_outer(_content_words(F.col(sentence))).alias("_w"))
    known = references.select(by, id_, F.explode(_content_words(F.concat_ws(" ", *text))).alias("_w"))
    hits = words.join(known, [by, "_w"]).groupBy(*keys, by, id_).agg(F.count("*").alias("_n"))
    best = hits.groupBy(*keys, by).agg(F.min_by(id_, F.struct(-F.col("_n"), F.col(id_))).alias("_best"))
    first = references.groupBy(by).agg(F.min(id_).alias("_first"))
    out = rows.join(best, [*keys, by], "left").join(first, by, "left")
    return out.withColumn(id_, F.when(F.size(_content_words(F.col(sentence))) == 0, F.col("_first")).otherwise(F.col("_best"))).drop("_best", "_first")


def cited(rows: DataFrame, references: DataFrame, keys: Sequence[str], sentence: str, by: str, text: Sequence[str], coverage: float = 0.5, answer: str | None = None) -> DataFrame:
    """rows with fixed: claims without a citation get that of their best reference, in answers (a column; if none, the rows of one `by`) of which under `coverage` of the claims have one."""
    claim = is_factual(F.col(sentence))
    share = F.avg(F.when(claim, has_citation(F.col(sentence)).cast("double"))).over(Window.partitionBy(answer or by))
    found = best_references(rows, references, keys, sentence, by, text).withColumn("_share", share)
    add = claim & ~has_citation(F.col(sentence)) & (F.col("_share") < coverage) & F.col("reference_id").isNotNull()
    return found.withColumn("fixed", F.when(add, with_citation(F.col(sentence), F.col("reference_id"))).otherwise(F.col(sentence))).drop("_share")


def overlap_words(text: Column) -> Column:
    """The distinct words of three letters or more that `overlap` compares; of a row that stands in many pairs they are best taken before it is paired."""
    return _whole_words(text, "[a-z]{3,}")


def overlap(sentence: Column, content: Column) -> Column:
    """The share of a sentence's words (overlap_words) that a content has."""
    n = F.size(sentence)
    return F.when(n > 0, F.size(F.array_intersect(sentence, content)) / n).otherwise(0.0)


def supported(pairs: DataFrame, keys: Sequence[str], vector: str, other: str, sentence: str, content: str, reference: str, least: float = 0.5, most: int = 3) -> DataFrame:
    """(keys, reference, similarity, rank): 0.7 cosine + 0.3 overlap of pairs of a sentence and a candidate chunk, where both it and the cosine reach `least`.

    sentence and content: texts, or their overlap_words. Each reference counts once a sentence, with its best chunk; at most so many of them."""
    words = {c: F.col(c) if pairs.schema[c].dataType.typeName() == "array" else overlap_words(F.col(c)) for c in (sentence, content)}
    # generated columns, so that each is computed once
    close = pairs.select("*", F.inline(F.array(F.struct(V.cosine(F.col(vector), F.col(other)).alias("_c"))))).where(F.col("_c") >= least)
    scored = close.withColumn("similarity", F.round(0.7 * F.col("_c") + 0.3 * overlap(words[sentence], words[content]), 6))
    best = scored.where(F.col("similarity") >= least).groupBy(*keys, reference).agg(F.max("similarity").alias("similarity"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), reference))).where(F.col("rank") <= most)


def marked_answers(sentence_rows: DataFrame, support: DataFrame, id_: str) -> DataFrame:
    """(id, answer, n_citations): sentences (id, position, sentence) with [1,2] behind each that is supported (id, position, reference_id), joined again."""
    refs = support.groupBy(id_, "position").agg(F.array_join(F.array_sort(F.collect_set(F.col("reference_id").cast("string"))), ",").alias("_refs"))
    lines = sentence_rows.join(refs, [id_, "position"], "left").withColumn("_s", F.concat("sentence", F.coalesce(F.concat(F.lit("["), "_refs", F.lit("]")), F.lit(""))))
    out = lines.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("position", "_s"))).alias("_l"), F.count("_refs").alias("n_citations"))
    return out.select(id_, F.array_join("_l._s", " ").alias("answer"), "n_citations")


def referenced_chunks(chunks: DataFrame, references: DataFrame, path: str) -> DataFrame:
    """chunks with the reference of their file; chunks without an id get the digest of their content."""
    out = chunks.join(references.select(path, "reference_id"), path)
    return out.withColumn("chunk_id", F.coalesce("chunk_id", F.sha2("content", 256)))


def footnotes(references: DataFrame, chunks: DataFrame, used: DataFrame, position: str) -> DataFrame:
    """(reference_id, footnote): [n] "Title", with the excerpt of the first chunk, for each reference that is used."""
    first = chunks.groupBy("reference_id").agg(F.min_by("content", position).alias("_c"))
    r = references.join(used.select("reference_id").distinct(), "reference_id", "left_semi").join(first, "reference_id", "left")
    title = F.initcap(F.regexp_replace(F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", ""), "[_-]", " "))
    head = F.concat(F.lit("["), F.col("reference_id").cast("string"), F.lit('] "'), title, F.lit('"'))
    return r.select("reference_id", F.concat(head, F.coalesce(F.concat(F.lit('. "'), T.excerpt(F.col("_c")), F.lit('"')), F.lit(""))).alias("footnote"))


_REFERENCES = r"(?im)^#{0,6}[ \t]*\**references\**:?[ \t]*\n((?:[ \t]*[-*][ \t]*\[\d+\][^\n]*\n?|[ \t]*\n)+)"


def without_references(text: Column) -> Column:
    """An answer without the list of references that was written into it."""
    return F.regexp_replace(F.regexp_replace(text, _REFERENCES, ""), r"^\s+|\s+$", "")


def references_once(text: Column) -> Column:
    """An answer whose list of references has each line once."""
    block = F.regexp_extract(text, _REFERENCES, 1)
    lines = F.array_distinct(F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(block != "", F.replace(text, block, F.concat(F.array_join(lines, "\n"), F.lit("\n")))).otherwise(text)


def plain_markers(text: Column) -> Column:
    """Markers without emphasis around them, and each once where it is repeated."""
    x = F.regexp_replace(text, r"\*{1,2}(\[\d+\])\*{1,2}|_{1,2}(\[\d+\])_{1,2}", "$1$2")
    return F.regexp_replace(x, r"(\[\d+\])(?:\s*\1)+", "$1")


def unsupported_quotes_removed(text: Column, source: Column) -> Column:
    """An answer with the marks taken off those quotes, of fifteen characters or more, that its source does not hold word by word."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")
    quotes = F.array_distinct(F.regexp_extract_all(text, F.lit(r'"([^"]{15,})"'), 1))
    bad = F.filter(quotes, lambda q: ~F.contains(plain(source), F.trim(plain(q))))
    return F.aggregate(bad, text, lambda out, q: F.replace(out, F.concat(F.lit('"'), q, F.lit('"')), q))


def unsupported_acronyms(text: Column, source: Column) -> Column:
    """Acronyms in brackets behind a name that the source never writes."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\(([A-Z]{2,8})\)"), 1))
    return F.filter(found, lambda a: ~F.rlike(source, F.concat(F.lit(r"\b"), a, F.lit(r"\b"))))


def unsupported_acronyms_removed(text: Column, source: Column) -> Column:
    return F.aggregate(unsupported_acronyms(text, source), text, lambda out, a: F.replace(out, F.concat(F.lit(" ("), a, F.lit(")")), F.lit("")))
