"""Text expressions: tokens, similarity, cleaning, citations."""

from __future__ import annotations

import html
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of tokens and the weights of terms below.
#: A lexical token: letters and digits, with single joining signs inside.
TOKEN = r"[a-z0-9]+(?:[._/-][a-z0-9]+)*"
WORD = r"[a-z0-9]+"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)


def runs(ordered: Column, term: Callable[[Column], Column], made: Callable[[Column], Column], name: str) -> Column:
    """array<struct<term, name>>: for each stretch of entries of an ordered array that have one term, this and what is made of them.

    Step by step over arrays, so that each is computed once and passed once."""

    def cut(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda _, i: i), lambda i: (i == 0) | (term(F.get(x, i)) != term(F.get(x, i - 1))))
        return F.element_at(F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(term(F.get(x, i)).alias("term"), made(F.slice(x, i + 1, F.coalesce(F.get(s, k + 1), F.size(x)) - i)).alias(name)))), 1)

    return F.element_at(F.transform(F.array(ordered), cut), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-cased words, each padded with two spaces before and one behind."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def strip_reasoning(text: Column) -> Column:
    """Without <think> blocks, closed or left open at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def without_controls(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def unescaped(text: Column) -> Column:
    """Every entity of HTML, by name or number, as the character that it stands for; texts without an ampersand go past Python."""

    @F.arrow_udf("string")
    def plain(column: pa.Array) -> pa.Array:
        return pa.array([html.unescape(t) if t is not None else None for t in column.to_pylist()], pa.string())

    some = F.contains(text, F.lit("&"))
    return F.when(some, plain(F.when(some, text))).otherwise(text)


def sanitized(text: Column) -> Column:
    """Valid UTF-8 (bytes of surrogates and other broken ones as U+FFFD), with entities of HTML as characters, without control characters, trimmed."""
    return without_controls(unescaped(F.make_valid_utf8(text)))


def excerpt(text: Column, most: int = 150) -> Column:
    """The first characters, with an ellipsis if the text goes on."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def html_text(html: Column) -> Column:
    """Text of simple HTML: scripts and styles dropped, block ends as line breaks, other tags dropped, white space pressed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|ul|ol|table|section|article)>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(x, r"\n{2,}", "\n"))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? with white space behind."""
    return F.filter(F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.length(F.trim(s)) > 0)


def specific(term: Column) -> Column:
    """Whether a term is specific: it has a digit or a joining sign, or eight letters or more."""
    return term.rlike(r"[0-9]") | term.rlike(r"[._/-]") | (F.length(term) >= 8)


def term_weight(term: Column) -> Column:
    return (
        F.lit(1.0)
        + F.when(F.contains(term, F.lit(" ")), 0.35).otherwise(0.0)
        + F.when(term.rlike(r"[0-9]"), 0.35).otherwise(0.0)
        + F.when(term.rlike(r"[._/-]"), 0.15).otherwise(0.0)
        + F.when(F.length(term) >= 8, 0.10).otherwise(0.0)
    )


def markdown_table_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & F.trim(x).endswith("|")))
