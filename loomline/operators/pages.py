"""Pages of extracted documents: tables, boilerplate, status, quality reports, batches and whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T

# Phrases of boilerplate lines and words for diagrams.
BOILERPLATE = ("confidential", "proprietary", "all rights reserved", "internal use only", "do not distribute")
DIAGRAMS = ("diagram", "timeline", "flowchart", "flow chart", "arrow", "infographic", "process flow")
#: Pages of fewer characters say little.
TINY = 100
MARKER = r"<!--\s*PAGE\s+(\d+)\s*-->"
_TABLE = r"(?is)<table[^>]*>.*?</table>"


def boilerplate_key(line: Column, terms: Sequence[str] = BOILERPLATE, brands: Sequence[str] = ()) -> Column:
    """What makes lines of several pages the same boilerplate: page numbers, short notices with one of the terms, and names of brands; numbers count as equal. Null for other lines.

    Headings (but of brands), lists, tables and quotes are none."""
    x = F.trim(line)
    heading = F.lower(F.trim(F.regexp_replace(x, r"^#+\s*", "")))
    plain = F.regexp_replace(F.lower(F.regexp_replace(x, r"\s+", " ")), r"^[·•—–\-:;|]+|[·•—–\-:;|]+$", "")
    brand = heading.isin(*brands) if brands else F.lit(False)
    text = ~x.rlike(r"^(?:[#|>*\-]|```)") & ~x.rlike(r"^\d+\.\s+\S")

    def same(p: Column) -> Column:
        notice = F.lit(False)
        for t in terms:
            notice = notice | F.contains(p, F.lit(t))
        return F.when((p != "") & (p.rlike(r"^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$") | ((F.length(p) <= 120) & notice)), F.regexp_replace(p, r"\d+", "#"))

    # plain is named by a lambda, so that it is computed once
    return F.when(brand, heading).when(text, F.get(F.transform(F.array(plain), same), 0))


def simple_table(html: Column) -> Column:
    """A table of HTML as Markdown, its first row as the header; null if it has merged cells, a table inside, rows of different lengths, or no rows with text."""
    inner = F.regexp_replace(html, r"(?is)^\s*<table[^>]*>|</table>\s*$", "")
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+|\|", " ")))
    rows = F.filter(F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), cells), lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.array(line(F.transform(F.element_at(rows, 1), lambda _: F.lit("---"))))
    text = F.array_join(F.concat(F.transform(F.slice(rows, 1, 1), line), rule, F.transform(F.slice(rows, 2, 100_000), line)), "\n")
    odd = inner.rlike(r"(?i)(?:rowspan|colspan)\s*=") | inner.rlike(r"(?i)<table")
    even = F.forall(rows, lambda r: F.size(r) == F.size(F.element_at(rows, 1)))
    return F.when(~odd & (F.size(rows) > 0) & even, text)


def table_counts(content: Column) -> Column:
    """struct<html_tables, simple_tables, complex_tables, markdown_lines>."""
    tables = F.regexp_extract_all(content, F.lit(f"({_TABLE})"), 1)
    simple = F.size(F.filter(tables, lambda t: simple_table(t).isNotNull()))
    return F.struct(F.size(tables).alias("html_tables"), simple.alias("simple_tables"), (F.size(tables) - simple).alias("complex_tables"), T.markdown_table_lines(content).alias("markdown_lines"))


def mentions_diagram(content: Column) -> Column:
    out = F.lit(False)
    for t in DIAGRAMS:
        out = out | F.contains(F.lower(content), F.lit(t))
    return out


def page_status(canonical: Column, retrieval: Column, native: Column, warning: Column, tiny: int = TINY) -> Column:
    """empty, native_fallback, vision_warning, boilerplate_only, tiny or ok: the first that holds."""
    blank = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"\S")
    return F.when(blank(canonical), "empty").when(native, "native_fallback").when(warning.isNotNull(), "vision_warning").when(blank(retrieval), "boilerplate_only").when(F.length(F.trim(retrieval)) < tiny, "tiny").otherwise("ok")


def quality_report(pages: DataFrame, doc: str, content: str, status: str) -> DataFrame:
    """(doc, pages, counts of each status, sums of table counts, pages with a diagram, sha256 of the pages in order)."""
    t = table_counts(F.col(content))
    counted = pages.select(doc, "page", content, status, t.alias("_t"), mentions_diagram(F.col(content)).alias("_d"))
    kinds = ("ok", "empty", "tiny", "native_fallback", "vision_warning", "boilerplate_only")
    sums = [F.sum(f"_t.{c}").alias(c) for c in ("html_tables", "simple_tables", "complex_tables", "markdown_lines")]
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", content))), lambda x: F.coalesce(x.getField(content), F.lit(""))), "\n")
    return counted.groupBy(doc).agg(F.count("*").alias("pages"), *[F.count_if(F.col(status) == k).alias(f"n_{k}") for k in kinds], *sums, F.count_if("_d").alias("diagrams"), F.sha2(listed, 256).alias("digest"))


def extraction_counts(text: Column) -> Column:
    """struct<page_markers, table_lines, digest> of a whole document."""
    return F.struct(F.size(F.regexp_extract_all(text, F.lit(MARKER), 1)).alias("page_markers"), T.markdown_table_lines(text).alias("table_lines"), F.sha2(text, 256).alias("digest"))


def stitched(pages: DataFrame, doc: str, page: str, content: str) -> DataFrame:
    """(doc, content): pages in order, each behind its marker."""
    text = F.concat(F.lit("<!-- PAGE "), F.col(page).cast("string"), F.lit(" -->\n"), F.coalesce(content, F.lit("")))
    listed = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page), text.alias("_x")))).alias("_l"))
    return listed.select(doc, F.array_join("_l._x", "\n\n").alias("content"))


def split_pages(docs: DataFrame, doc: str, content: str) -> DataFrame:
    """(doc, page, content): a document, or a model's answer for a batch of pages, cut at its page markers."""
    parts = F.slice(F.split(content, r"(?=<!--\s*PAGE\s+\d+\s*-->)"), 1, 1_000_000)
    rows = docs.select(doc, F.explode(F.filter(parts, lambda x: x.rlike(MARKER))).alias("_x"))
    return rows.select(doc, F.regexp_extract("_x", MARKER, 1).cast("int").alias("page"), F.regexp_replace(F.regexp_replace("_x", MARKER + r"\n?", ""), r"\n+$", "").alias("content"))


def batches(pages: DataFrame, doc: str, page: str, size: Column, most_pages: int, most_bytes: int) -> DataFrame:
    """pages with batch: consecutive pages of a document, at most so many, and of about so many bytes (a page counts in the batch that its first byte falls in)."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(size).over(Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1
    placed = pages.withColumn("_b", F.floor(before / most_bytes)).withColumn("_n", F.floor(number / most_pages))
    return placed.withColumn("batch", F.dense_rank().over(Window.partitionBy(doc).orderBy("_n", "_b"))).drop("_b", "_n")


def page_key(doc: Column, page: Column, content: Column, model: str, version: str) -> Column:
    """The key under which a page's extraction is cached."""
    return F.sha2(F.concat_ws("|", doc.cast("string"), page.cast("string"), F.sha2(content, 256), F.lit(model), F.lit(version)), 256)


def cached(pages: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    """pages with what the manifest (key, text) has for them, and hit."""
    return pages.join(manifest.select(key, F.col("text").alias("cached_text")), key, "left").withColumn("hit", F.col("cached_text").isNotNull())
