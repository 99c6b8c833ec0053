"""Extracted documents put together: a record a page, a report and two texts a document.

Pages come from a vision model, some with a warning, some with the text that the file itself holds (native).
A page is normalised (simple tables of HTML as Markdown, blocks as lines); where the model gave nothing, little
or a cut answer, longer native text takes its place. The canonical text keeps every page behind its marker, the
retrieval text leaves out notices that many pages repeat, and pages that have nothing else.

Defined results: null contents count as empty; page numbers that are missing up to the document's count of pages
are empty pages; of rows with the same number the first by (content, native, warning) counts; pages without a
document or a number from 1 are left out; a table without rows gives no rows. Rows of a page never meet those of another
document's; only the texts and the report of a document are gathered, as they are one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from . import pages as P
from .lineage import written

# Warnings after which native text is looked at, and the least share and number of pages of a repeated notice.
CUT_SHORT = ("vision_truncation", "vision_empty_response", "vision_error")
REPEATED_SHARE, REPEATED_PAGES = 0.25, 3
_TABLE = r"(?is)<table\b.*?</table>"
_ITEM = r"(?is)<li\b[^>]*>(.*?)</li>"
_MARK = "\u0000"
#: What is known of a page, in the order of the records.
RECORD = (
    "status", "source_method", "warnings", "char_count_raw", "char_count_normalized", "char_count_retrieval", "used_in_retrieval",
)


def _between(text: Column, pattern: str, change, other=lambda x: x) -> Column:
    """A text whose matches of a pattern (its last group) are changed, and what is between them too."""
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern if "(.*?)" in pattern else f"({pattern})"), 1), F.array(F.lit(None).cast("string")))
    return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.array(other(a), change(b)))), "")


def tables_as_markdown(text: Column) -> Column:
    """A text whose simple tables are Markdown between blank lines; other tables stay."""
    return _between(text, _TABLE, lambda t: F.coalesce(F.concat(F.lit("\n\n"), P.simple_table(t), F.lit("\n\n")), t))


def _item(text: Column) -> Column:
    """A list item on one line, without tags."""
    x = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", " "), r"</?[\w:-]+\b[^>]*>", "")
    return F.concat(F.lit("- "), F.trim(F.regexp_replace(x, r"(?i)(?:\s|&nbsp;|&#160;)+", " ")))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized(rows: DataFrame, content: str, name: str) -> DataFrame:
    """rows with a page as Markdown: simple tables as such, other tables as they are, breaks, paragraphs and lists of HTML as
    lines, entities as characters, at most one blank line in a row. Each step is a column of its own, so that no step is computed twice."""
    x, tables = "_x", "_tables"
    out = rows.withColumn(x, F.replace(F.coalesce(content, F.lit("")), F.lit(_MARK), F.lit("")))
    out = out.withColumn(x, F.when(F.col(x).rlike(_TABLE), tables_as_markdown(F.col(x))).otherwise(F.col(x)))
    out = out.withColumn(tables, F.concat(F.regexp_extract_all(x, F.lit(f"({_TABLE})"), 1), F.array(F.lit(""))))
    lines = F.array_join(F.split(x, _TABLE, -1), _MARK)
    for pattern, new in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>\s*<p\b[^>]*>", "\n\n"), (r"(?i)<p\b[^>]*>", ""), (r"(?i)</p>", "\n\n")):
        lines = F.regexp_replace(lines, pattern, new)
    out = out.withColumn(x, lines).withColumn(x, _between(F.col(x), _ITEM, _item))
    out = out.withColumn(x, F.regexp_replace(F.regexp_replace(x, r"(?i)</?(?:ul|ol)\b[^>]*>", "\n"), r"(?i)</?(?:div|span|strong|b|em|i)\b[^>]*>", ""))
    out = out.withColumn(x, T.unescaped(F.col(x)))
    whole = F.array_join(F.flatten(F.zip_with(F.split(x, _MARK, -1), F.col(tables), lambda a, b: F.array(a, b))), "")
    return out.withColumn(name, _stripped(F.regexp_replace(whole, r"\n{3,}", "\n\n"))).drop(x, tables)


def usable(text: Column) -> Column:
    """Whether a text has a letter or digit outside markup."""
    x = F.regexp_replace(text, r"(?is)<!--.*?-->|<\?.*?\?>|<!DOCTYPE.*?>", " ")
    x = F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    x = F.regexp_replace(x, r"(?is)<!(?!--|\[CDATA\[).*?>|</?[\w:-]+\b[^>]*>|&(?:#\d+|#x[\da-f]+|\w[\w:-]*);", " ")
    return x.rlike(r"[\p{L}\p{N}]")


def complete(pages: DataFrame, counts: DataFrame | None, doc: str, page: str) -> DataFrame:
    """(doc, page, content, native, warning, message, n): each number from 1 to n once, n being the greater of the last page and the document's row of counts (doc, page_count)."""
    given = pages.where(F.col(doc).isNotNull() & (F.col(page) >= 1)).select(F.col(doc).alias("doc"), F.col(page).cast("int").alias("page"), "content", "native", "warning", "message")
    once = given.groupBy("doc", "page").agg(F.min(F.struct("content", "native", "warning", "message")).alias("_x"))
    sizes = once.groupBy("doc").agg(F.max("page").alias("n"))
    if counts is not None:
        known = counts.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col("page_count").cast("int").alias("n"))
        sizes = sizes.unionByName(known).groupBy("doc").agg(F.max("n").alias("n"))
    numbers = sizes.where("n >= 1").select("doc", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    return numbers.join(once, ["doc", "page"], "left").select("doc", "page", "n", "_x.*")


def records(
    pages: DataFrame, counts: DataFrame | None = None, doc: str = "doc_id", page: str = "page",
    terms: Sequence[str] = P.BOILERPLATE, brands: Sequence[str] = (), tiny: int = P.TINY,
) -> DataFrame:
    """A row a page: doc, page, n, raw, canonical_content, retrieval_content, warning, the columns of RECORD, empty (no retrieval text) and tables.

    pages have doc, page, content, native, warning (its source) and message. Lines are compared by the key of a notice:
    only keys and their counts are shuffled, and the few that are repeated join the pages again. Normalised pages and
    the keys of their lines are read twice, so they are computed once and written below the checkpoint folder when this is called."""
    base = complete(pages, counts, doc, page).withColumn("raw", F.coalesce("content", F.lit("")))
    base = normalized(normalized(base, "raw", "_v"), "native", "_n").drop("content", "native")
    base = base.withColumn("_blank", ~usable(F.col("_v")))
    weak = F.col("_blank") | (F.length(_stripped(F.col("_v"))) < tiny) | F.coalesce(F.col("warning").isin(*CUT_SHORT), F.lit(False))
    native = weak & (F.col("_blank") | (F.length("_n") > F.length("_v"))) & usable(F.col("_n"))
    base = base.withColumn("_native", native).withColumn("canonical_content", F.when(F.col("_native"), F.col("_n")).otherwise(F.col("_v"))).drop("_v", "_n", "_blank")

    key = lambda line: P.boilerplate_key(line, terms, brands)
    keyed = written(base.withColumn("_keys", F.transform(F.split("canonical_content", "\n", -1), key)))
    found = keyed.select("doc", "n", F.explode(F.array_compact(F.array_distinct("_keys"))).alias("_k")).groupBy("doc", "n", "_k").agg(F.count("*").alias("_c"))
    often = (F.col("n") >= REPEATED_PAGES) & (F.col("_c") >= F.greatest(F.lit(REPEATED_PAGES), F.ceil(F.col("n") * REPEATED_SHARE)))
    gone = found.where(often | F.col("_k").isin(*brands) if brands else often).groupBy("doc").agg(F.collect_list("_k").alias("_gone"))
    kept = keyed.join(gone, "doc", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<string>")))
    lines = F.filter(F.arrays_zip(F.split("canonical_content", "\n", -1).alias("line"), F.col("_keys").alias("key")), lambda x: x.key.isNull() | ~F.array_contains(F.col("_gone"), x.key))
    kept = kept.withColumn("retrieval_content", _stripped(F.array_join(F.transform(lines, lambda x: x.line), "\n")))

    canonical, retrieval, raw = F.col("canonical_content"), F.col("retrieval_content"), F.col("raw")
    status = P.page_status(F.when(usable(canonical), canonical), F.when(usable(retrieval), retrieval), F.col("_native"), F.col("warning"), tiny)
    kept = kept.withColumn("status", status).withColumn("used_in_retrieval", usable(retrieval))
    notes = {"empty": "empty_page", "native_fallback": "native_fallback", "boilerplate_only": "retrieval_omitted_boilerplate_only", "tiny": "low_content_page"}
    noted = F.when(F.col("status") == "vision_warning", F.concat("warning", F.lit(": "), F.coalesce("message", F.lit(""))))
    for name, note in notes.items():
        noted = noted.when(F.col("status") == name, note)
    method = F.when(F.col("_native") & usable(raw), "vision_plus_native").when(F.col("_native"), "native").when(usable(raw), "vision").otherwise("none")
    return kept.select(
        "doc", "page", "n", "raw", canonical, retrieval, "warning", "status", method.alias("source_method"), F.array_compact(F.array(noted)).alias("warnings"),
        F.length(raw).alias("char_count_raw"), F.length(canonical).alias("char_count_normalized"), F.length(retrieval).alias("char_count_retrieval"),
        "used_in_retrieval", P.table_counts(canonical).alias("tables"), P.mentions_diagram(canonical).alias("diagram"),
    )


def texts(found: DataFrame) -> DataFrame:
    """(doc, canonical, retrieval) of records: pages in order behind their markers, with the status of pages that are not plainly good; retrieval holds used pages alone."""
    mark = F.concat(F.lit("<!-- PAGE "), F.col("page").cast("string"), F.lit(" -->"))
    status = F.when((F.col("status") != "ok") | ~F.col("used_in_retrieval"), F.concat(F.lit("<!-- PAGE_STATUS: "), "status", F.lit(" -->")))
    whole = F.concat_ws("\n\n", mark, status, F.when(F.col("canonical_content") != "", F.col("canonical_content")))
    used = F.when(F.col("used_in_retrieval"), F.concat(mark, F.lit("\n\n"), "retrieval_content"))
    listed = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", whole.alias("a"), used.alias("b")))).alias("_l"))
    return listed.select("doc", F.array_join("_l.a", "\n\n").alias("canonical"), F.array_join("_l.b", "\n\n").alias("retrieval"))


def warning_counts(found: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(doc, source, n): warnings of pages, of documents (extra: doc, source), those in records by what is before the colon, and one of quality where a page has no text left or was cut."""
    raw = found.where("warning IS NOT NULL").select("doc", F.col("warning").alias("source"))
    if extra is not None:
        raw = raw.unionByName(extra.select("doc", "source"))
    noted = found.select("doc", F.explode("warnings").alias("_w")).select("doc", F.substring_index("_w", ":", 1).alias("source"))
    bad = found.where("NOT used_in_retrieval").select("doc").union(raw.where(F.col("source") == CUT_SHORT[0]).select("doc")).distinct()
    every = raw.unionByName(noted).unionByName(bad.withColumn("source", F.lit("vision_quality")))
    return every.groupBy("doc", "source").agg(F.count("*").alias("n"))


def reports(found: DataFrame, extra: DataFrame | None = None, tiny: int = P.TINY) -> DataFrame:
    """A row a document: counts of its pages, the numbers of its pages of each kind, its tables, and a map of warnings.

    What it reads of the records, no texts, is read several times, so it is computed once and written below the checkpoint folder when this is called."""
    found = written(found.select("doc", "page", "warning", "status", "source_method", "warnings", "char_count_retrieval", "used_in_retrieval", "tables", "diagram"))
    short = (F.col("char_count_retrieval") > 0) & (F.col("char_count_retrieval") < tiny)
    any_table = (F.col("tables.html_tables") > 0) | (F.col("tables.markdown_lines") > 0)
    kinds = {
        "empty_pages": F.col("status") == "empty", "tiny_pages": short, "unexplained_tiny_pages": short & (F.col("status") == "ok"),
        "boilerplate_only_pages": F.col("status") == "boilerplate_only", "native_fallback_pages": F.col("source_method").isin("native", "vision_plus_native"),
        "dropped_retrieval_pages": ~F.col("used_in_retrieval"), "pages_containing_tables": any_table, "pages_containing_diagrams": F.col("diagram"),
    }
    numbers = [F.array_sort(F.collect_list(F.when(x, F.col("page")))).alias(name) for name, x in kinds.items()]
    sums = [F.sum(f"tables.{c}").alias(c) for c in ("html_tables", "simple_tables", "complex_tables", "markdown_lines")]
    counted = found.groupBy("doc").agg(F.count("*").alias("page_count"), F.count_if("used_in_retrieval").alias("pages_emitted_retrieval"), *numbers, *sums)
    warned = warning_counts(found, extra).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("warning_counts"))
    return counted.join(warned, "doc", "left").withColumn("warning_counts", F.coalesce("warning_counts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))))


def manifests(found: DataFrame, report: DataFrame, model: str, version: str) -> DataFrame:
    """(doc, manifest): JSON of a document's report and of what the records say of its pages; the texts stay in the records."""
    listed = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", *RECORD))).alias("page_records"))
    inner = F.struct(*[c for c in report.columns if c != "doc"]).alias("quality_report")
    whole = F.struct(F.lit(1).alias("schema_version"), F.lit(version).alias("extractor_version"), F.lit(model).alias("model"), inner, "page_records")
    return report.join(listed, "doc").select("doc", F.to_json(whole).alias("manifest"))
