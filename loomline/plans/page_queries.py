"""Pages: lines of documents stand for pages, raw pages for HTML with tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import etl
from ..operators import pages as P
from .registry import query, table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is one of its pages."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "content"))


_P = "p AS (SELECT doc_id, (unnest(range(1, len(l) + 1)) - 1)::INT AS page, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'page # of #' WHEN 1 THEN ' confidential, draft # ' WHEN 2 THEN 'acme' ELSE NULL END AS key FROM documents""")
def boilerplate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    line = F.when(m == 0, F.concat(F.lit("Page "), n, F.lit(" of 99"))).when(m == 1, F.concat(F.lit("— Confidential,  draft "), n, F.lit(" —"))).when(m == 2, "## ACME").when(m == 3, "- confidential item").when(m == 4, "1. confidential").otherwise("An ordinary line")
    return table(spark, sf_dir, "documents").select("doc_id", P.boilerplate_key(line, brands=["acme"]).alias("key"))


@query(r"""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '| name | balance |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_name || ' | ' || CAST(s_acctbal AS VARCHAR) || ' |' END AS markdown, 1::INT AS html_tables, (s_suppkey % 3 = 0)::INT AS simple_tables, (s_suppkey % 3 > 0)::INT AS complex_tables, 0::INT AS markdown_lines FROM supplier""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("s_suppkey") % 3
    row = F.concat(F.lit("<tr><td><b>"), "s_name", F.lit("</b></td><td "), F.when(m == 1, 'colspan="2"').otherwise(""), F.lit(">"), F.col("s_acctbal").cast("string"), F.lit("</td></tr>"))
    html = F.when(m == 2, "<table>no rows</table>").otherwise(F.concat(F.lit("<table border=1>\n<tr><th>name</th><th> balance</th></tr>\n"), row, F.lit("\n</table>")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html"))
    return rows.select("s_suppkey", P.simple_table(F.col("html")).alias("markdown"), P.table_counts(F.concat(F.lit("before\n"), "html", F.lit("\nafter"))).alias("t")).select("s_suppkey", "markdown", "t.*")


_STATUS = f"CASE WHEN NOT regexp_matches(content, '\\S') THEN 'empty' WHEN (doc_id + page) % 7 = 0 THEN 'native_fallback' WHEN (doc_id + page) % 11 = 0 THEN 'vision_warning' WHEN (doc_id + page) % 5 = 0 THEN 'boilerplate_only' WHEN length(trim(content, ' ')) < {P.TINY} THEN 'tiny' ELSE 'ok' END"


def _with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("doc_id") + F.col("page"), F.col("content")
    status = P.page_status(text, F.when(n % 5 == 0, "").otherwise(text), n % 7 == 0, F.when(n % 11 == 0, "blurred"))
    return _pages(spark, sf_dir).withColumn("status", status)


@query(f"WITH {_P} SELECT doc_id, page, {_STATUS} AS status FROM p")
def page_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_status(spark, sf_dir).select("doc_id", "page", "status")


@query(f"""WITH {_P}, s AS (SELECT *, {_STATUS} AS status FROM p) SELECT doc_id, count(*) AS pages, {', '.join(f"count(*) FILTER (WHERE status = '{k}') AS n_{k}" for k in ('ok', 'empty', 'tiny', 'native_fallback', 'vision_warning', 'boilerplate_only'))},
  0::BIGINT AS html_tables, 0::BIGINT AS simple_tables, 0::BIGINT AS complex_tables, count(*) FILTER (WHERE starts_with(trim(content), '|') AND ends_with(trim(content), '|')) AS markdown_lines,
  count(*) FILTER (WHERE {' OR '.join(f"contains(lower(content), '{t}')" for t in P.DIAGRAMS)}) AS diagrams, sha256(string_agg(content, chr(10) ORDER BY page)) AS digest FROM s GROUP BY doc_id""")
def page_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quality_report(_with_status(spark, sf_dir), "doc_id", "content", "status")


@query(f"""WITH {_P}, d AS (SELECT doc_id, string_agg('<!-- PAGE ' || page || ' -->' || chr(10) || content, chr(10) || chr(10) ORDER BY page) AS t, count(*)::INT AS n FROM p GROUP BY 1)
SELECT doc_id, n AS page_markers, len(list_filter(string_split(t, chr(10)), lambda x: starts_with(trim(x), '|') AND ends_with(trim(x), '|')))::INT AS table_lines, sha256(t) AS digest FROM d""")
def stitched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined behind their markers, and what is counted in the whole."""
    whole = P.stitched(_pages(spark, sf_dir), "doc_id", "page", "content")
    return whole.select("doc_id", P.extraction_counts(F.col("content")).alias("c")).select("doc_id", "c.*")


@query(f"WITH {_P} SELECT doc_id, page, md5(regexp_replace(content, '\\n+$', '')) AS digest FROM p")
def pages_split_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stitched documents, cut at their markers: the pages as they were."""
    whole = P.stitched(_pages(spark, sf_dir), "doc_id", "page", "content")
    return P.split_pages(whole, "doc_id", "content").select("doc_id", "page", F.md5("content").alias("digest"))


@query("SELECT doc_id, array_to_string([doc_id % 7, doc_id % 7 + 1], ',') AS page_numbers FROM documents")
def chunk_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 7
    text = F.concat(F.lit("<!-- PAGE "), n.cast("string"), F.lit(" -->"), F.coalesce("text", F.lit("")), F.lit("<!--  page 9 --><!-- PAGE "), (n + 1).cast("string"), F.lit(" -->"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(etl.page_numbers(text), ",").alias("page_numbers"))


@query(f"""WITH {_P}, b AS (SELECT doc_id, page, floor((row_number() OVER o - 1) / 5)::INT AS n, floor(coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000)::INT AS k FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY page))
SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id ORDER BY n, k)::INT AS batch FROM b""")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.batches(_pages(spark, sf_dir), "doc_id", "page", F.length("content"), 5, 1000).select("doc_id", "page", "batch")


@query(f"""WITH {_P}, k AS (SELECT doc_id, page, sha256(CAST(doc_id AS VARCHAR) || '|' || page || '|' || sha256(content) || '|m|1') AS key, page % 3 = 0 AS hit FROM p) SELECT * FROM k""")
def page_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page of a document is in the cache."""
    keyed = _pages(spark, sf_dir).withColumn("key", P.page_key(F.col("doc_id"), F.col("page"), F.col("content"), "m", "1"))
    manifest = keyed.where("page % 3 = 0").select("key", F.col("content").alias("text")).distinct()
    return P.cached(keyed, manifest).select("doc_id", "page", "key", "hit")
