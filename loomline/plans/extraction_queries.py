"""Documents put together from extracted pages: their lines stand for pages, with numbers and notices below as a scan has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import pages as P
from .registry import query, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a page. By doc_id + page, a fifth of the pages is missing, a thirteenth empty, an eleventh cut short, and a seventh has text of its own."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n", -1).alias("l")).where("l IS NOT NULL")
    pages = lines.select("doc_id", "source", F.size("l").alias("n"), F.posexplode("l").alias("at", "line")).withColumn("page", F.col("at") + 1)
    k = F.col("doc_id") + F.col("page")
    foot = F.concat(F.lit("\nPage "), F.col("page").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    notice = F.when(F.col("page") % 2 == 0, F.concat(F.lit("\n- Confidential, "), F.coalesce("source", F.lit("x")), F.lit(" -"))).otherwise("\nConfidential -")
    given = pages.where(k % 5 != 0).select(
        "doc_id", "page", F.when(k % 13 != 0, F.concat("line", foot, notice)).alias("content"), F.when(k % 7 == 0, F.concat_ws(" ", "line", "line")).alias("native"),
        F.when(k % 11 == 0, "vision_truncation").alias("warning"), F.when(k % 11 == 0, "cut").alias("message"),
    )
    return X.records(given, lines.select("doc_id", F.size("l").alias("page_count")))


_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_WORDS = r"regexp_matches({0}, '[\p{{L}}\p{{N}}]')"
_PLAIN = r"regexp_replace(regexp_replace(lower(regexp_replace(trim(x, ' '), '\s+', ' ', 'g')), '^[·•—–\-:;|]+', ''), '[·•—–\-:;|]+$', '')"
_TERMS = " OR ".join(f"contains({_PLAIN}, '{t}')" for t in P.BOILERPLATE)
_KEY = rf"""CASE WHEN regexp_matches(trim(x, ' '), '^([#|>*\-]|```)') OR regexp_matches(trim(x, ' '), '^\d+\.\s+\S') OR {_PLAIN} = '' THEN NULL
  WHEN regexp_matches({_PLAIN}, '^(page\s*)?\d+(\s*(of|/)\s*\d+)?$') OR (length({_PLAIN}) <= 120 AND ({_TERMS})) THEN regexp_replace({_PLAIN}, '\d+', '#', 'g') END"""
_CTE = rf"""p AS (SELECT doc_id, source, len(l) AS n, (unnest(range(1, len(l) + 1)))::INT AS page, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
g AS (SELECT *, doc_id + page AS k FROM p),
b AS (SELECT doc_id, page, n, CASE WHEN k % 5 <> 0 AND k % 13 <> 0 THEN line || chr(10) || 'Page ' || page || ' of ' || n || chr(10) || CASE WHEN page % 2 = 0 THEN '- Confidential, ' || coalesce(source, 'x') || ' -' ELSE 'Confidential -' END ELSE '' END AS raw,
  {_STRIP.format("CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN line || ' ' || line ELSE '' END")} AS nat, k % 5 <> 0 AND k % 11 = 0 AS cut FROM g),
v AS (SELECT *, {_STRIP.format('raw')} AS v FROM b),
u AS (SELECT *, NOT {_WORDS.format('v')} AS blank FROM v),
w AS (SELECT *, {_WORDS.format('nat')} AND (blank OR length(v) < {P.TINY} OR cut) AND (blank OR length(nat) > length(v)) AS own FROM u),
c AS (SELECT *, CASE WHEN own THEN nat ELSE v END AS canonical FROM w),
ls AS (SELECT doc_id, page, n, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT *, string_split(canonical, chr(10)) AS l FROM c)),
ks AS (SELECT *, {_KEY} AS key FROM ls),
often AS (SELECT doc_id, key FROM ks WHERE key IS NOT NULL AND n >= {X.REPEATED_PAGES} GROUP BY doc_id, key, n HAVING count(DISTINCT page) >= greatest({X.REPEATED_PAGES}, ceil(n * {X.REPEATED_SHARE}))),
kept AS (SELECT ks.doc_id, page, string_agg(x, chr(10) ORDER BY i) AS t FROM ks LEFT JOIN often o ON o.doc_id = ks.doc_id AND o.key = ks.key WHERE o.key IS NULL GROUP BY 1, 2),
r AS (SELECT c.*, {_STRIP.format("coalesce(t, '')")} AS retrieval FROM c LEFT JOIN kept USING (doc_id, page)),
s AS (SELECT *, {_WORDS.format('retrieval')} AS used, CASE WHEN NOT {_WORDS.format('canonical')} THEN 'empty' WHEN own THEN 'native_fallback' WHEN cut THEN 'vision_warning'
  WHEN NOT {_WORDS.format('retrieval')} THEN 'boilerplate_only' WHEN length(retrieval) < {P.TINY} THEN 'tiny' ELSE 'ok' END AS status FROM r),
f AS (SELECT *, CASE status WHEN 'empty' THEN 'empty_page' WHEN 'native_fallback' THEN 'native_fallback' WHEN 'vision_warning' THEN 'vision_truncation: cut' WHEN 'boilerplate_only' THEN 'retrieval_omitted_boilerplate_only' WHEN 'tiny' THEN 'low_content_page' ELSE '' END AS note FROM s)"""


@query(f"""WITH {_CTE} SELECT doc_id, page, status, CASE WHEN own AND {_WORDS.format('raw')} THEN 'vision_plus_native' WHEN own THEN 'native' WHEN {_WORDS.format('raw')} THEN 'vision' ELSE 'none' END AS source_method, note AS warnings,
length(raw)::INT AS raw, length(canonical)::INT AS canonical, length(retrieval)::INT AS retrieval, md5(retrieval) AS digest FROM f""")
def extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each page."""
    counts = [F.col(f"char_count_{c}").alias(name) for c, name in (("raw", "raw"), ("normalized", "canonical"), ("retrieval", "retrieval"))]
    return _records(spark, sf_dir).select(
        F.col("doc").alias("doc_id"), "page", "status", "source_method", F.array_join("warnings", ",").alias("warnings"), *counts, F.md5("retrieval_content").alias("digest")
    )


@query(f"""WITH {_CTE}, m AS (SELECT *, '<!-- PAGE ' || page || ' -->' AS mark FROM f) SELECT doc_id,
md5(string_agg(mark || CASE WHEN status <> 'ok' OR NOT used THEN chr(10) || chr(10) || '<!-- PAGE_STATUS: ' || status || ' -->' ELSE '' END || CASE WHEN canonical <> '' THEN chr(10) || chr(10) || canonical ELSE '' END, chr(10) || chr(10) ORDER BY page)) AS canonical,
md5(coalesce(string_agg(mark || chr(10) || chr(10) || retrieval, chr(10) || chr(10) ORDER BY page) FILTER (WHERE used), '')) AS retrieval FROM m GROUP BY doc_id""")
def extraction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical and retrieval text of each document."""
    return X.texts(_records(spark, sf_dir)).select(F.col("doc").alias("doc_id"), F.md5("canonical").alias("canonical"), F.md5("retrieval").alias("retrieval"))


_LISTS = {
    "empty_pages": "status = 'empty'", "tiny_pages": f"length(retrieval) BETWEEN 1 AND {P.TINY - 1}", "boilerplate_only_pages": "status = 'boilerplate_only'", "native_fallback_pages": "own", "dropped_retrieval_pages": "NOT used",
}


@query(f"""WITH {_CTE}, t AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (WHERE used) AS pages_emitted_retrieval, {', '.join(f"coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE {x}), '') AS {c}" for c, x in _LISTS.items())} FROM f GROUP BY 1),
ws AS (SELECT doc_id, 'vision_truncation' AS source FROM f WHERE cut UNION ALL SELECT doc_id, split_part(note, ':', 1) FROM f WHERE note <> '' UNION ALL SELECT DISTINCT doc_id, 'vision_quality' FROM f WHERE NOT used OR cut),
wn AS (SELECT doc_id, string_agg(source || '=' || n, ',' ORDER BY source) AS warnings FROM (SELECT doc_id, source, count(*) AS n FROM ws GROUP BY 1, 2) GROUP BY 1)
SELECT t.*, coalesce(warnings, '') AS warnings FROM t LEFT JOIN wn USING (doc_id)""")
def extraction_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each document."""
    report = X.reports(_records(spark, sf_dir))
    warned = F.array_join(F.transform(F.map_entries("warning_counts"), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return report.select(F.col("doc").alias("doc_id"), "page_count", "pages_emitted_retrieval", *[F.array_join(c, ",").alias(c) for c in _LISTS], warned.alias("warnings"))
