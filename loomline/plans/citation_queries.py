"""Citations: documents are answers, benchmark items and sources their references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations as C
from .registry import query, table

_STOP = "(" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + ")"
_CUT = r"string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_S = f"s AS (SELECT doc_id, (unnest(range(1, len(l) + 1)) - 1)::INT AS position, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform({_CUT}, lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents))"
_META = " OR ".join("starts_with(lower(trim(sentence, ' ')), '{}')".format(p.replace("'", "''")) for p in C.META)
_FACT = rf"(length(trim(sentence, ' ')) >= 20 AND NOT ends_with(trim(sentence, ' '), '?') AND NOT regexp_matches(trim(sentence, ' '), '^[#\-*•>]') AND NOT ({_META}))"
_WORDS = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z][a-z0-9]+$') AND w NOT IN " + _STOP + "))"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_S} SELECT doc_id, position, md5(sentence) AS digest, {_FACT} AS factual, regexp_matches(sentence, '\\[\\d+\\]') AS cited FROM s")
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentence")
    return _sentences(spark, sf_dir).select("doc_id", "position", F.md5("sentence").alias("digest"), C.is_factual(s).alias("factual"), C.has_citation(s).alias("cited"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as references; an answer may cite those whose number mod 8 is its own."""
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 8).alias("q"), F.col("item_id").alias("reference_id"), F.col("text").alias("content"))
    return b


@query(f"""WITH {_S}, x AS (SELECT *, doc_id % 8 AS q, {_WORDS.format('sentence')} AS w, {_FACT} AS fact, regexp_matches(sentence, '\\[\\d+\\]') AS c FROM s), a AS (SELECT *, avg(CASE WHEN fact THEN c::INT::DOUBLE END) OVER (PARTITION BY doc_id) AS share FROM x),
r AS (SELECT item_id % 8 AS q, item_id AS reference_id, {_WORDS.format('text')} AS rw FROM benchmark), f AS (SELECT q, min(reference_id) AS first FROM r GROUP BY q),
xw AS (SELECT doc_id, position, q, unnest(w) AS word FROM x), rr AS (SELECT q, reference_id, unnest(rw) AS word FROM r), h AS (SELECT doc_id, position, reference_id, count(*) AS n FROM xw JOIN rr ON xw.q = rr.q AND xw.word = rr.word GROUP BY 1, 2, 3),
b AS (SELECT doc_id, position, arg_min(reference_id, (-n, reference_id)) AS best FROM h GROUP BY 1, 2), z AS (SELECT a.*, CASE WHEN len(w) = 0 THEN first ELSE best END AS reference_id FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.position = b.position LEFT JOIN f ON a.q = f.q)
SELECT doc_id, position, reference_id, md5(CASE WHEN fact AND NOT c AND share < 0.5 AND reference_id IS NOT NULL THEN CASE WHEN regexp_matches(rtrim(sentence, ' '), '[.!?]$') THEN substring(rtrim(sentence, ' '), 1, length(rtrim(sentence, ' ')) - 1) || ' [' || reference_id || ']' || right(rtrim(sentence, ' '), 1)
  ELSE rtrim(sentence, ' ') || ' [' || reference_id || ']' END ELSE sentence END) AS digest FROM z""")
def citations_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without a citation get their best reference; an answer's references are the benchmark items of its number mod 8."""
    rows = _sentences(spark, sf_dir).withColumn("q", F.col("doc_id") % 8)
    fixed = C.cited(rows, _references(spark, sf_dir), ["doc_id", "position"], "sentence", "q", ["content"], answer="doc_id")
    return fixed.select("doc_id", "position", "reference_id", F.md5("fixed").alias("digest"))


_TOK = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$')))"


@query(f"""WITH p AS (SELECT a.vec_id AS s, b.vec_id AS c, a.label AS reference, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cos, x.text AS st, y.text AS ct FROM embeddings a JOIN embeddings b ON b.vec_id // 20 = a.vec_id // 20
  JOIN documents x ON x.doc_id = a.vec_id JOIN documents y ON y.doc_id = b.vec_id), f AS (SELECT s, c % 3 AS reference_id, round(0.7::DOUBLE * cos + 0.3::DOUBLE * CASE WHEN len({_TOK.format('st')}) > 0 THEN len(list_intersect({_TOK.format('st')}, {_TOK.format('ct')}))::DOUBLE / len({_TOK.format('st')}) ELSE 0 END, 6) AS similarity FROM p WHERE cos >= 0.1),
b AS (SELECT s, reference_id, max(similarity) AS similarity FROM f WHERE similarity >= 0.1 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY s ORDER BY similarity DESC, reference_id)::INT AS rank FROM b QUALIFY rank <= 2""")
def blended_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with a text against the twenty of its block: cosine and word overlap together."""
    e, d = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), C.overlap_words(F.col("text")).alias("text"))
    rows = e.join(d, "vec_id").withColumn("block", F.floor(F.col("vec_id") / 20))
    pairs = rows.select("block", F.col("vec_id").alias("s"), F.col("embedding").alias("v"), F.col("text").alias("st")).join(rows.select("block", (F.col("vec_id") % 3).alias("reference_id"), F.col("embedding").alias("w"), F.col("text").alias("ct")), "block")
    return C.supported(pairs, ["s"], "v", "w", "st", "ct", "reference_id", 0.1, 2)


@query(f"""WITH {_S}, m AS (SELECT doc_id, position, CASE position % 3 WHEN 0 THEN '1,2' WHEN 1 THEN '3' END AS refs FROM s) SELECT doc_id, md5(string_agg(sentence || coalesce('[' || refs || ']', ''), ' ' ORDER BY s.position)) AS digest, count(refs) AS n_citations FROM s JOIN m USING (doc_id, position) GROUP BY doc_id""")
def marked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sentences(spark, sf_dir)
    support = s.select("doc_id", "position", F.explode(F.when(F.col("position") % 3 == 0, F.array(F.lit(2), F.lit(1))).when(F.col("position") % 3 == 1, F.array(F.lit(3)))).alias("reference_id"))
    return C.marked_answers(s, support, "doc_id").select("doc_id", F.md5("answer").alias("digest"), "n_citations")


@query("""WITH r AS (SELECT source, row_number() OVER (ORDER BY source)::INT AS reference_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
f AS (SELECT reference_id, arg_min(text, doc_id) FILTER (WHERE text IS NOT NULL) AS c FROM documents JOIN r USING (source) GROUP BY 1)
SELECT reference_id, '[' || reference_id || '] "' || (CASE WHEN length(source) > 0 THEN upper(source[1]) || lower(source[2:]) ELSE '' END) || ' Notes". "' || CASE WHEN length(c) > 150 THEN substring(c, 1, 150) || '...' ELSE c END || '"' AS footnote FROM r JOIN f USING (reference_id) WHERE reference_id % 2 = 1""")
def reference_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference a source, every other one used."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    paths = d.select("source").distinct().withColumn("reference_id", F.row_number().over(Window.orderBy("source")))
    refs = paths.select("reference_id", F.concat(F.lit("in/"), "source", F.lit("_notes.pdf")).alias("file_path"))
    chunks = C.referenced_chunks(d.select(F.concat(F.lit("in/"), "source", F.lit("_notes.pdf")).alias("file_path"), F.col("text").alias("content"), "doc_id", F.lit(None).cast("string").alias("chunk_id")), refs, "file_path")
    return C.footnotes(refs, chunks.where("content IS NOT NULL"), refs.where("reference_id % 2 = 1"), "doc_id")


@query(r"""WITH t AS (SELECT doc_id, substring(regexp_replace(coalesce(text, ''), '[*_\[\]"#\s]+', ' ', 'g'), 1, 60) AS x FROM documents) SELECT doc_id, trim(x || ' [1] and [2].', ' ') AS markers, trim(x, ' ') AS without, x || chr(10) || '## References' || chr(10) || '- [1] A.pdf' || chr(10) || '- [2] B.pdf' || chr(10) AS once FROM t""")
def answers_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emphasised and repeated markers, and lists of references inside answers."""
    x = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r'[*_\[\]"#\s]+', " "), 1, 60)
    listed = F.concat(x, F.lit("\n## References\n- [1] A.pdf\n- [2] B.pdf\n- [1] A.pdf\n"))
    marked = F.trim(F.concat(x, F.lit(" **[1]** [1] [1] and _[2]_.")))
    return table(spark, sf_dir, "documents").select("doc_id", C.plain_markers(marked).alias("markers"), C.without_references(listed).alias("without"), C.references_once(listed).alias("once"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '["\s]+', ' ', 'g') AS x FROM documents), q AS (SELECT doc_id, x, trim(substring(x, 20, 40), ' ') AS q FROM t WHERE length(x) > 80)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'It says "' || q || '" and "not so at all here" (ZZQ).' ELSE 'none' END AS said, CASE WHEN doc_id % 2 = 0 THEN 'It says "' || q || '" and not so at all here.' ELSE 'none' END AS kept FROM q WHERE regexp_matches(q, '^[A-Za-z0-9].*[A-Za-z0-9]$')""")
def unsupported_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and acronyms that the source has stay; the others lose their marks, or go."""
    x = F.regexp_replace(F.coalesce("text", F.lit("")), r'["\s]+', " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).where("length(x) > 80").withColumn("q", F.trim(F.substring("x", 20, 40))).where(F.col("q").rlike("^[A-Za-z0-9].*[A-Za-z0-9]$"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('It says "'), "q", F.lit('" and "not so at all here" (ZZQ).'))).otherwise("none")
    rows = rows.withColumn("said", said)
    return rows.select("doc_id", "said", C.unsupported_acronyms_removed(C.unsupported_quotes_removed(F.col("said"), F.col("x")), F.col("x")).alias("kept"))
