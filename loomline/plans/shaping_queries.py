"""Shaping of ranked chunks: documents stand for chunks, their source for the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions import answers
from ..operators import shaping as S
from .registry import query, table

_TERMS = ["the", "with", "thereof-x", "2024", "of the"]
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/-][a-z0-9]+)*')"
_N = "len(list_filter(w, lambda x: x = '{}'))"
_HIT = "CASE WHEN {n} > 0 THEN least(1.0, 0.7::DOUBLE + 0.15::DOUBLE * least({n} - 1, 2)) ELSE 0 END"
_PHRASE = r"(len(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), 'of the')) - 1)"
# weights of _TERMS: 1.0, 1.0, 1 + .15 + .10, 1 + .35, 1 + .35
_LEX = (
    "round((" + " + ".join(f"{w}::DOUBLE * {_HIT.format(n=_N.format(t))}" for t, w in (("the", 1.0), ("with", 1.0), ("thereof-x", 1.25), ("2024", 1.35)))
    + f" + 1.35::DOUBLE * CASE WHEN {_PHRASE} > 0 THEN least(1.0, 0.8::DOUBLE + 0.1::DOUBLE * ({_PHRASE} - 1)) WHEN list_contains(w, 'of') AND list_contains(w, 'the') THEN 0.6 ELSE 0 END) / 5.95::DOUBLE, 6)"
)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ranked lists of questions: fifty ids are the candidates of one, the longest first."""
    d = table(spark, sf_dir, "documents").withColumn("q", F.floor(F.col("doc_id") / 50))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n_chars"), "doc_id"))).withColumn("score", F.col("n_chars").cast("double"))


_RANKED = "r AS (SELECT *, doc_id // 50 AS q, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY n_chars DESC, doc_id)::INT AS rank, n_chars::DOUBLE AS score FROM documents)"


@query(f"SELECT doc_id, {_LEX} AS lexical FROM (SELECT doc_id, text, {_TOK} AS w FROM documents)")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.lexical_score(F.col("text"), _TERMS).alias("lexical"))


@query(f"""WITH {_RANKED}, b AS (SELECT q, doc_id, rank, CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS base, {_LEX} AS lexical FROM (SELECT *, {_TOK} AS w FROM r) WINDOW p AS (PARTITION BY q)),
f AS (SELECT *, round(0.8::DOUBLE * base + 0.2::DOUBLE * lexical, 6) AS final, max(lexical) OVER (PARTITION BY q) > 0 AS found FROM b)
SELECT doc_id, rank, final, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN found THEN -final ELSE 0 END, CASE WHEN found THEN -lexical ELSE 0 END, rank)::INT AS new_rank FROM f""")
def lexical_boost_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lexical_boost(_ranked(spark, sf_dir), _TERMS, "text", "rank", ["q"]).select("doc_id", "rank", "final", "new_rank")


@query(f"""WITH {_RANKED}, s AS (SELECT doc_id, q, CASE WHEN rank % 7 = 0 THEN NULL ELSE score END AS score, rank FROM r)
SELECT doc_id, round(CASE WHEN max(score) OVER p IS NULL THEN CASE WHEN count(*) OVER p > 1 THEN 1 - (rank - 1) / (count(*) OVER p - 1)::DOUBLE ELSE 1 END WHEN score IS NULL THEN 0 WHEN max(score) OVER p = min(score) OVER p THEN 1
  ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END, 6) AS base FROM s WINDOW p AS (PARTITION BY q)""")
def normalized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).withColumn("score", F.when(F.col("rank") % 7 != 0, F.col("score")))
    return S.normalized(rows, "score", "rank", ["q"]).select("doc_id", F.round("base", 6).alias("base"))


@query("SELECT doc_id, round(CASE doc_id % 4 WHEN 0 THEN n_chars / 10.0::DOUBLE WHEN 1 THEN 0.25 WHEN 2 THEN 1 / (1 + greatest(doc_id - 500, 0)::DOUBLE) END, 6) AS base FROM documents")
def first_base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    rows = d.select("doc_id", F.when(m == 0, F.col("n_chars") / 10).alias("rerank_score"), F.when(m <= 1, 0.25).alias("similarity"), F.when(m <= 2, F.col("doc_id") - 500).alias("distance"))
    return rows.select("doc_id", F.round(S.base_score(rows.columns), 6).alias("base"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 's3/' || source WHEN doc_id % 5 = 1 THEN 'in/' || source || '.pdf' WHEN doc_id % 5 = 2 THEN 'title ' || lang WHEN doc_id % 5 = 3 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS key FROM documents""")
def chunk_document_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    path = F.when(m == 1, F.concat(F.lit(" in/"), "source", F.lit(".pdf"))).when(m == 2, "in/test_doc7.pdf").when(m == 3, "Processed.md").otherwise("unknown_source")
    key = S.document_key(F.when(m == 0, F.concat(F.lit("s3/"), "source")), path, F.when(m == 2, F.concat(F.lit("title "), "lang")), F.when(m == 3, F.col("doc_id").cast("string")))
    return d.select("doc_id", key.alias("key"))


@query(f"WITH {_RANKED} SELECT doc_id, source, rank FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY q, source ORDER BY rank) <= CASE WHEN source = 'src1' THEN 5 ELSE 3 END) QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank) <= 20")
def per_document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cap_per_document(_ranked(spark, sf_dir), "source", "rank", 3, 20, ["q"], F.when(F.col("source") == "src1", 5)).select("doc_id", "source", "rank")


@query(f"WITH {_RANKED} SELECT doc_id, rank FROM r WHERE CASE WHEN q % 2 = 0 THEN rank <= 3 ELSE lang IS NOT NULL AND rank IN (SELECT x.rank FROM r x WHERE x.q = r.q AND x.lang = r.lang ORDER BY x.rank LIMIT 2) END")
def single_document_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of one document get three chunks of it, the others two of each."""
    rows = _ranked(spark, sf_dir).withColumn("doc", F.when(F.col("q") % 2 == 0, "one").otherwise(F.col("lang"))).where("doc IS NOT NULL")
    return S.cap_per_document(rows, "doc", "rank", 2, 50, ["q"], expand=True).select("doc_id", "rank")


@query(f"WITH {_RANKED}, t AS (SELECT q, doc_id, rank, len({_TOK}) AS tokens FROM r) SELECT doc_id, rank, running FROM (SELECT doc_id, rank, CAST(sum(tokens) OVER (PARTITION BY q ORDER BY rank) AS BIGINT) AS running FROM t) WHERE running <= 8000")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).withColumn("tokens", F.size(T.tokens(F.col("text"))))
    return S.within_budget(rows, "tokens", [F.col("rank")], 8_000, ["q"]).select("doc_id", "rank", "running")


@query(f"WITH {_RANKED}, s AS (SELECT * , CASE WHEN doc_id % 3 > 0 THEN n_chars % 100 / 100.0::DOUBLE END AS rerank FROM r) SELECT doc_id, rank FROM s WHERE coalesce(rerank, 100) >= 0.5")
def rerank_score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).withColumn("rerank", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") % 100 / 100))
    return S.above_floor(rows, "rerank", 0.5).select("doc_id", "rank")


@query(f"""WITH {_RANKED}, s AS (SELECT q, doc_id, rank, source, (doc_id % 3 = 0)::INT AS e, CASE doc_id % 11 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END * (q % 2) AS f, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS d, n_chars % 13 / 13.0::DOUBLE AS m FROM r),
g AS (SELECT *, max((f >= 1)::INT) OVER (PARTITION BY q, source) AS focused, max((f >= 1)::INT) OVER (PARTITION BY q) AS whole FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY q ORDER BY d DESC, CASE WHEN whole = 1 THEN focused ELSE 0 END DESC, e DESC, f DESC, CASE WHEN greatest(d, focused, e, f) > 0 THEN m ELSE 0 END DESC, rank)::INT AS support_rank FROM g""")
def support_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m = _ranked(spark, sf_dir), F.col("doc_id") % 11
    signals = {"exact_phrase_match": (F.col("doc_id") % 3 == 0).cast("double"), "precise_focus_overlap": F.when(m == 0, 1.0).when(m == 1, 0.5) * (F.col("q") % 2), "duration_answer_match": F.when(F.col("doc_id") % 7 == 0, 1.0), "merge_score": F.col("n_chars") % 13 / 13}
    return S.support_order(rows.withColumns(signals), ["q"], "rank", "source").select("doc_id", "support_rank")


@query(f"""WITH {_RANKED}, a AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY doc_id)::INT AS other FROM r WHERE n_chars > 300)
SELECT r.doc_id, r.rank AS merge_rank, a.other AS lexical_rank, CASE WHEN a.other <= 5 THEN a.other END AS token_rank, CASE WHEN a.other <= 5 THEN 'DC' || a.other END AS id FROM r LEFT JOIN a ON r.doc_id = a.doc_id""")
def stage_rank_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _ranked(spark, sf_dir)
    second = first.where("n_chars > 300").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("doc_id")))
    third = second.where("rank <= 5")
    traced = S.stage_ranks([("merge_rank", first), ("lexical_rank", second), ("token_rank", third)], ["q"], "doc_id")
    return traced.join(S.numbered(third, ["q"], "rank").select("doc_id", "id"), "doc_id", "left").select("doc_id", "merge_rank", "lexical_rank", "token_rank", "id")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in nine ranked groups for each question of 400 ids; later groups are short."""
    part = table(spark, sf_dir, "part").withColumn("q", F.floor(F.col("p_partkey") / 400)).withColumn("g", (F.col("p_partkey") % 9 + 1).cast("int"))
    part = part.withColumn("g", F.when(F.col("p_size") > 40, 1).when(F.col("p_size") < 4, 9).otherwise(F.col("g")))
    return part.select("q", "g", "p_partkey", F.row_number().over(Window.partitionBy("q", "g").orderBy("p_partkey")).alias("item"))


_GROUPS = "p AS (SELECT *, row_number() OVER (PARTITION BY q, g ORDER BY p_partkey)::INT AS item FROM (SELECT p_partkey // 400 AS q, CASE WHEN p_size > 40 THEN 1 WHEN p_size < 4 THEN 9 ELSE p_partkey % 9 + 1 END::INT AS g, p_partkey FROM part)), z AS (SELECT q, max(g) AS m FROM p GROUP BY q)"
_QUOTA = "(CASE WHEN m > 1 THEN round_even(60 - (g - 1) / (m - 1)::DOUBLE * 40, 0) ELSE 60 END)::INT"


@query(f"WITH {_GROUPS} SELECT g, p_partkey, item, {_QUOTA} AS quota FROM p JOIN z USING (q) WHERE item <= {_QUOTA}")
def weighted_polling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.polled(_groups(spark, sf_dir), "g", "item", 60, 20, ["q"], rounds=1).select("g", "p_partkey", "item", "quota")


@query(f"""WITH {_GROUPS}, s AS (SELECT q, g, count(*) AS size, any_value({_QUOTA}) AS quota FROM p JOIN z USING (q) GROUP BY q, g),
l AS (SELECT *, sum(greatest(quota - size, 0)) OVER (PARTITION BY q) AS unused, greatest(size - quota, 0) AS spare FROM s),
t AS (SELECT q, g, least(quota, size) + greatest(least(spare, unused - coalesce(sum(spare) OVER (PARTITION BY q ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS take FROM l)
SELECT p.g, p_partkey, item FROM p JOIN t ON p.q = t.q AND p.g = t.g WHERE item <= take""")
def weighted_polling_both_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.polled(_groups(spark, sf_dir), "g", "item", 60, 20, ["q"]).select("g", "p_partkey", "item")


@query(f"""WITH {_RANKED}, c AS (SELECT q, source, count(*) AS n, min(rank) AS first, arg_min(CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END, rank) AS excerpt FROM r GROUP BY q, source)
SELECT q, row_number() OVER (PARTITION BY q ORDER BY n DESC, first)::INT AS reference_id, source, n, excerpt FROM c QUALIFY reference_id <= 10""")
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.references(_ranked(spark, sf_dir), "source", "rank", "text", ["q"])


_STOP = "(" + ", ".join(f"'{w}'" for w in S.RERANK_STOPWORDS) + ")"


@query(f"""WITH q AS (SELECT ['42', 'b2b', 'thing', 'this'] AS q), w AS (SELECT doc_id, text, list_distinct(list_filter({_TOK}, lambda t: length(t) > 2 AND t NOT IN {_STOP})) AS w FROM documents),
s AS (SELECT doc_id, list_intersect(['b2b', 'thing', 'this'], w) AS shared, len(w) AS n, contains(lower(text), 'of the') AS phrase FROM w),
r AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE round(len(shared) / 3::DOUBLE + 0.35::DOUBLE * len(shared) / n + 0.25::DOUBLE * phrase::INT + 0.15::DOUBLE * list_contains(shared, 'b2b')::INT, 6) END AS score FROM s)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM r ORDER BY rank LIMIT 20""")
def local_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.local_rerank(table(spark, sf_dir, "documents"), "What is this thing of b2b? 42", "text", "doc_id", 20, ["of the"])


@query("SELECT l_orderkey AS doc, round(avg(l_extendedprice), 6) AS score FROM lineitem GROUP BY 1")
def rerank_chunk_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_scores(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc"), "doc", "l_extendedprice", F.col("l_linenumber"), "mean")


@query("SELECT l_orderkey AS doc, max(l_extendedprice) AS score FROM lineitem GROUP BY 1")
def rerank_chunk_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_scores(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc"), "doc", "l_extendedprice", F.col("l_linenumber"))


@query("SELECT l_orderkey AS doc, arg_min(l_extendedprice, (l_linenumber, l_extendedprice)) AS score FROM lineitem GROUP BY 1")
def rerank_chunk_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_scores(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc"), "doc", "l_extendedprice", F.struct("l_linenumber", "l_extendedprice"), "first")


@query("""WITH p AS (SELECT 0 AS n, 'vector' AS s, l_partkey AS id, l_quantity * 0.5::DOUBLE AS w FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 1, 'entity', l_partkey, l_quantity * 0.3::DOUBLE FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT 2, 'relation', l_partkey, l_quantity * 0.2::DOUBLE FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')), o AS (SELECT id, n, s, max(w) AS w, count(*) AS c FROM p GROUP BY 1, 2, 3)
SELECT id, string_agg(s, '+' ORDER BY n) AS sources, round(sum(w), 6) AS score, CAST(sum(c) AS BIGINT) AS occurrences FROM o GROUP BY id""")
def merge_chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_quantity", "l_returnflag")
    parts = [("vector", li.where("l_returnflag = 'A'")), ("entity", li.where("l_returnflag = 'N'")), ("relation", li.where("l_returnflag NOT IN ('A', 'N')"))]
    return S.merge_sources(parts, "id", "l_quantity", {"vector": 0.5, "entity": 0.3, "relation": 0.2})


@query("SELECT DISTINCT c.l_orderkey, c.l_linenumber, c.l_partkey FROM lineitem c JOIN lineitem h ON c.l_orderkey = h.l_orderkey AND c.l_linenumber BETWEEN h.l_linenumber - 1 AND h.l_linenumber + 1 AND h.l_quantity = 50 AND h.l_discount > 0.08")
def sibling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return S.siblings(li.where("l_quantity = 50 AND l_discount > 0.08"), li, "l_orderkey", "l_linenumber", 1).select("l_orderkey", "l_linenumber", "l_partkey").distinct()


@query()
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy, so without SQL: held against a plain version in the tests. Ten of each question's candidates."""
    docs = _ranked(spark, sf_dir).select("q", "doc_id", "text", (1.0 / F.col("rank")).alias("relevance"))
    return S.mmr(docs, "q", "doc_id", "text", "relevance")


@query("""WITH k AS (SELECT vec_id // 100 AS q, vec_id % 40 AS id, label, embedding[1]::DOUBLE AS score, row_number() OVER (PARTITION BY vec_id // 100, label ORDER BY vec_id) AS place FROM embeddings),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY place, label) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place, label) AS t FROM o)
SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN t <= 15 THEN t ELSE 30 END, CASE WHEN t > 15 THEN score END DESC NULLS LAST, id)::INT AS rank FROM t QUALIFY rank <= 30""")
def interleaved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several keywords (labels) in turn for each question (a hundred vectors), then by score."""
    k = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("q"), "vec_id", (F.col("vec_id") % 40).alias("id"), "label", F.col("embedding")[0].cast("double").alias("score"))
    k = k.withColumn("place", F.row_number().over(Window.partitionBy("q", "label").orderBy("vec_id")))
    return S.interleaved(k, "id", "label", "place", "score", 30, ["q"])


@query("""SELECT l_orderkey, l_linenumber, round(0.34::DOUBLE * least(l_quantity / 40, 1) + 0.20::DOUBLE * (l_linenumber = 1)::INT + 0.14::DOUBLE * l_discount + 0.07::DOUBLE * CASE WHEN l_linenumber > 2 THEN l_tax ELSE 0 END + 0.04::DOUBLE / l_linenumber, 6) AS score FROM lineitem""")
def merged_feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    features = {"retrieval": F.col("l_quantity") / 40, "heading": n == 1, "body": F.col("l_discount"), "source_count": F.when(n > 2, F.col("l_tax")), "order": 1 / n}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.merge_score(features).alias("score"))


@query("""WITH u AS (SELECT l_orderkey // 100 AS q, l_partkey, l_discount AS score FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT l_orderkey // 100, l_partkey, l_tax FROM lineitem WHERE l_linenumber > 2),
d AS (SELECT l_partkey, count(*) AS degree FROM lineitem GROUP BY 1), b AS (SELECT q, l_partkey, max(score) AS score FROM u GROUP BY 1, 2), s AS (SELECT q, l_partkey, score, round(degree / max(degree) OVER (PARTITION BY q)::DOUBLE, 6) AS degree_share FROM b JOIN d USING (l_partkey))
SELECT q, l_partkey, score, degree_share, row_number() OVER (PARTITION BY q ORDER BY score DESC, degree_share DESC, l_partkey)::INT AS rank FROM s QUALIFY rank <= 10""")
def score_aware_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of two lists for each question (a hundred orders)."""
    li = table(spark, sf_dir, "lineitem").withColumn("q", F.floor(F.col("l_orderkey") / 100))
    lists = [li.where("l_linenumber <= 2").withColumn("score", F.col("l_discount")), li.where("l_linenumber > 2").withColumn("score", F.col("l_tax"))]
    return S.merge_ranked(lists, "l_partkey", ["q"], li.groupBy("l_partkey").agg(F.count("*").alias("degree")), 10)


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 3 = 1")
def entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name in a field or in one of its other names, whatever the case and signs; not inside another word."""
    m = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(m == 0, F.concat("p_name", F.lit(" (ACME-Corp.)"))).otherwise("pacme corporation").alias("name"), F.when(m == 1, F.array(F.lit("other"), F.lit("acme  corp"))).alias("names"))
    return S.matching(rows, ["name", "names"], "Acme Corp").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 25 OR p_partkey % 4 = 0")
def entity_confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") / 50).alias("score"), F.when(F.col("p_partkey") % 4 == 0, "graph").otherwise("vector").alias("source"))
    return S.confident(rows, "score", "source", 0.5).select("p_partkey")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'grey foxes' WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN 'other thing here|grey foxes' END AS kept FROM documents WHERE doc_id % 4 < 3")
def references_supporting_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    # in every fourth list nothing supports the answer, so that it stays whole
    answer = F.concat(F.when(m == 2, "nothing of this ").otherwise("the grey foxes jumped over "), F.col("doc_id").cast("string"))
    content = F.when(m == 0, F.array(F.lit("grey foxes"), F.lit("other thing here"))).when(m == 2, F.array(F.lit("other thing here"), F.lit("grey foxes"))).when(m == 3, F.array(F.lit("unlike words")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("the grey foxes jumped over "), F.floor(F.col("doc_id") / 4).cast("string"), F.when(m == 2, " once").otherwise("")).alias("answer"), content.alias("content"))
    rows = rows.withColumn("answer", F.when(m == 2, answer).otherwise(F.col("answer")))
    return S.supporting(rows, "answer", "content").select("doc_id", F.array_join("content", "|").alias("kept"))


@query("""SELECT l_suppkey AS q, round(sum((l_linenumber > 4)::INT) / count(*)::DOUBLE, 6) AS density, round(sum((l_discount > 0.04)::INT) / count(*)::DOUBLE, 6) AS coverage, round(sum((l_linenumber > 4)::INT) / count(*)::DOUBLE, 6) >= 0.3 AND round(sum((l_discount > 0.04)::INT) / count(*)::DOUBLE, 6) >= 0.5 AS passes FROM lineitem GROUP BY 1""")
def connectivity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("q"), F.lit(1).alias("entities"), (F.col("l_linenumber") > 4).cast("int").alias("relations"), (F.col("l_discount") > 0.04).cast("int").alias("covered"))
    return S.gated(rows, ["q"], "entities", "relations", "covered")


@query("""WITH i AS (SELECT l_suppkey AS q, p_brand AS file_path, CASE WHEN l_linenumber % 2 = 0 THEN 'entity' ELSE 'relation' END AS k FROM lineitem JOIN part ON p_partkey = l_partkey), f AS (SELECT q, file_path, count(*) AS n, string_agg(DISTINCT k, '+' ORDER BY k) AS kinds FROM i GROUP BY 1, 2),
c AS (SELECT p_brand AS file_path, list(p_name ORDER BY p_partkey) AS contents FROM part WHERE p_size > 25 GROUP BY 1)
SELECT q, row_number() OVER (PARTITION BY q ORDER BY n DESC, file_path)::INT AS reference_id, file_path, kinds, n, md5(array_to_string(contents, '|')) AS digest FROM f LEFT JOIN c USING (file_path)""")
def graph_reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as the files of entities and relations of each supplier, parts as their chunks."""
    p = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file_path")), "l_partkey").withColumn("q", F.col("l_suppkey"))
    chunks = p.where("p_size > 25").select(F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("position"), F.col("p_name").alias("content"))
    out = S.graph_references(li.where("l_linenumber % 2 = 0"), li.where("l_linenumber % 2 = 1"), chunks, ["q"], lambda contents: F.md5(F.array_join(contents, "|")))
    return out.withColumnRenamed("contents", "digest")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY lower(n_name), n_nationkey)::INT AS place FROM nation")
def names_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of names in order, accents and case apart."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" "), F.translate("n_name", "AEIOU", "ÀÉÏÔÜ")).alias("name"))
    return n.select("n_nationkey", F.row_number().over(Window.orderBy(S.sort_key(F.col("name")), "n_nationkey")).alias("place"))


_ASKS = "CASE doc_id % 3 WHEN 0 THEN 'How long is the LEAD time of a shipment from ' || source || '?' WHEN 1 THEN 'Which  impact had the submission of ' || source ELSE 'who wrote ' || source END"
_SAYS = "text || ' It took ' || n_chars || ' days by ship; results of a review.'"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 + 0.5::DOUBLE + CASE WHEN contains(lower(text), 'packag') THEN 0.25 ELSE 0 END + CASE WHEN contains(lower({_SAYS}), 'lead') THEN 0.25 ELSE 0 END ELSE 0 END AS duration,
  CASE WHEN doc_id % 3 = 1 THEN 1.25::DOUBLE + CASE WHEN regexp_matches(lower({_SAYS}), '\b(?:wrong|questioned|re-?label|ndc)\b') THEN 0.25 ELSE 0 END ELSE 0 END AS impact FROM documents WHERE source IS NOT NULL AND text IS NOT NULL""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that tell a duration and a result, asked for a duration, an impact or neither."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL AND text IS NOT NULL").select("doc_id", F.expr(_ASKS).alias("q"), F.expr(_SAYS).alias("t"))
    return rows.select("doc_id", answers.answer_match(F.col("q"), F.col("t"), answers.DURATION).alias("duration"), answers.answer_match(F.col("q"), F.col("t"), answers.IMPACT).alias("impact"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part")
def names_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names in the order of a collation, numbered without one window over them."""
    return S.ordered_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "place")
