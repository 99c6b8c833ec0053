"""Search over the driver's tables: embeddings stand for chunks and entities, documents for chunks, part names for labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions import vectors as V
from ..operators import search, shaping
from .registry import query, table

_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_V = "CAST(embedding AS DOUBLE[])"
_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _vector0(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


@query(f"""SELECT vec_id, round(1 - list_cosine_similarity({_V}, {_Q}), 6) AS distance, row_number() OVER (ORDER BY round(1 - list_cosine_similarity({_V}, {_Q}), 6), vec_id)::INT AS rank,
  round(1 - round(1 - list_cosine_similarity({_V}, {_Q}), 6), 6) AS score FROM embeddings ORDER BY distance, vec_id LIMIT 10""")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_topk(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 10, "vec_id")


@query(f"""SELECT vec_id, round(list_distance({_V}, {_Q}), 6) AS distance, row_number() OVER (ORDER BY round(list_distance({_V}, {_Q}), 6), vec_id)::INT AS rank FROM embeddings ORDER BY distance, vec_id LIMIT 10""")
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_topk(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 10, "vec_id", metric="l2")


@query(f"""SELECT vec_id, round(-list_inner_product({_V}, {_Q}), 6) AS distance, row_number() OVER (ORDER BY round(-list_inner_product({_V}, {_Q}), 6), vec_id)::INT AS rank FROM embeddings ORDER BY distance, vec_id LIMIT 10""")
def vector_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_topk(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 10, "vec_id", metric="ip")


@query(f"""SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id)::INT AS rank, round(1 - distance, 6) AS score FROM
  (SELECT vec_id, round(1 - list_cosine_similarity({_V}, {_Q}), 6) AS distance FROM embeddings) WHERE distance < 1 - 0.2 ORDER BY distance, vec_id LIMIT 50""")
def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_topk(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 50, "vec_id", threshold=0.2)


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents)
SELECT doc_id, round(n / (n + 1.0), 6) AS text_score, row_number() OVER (ORDER BY round(n / (n + 1.0), 6) DESC, doc_id)::INT AS rank
FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'of')))::DOUBLE AS n FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'of')) ORDER BY text_score DESC, doc_id LIMIT 20""")
def text_search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_topk(table(spark, sf_dir, "documents"), ["the", "of"], 20, "doc_id")


@query(f"""WITH w AS (SELECT doc_id, ' ' || array_to_string({_W}, ' ') || ' ' AS j FROM documents),
n AS (SELECT doc_id, (len(string_split(j, ' of the ')) - 1)::DOUBLE AS n FROM w WHERE contains(j, ' of the '))
SELECT doc_id, round(n / (n + 1.0), 6) AS text_score, row_number() OVER (ORDER BY round(n / (n + 1.0), 6) DESC, doc_id)::INT AS rank FROM n ORDER BY text_score DESC, doc_id LIMIT 20""")
def text_search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_topk(table(spark, sf_dir, "documents"), [], 20, "doc_id", phrases=["of the"])


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), n AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS n FROM w WHERE list_contains(w, 'the') AND NOT list_contains(w, 'of'))
SELECT doc_id, round(n / (n + 1.0), 6) AS text_score, row_number() OVER (ORDER BY round(n / (n + 1.0), 6) DESC, doc_id)::INT AS rank FROM n ORDER BY text_score DESC, doc_id LIMIT 20""")
def text_search_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_topk(table(spark, sf_dir, "documents"), ["the"], 20, "doc_id", excluded=["of"])


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM w),
t AS (SELECT unnest(['the', 'with', 'und']) AS t), tf AS (SELECT doc_id, len(w) AS dl, t, len(list_filter(w, lambda x: x = t)) AS tf FROM w, t),
df AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY t)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS score
FROM tf JOIN df USING (t), stats WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_topk(table(spark, sf_dir, "documents"), ["the", "with", "und"], 20, "doc_id")


def _legs(spark: SparkSession, sf_dir: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    v = search.vector_topk(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), k, "vec_id").withColumnRenamed("vec_id", "doc_id")
    return v, search.text_topk(table(spark, sf_dir, "documents"), ["the", "of"], k, "doc_id")


_LEGS = f"""v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity({_V}, {_Q}), 6), vec_id) AS rank FROM embeddings QUALIFY rank <= 20),
w AS (SELECT doc_id, {_W} AS w FROM documents),
t AS (SELECT doc_id, row_number() OVER (ORDER BY round(n / (n + 1.0), 6) DESC, doc_id) AS rank FROM
  (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'of')))::DOUBLE AS n FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'of')) QUALIFY rank <= 20),
u AS (SELECT 0 AS l, * FROM v UNION ALL SELECT 1, * FROM t),
f AS (SELECT doc_id, round(sum(1.0::DOUBLE / (40 + rank)), 9) AS rrf, min(l * 1000 + rank) AS first FROM u GROUP BY doc_id)"""


@query(f"WITH {_LEGS} SELECT doc_id, rrf, (first // 1000)::INT AS first_list, (first % 1000)::INT AS first_rank FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(list(_legs(spark, sf_dir)), "doc_id")


@query(f"""WITH {_LEGS} SELECT doc_id, rrf, (first // 1000)::INT AS first_list, (first % 1000)::INT AS first_rank, row_number() OVER (ORDER BY rrf DESC, first)::INT AS rank FROM f ORDER BY rank LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(*_legs(spark, sf_dir), "doc_id", 10)


@query(f"""WITH {_LEGS}, one AS (SELECT doc_id, rrf, first FROM (SELECT doc_id, round(sum(1.0::DOUBLE / (40 + rank)), 9) AS rrf, min(l * 1000 + rank) AS first FROM u WHERE l = 1 GROUP BY doc_id))
SELECT doc_id, rrf, 0 AS first_list, (first % 1000)::INT AS first_rank, row_number() OVER (ORDER BY rrf DESC, first)::INT AS rank FROM one ORDER BY rank LIMIT 10""")
def hybrid_search_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector leg failed: the text leg alone."""
    return search.hybrid(None, _legs(spark, sf_dir)[1], "doc_id", 10)


@query(f"""WITH {_LEGS}, linked AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'),
b AS (SELECT f.doc_id, linked.doc_id IS NOT NULL AS boosted, round(CASE WHEN linked.doc_id IS NOT NULL THEN rrf * 1.5 ELSE rrf END, 9) AS rrf FROM f LEFT JOIN linked USING (doc_id))
SELECT doc_id, rrf, boosted, row_number() OVER (ORDER BY rrf DESC, doc_id)::INT AS rank FROM b""")
def entity_boosted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "documents").where("lang = 'en'")
    return search.boosted(search.fuse(list(_legs(spark, sf_dir)), "doc_id").select("doc_id", "rrf"), linked, "doc_id", "rrf")


_TRI = """list_distinct(flatten(list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""
_SIM = "len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"


@query(f"""WITH q AS (SELECT p_name AS q FROM part WHERE p_partkey = 1), t AS (SELECT p_partkey, p_name, {_TRI.format('p_name')} AS a, {_TRI.format('q')} AS b FROM part, q),
s AS (SELECT p_partkey, p_name, round({_SIM.format(a='a', b='b')}, 6) AS similarity FROM t) SELECT * FROM s WHERE similarity > 0.3 ORDER BY similarity DESC, p_partkey LIMIT 20""")
def trigram_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return search.trigram_topk(part, part.where("p_partkey = 1").first().p_name, 20, "p_partkey", "p_name")


@query(f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity({_V}, {_Q}), 6), vec_id) AS rank, round(list_cosine_similarity({_V}, {_Q}), 6) AS score FROM embeddings QUALIFY rank <= 20),
q AS (SELECT p_name AS q FROM part WHERE p_partkey = 1), tt AS (SELECT p_partkey AS id, {_TRI.format('p_name')} AS a, {_TRI.format('q')} AS b FROM part, q),
s AS (SELECT id, round({_SIM.format(a='a', b='b')}, 6) AS similarity FROM tt),
t AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank, similarity FROM s WHERE similarity > 0.3 QUALIFY rank <= 20),
u AS (SELECT 0 AS l, id, rank FROM v UNION ALL SELECT 1, id, rank FROM t),
f AS (SELECT id, round(sum(1.0::DOUBLE / (40 + rank)), 9) AS rrf, min(l * 1000 + rank) AS first FROM u GROUP BY id)
SELECT f.id, rrf, greatest(coalesce(score, 0.0), coalesce(similarity, 0.0)) AS confidence, row_number() OVER (ORDER BY rrf DESC, first)::INT AS rank
FROM f LEFT JOIN v USING (id) LEFT JOIN t USING (id) ORDER BY rank LIMIT 10""")
def hybrid_entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by vector and by name likeness; confidence is the larger of both scores."""
    part = table(spark, sf_dir, "part")
    v = search.vector_topk(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 20, "vec_id").select(F.col("vec_id").alias("id"), "rank", F.round("score", 6).alias("score"))
    t = search.trigram_topk(part, part.where("p_partkey = 1").first().p_name, 20, "p_partkey", "p_name").select(F.col("p_partkey").alias("id"), "similarity")
    t = t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))
    top = search.hybrid(v, t, "id", 10)
    out = top.join(v.select("id", "score"), "id", "left").join(t.select("id", "similarity"), "id", "left")
    return out.select("id", "rrf", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("similarity", F.lit(0.0))).alias("confidence"), "rank")


@query("""WITH t AS (SELECT unnest([{'t': 'small', 'w': 1.0}, {'t': 'large', 'w': 0.9}, {'t': 'widget', 'w': 0.8}, {'t': 'red', 'w': 0.7}, {'t': 'blue', 'w': 0.6}, {'t': 'green', 'w': 0.5}, {'t': 'steel', 'w': 0.4}, {'t': 'brass', 'w': 0.3}]) AS x),
w AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS w FROM part)
SELECT p_partkey, round(max(0.5::DOUBLE * x.w), 6) AS score FROM w JOIN t ON list_contains(w, x.t) GROUP BY p_partkey ORDER BY score DESC, p_partkey LIMIT 50""")
def relation_term_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted terms joined to texts by an inverted index; the best weighted rank of each."""
    terms = [("small", 1.0), ("large", 0.9), ("widget", 0.8), ("red", 0.7), ("blue", 0.6), ("green", 0.5), ("steel", 0.4), ("brass", 0.3)]
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(T.tokens(F.concat_ws(" ", "p_name", "p_type"), T.WORD))).alias("t"))
    weighted = words.join(F.broadcast(spark.createDataFrame(terms, "t string, w double")), "t")
    return weighted.groupBy("p_partkey").agg(F.round(F.max(0.5 * F.col("w")), 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


@query("""WITH k AS (SELECT unnest(['Brand#1', 'Brand#23', 'Brand#45']) AS k), m AS (SELECT k, p_partkey, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS r FROM k JOIN part ON lower(p_brand) LIKE '%' || lower(k) || '%'),
e AS (SELECT DISTINCT p_partkey FROM m WHERE r <= 10) SELECT DISTINCT l_suppkey AS chunk_id FROM lineitem JOIN e ON l_partkey = p_partkey""")
def entity_linked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that match a keyword (at most ten a keyword), and the chunks they are linked with."""
    keys = spark.createDataFrame([("Brand#1",), ("Brand#23",), ("Brand#45",)], "k string")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    found = part.join(F.broadcast(keys), F.contains(F.lower("p_brand"), F.lower("k"))).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("p_partkey"))).where("r <= 10")
    return table(spark, sf_dir, "lineitem").join(found.select(F.col("p_partkey").alias("l_partkey")).distinct(), "l_partkey", "left_semi").select(F.col("l_suppkey").alias("chunk_id")).distinct()


@query(f"""WITH ids AS (SELECT unnest([3, 5, 8, 13, 21, 34]) AS vec_id), c AS (SELECT e.vec_id, round(list_cosine_similarity({_V}, {_Q}), 6) AS similarity FROM embeddings e JOIN ids USING (vec_id))
SELECT * FROM c WHERE (SELECT count(*) FROM c) = 6 ORDER BY similarity DESC, vec_id LIMIT 4""")
def candidates_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a candidate set; nothing if a candidate has no vector."""
    ids = [3, 5, 8, 13, 21, 34]
    q = F.array(*map(F.lit, map(float, _vector0(spark, sf_dir))))
    c = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", F.round(V.cosine(F.col("embedding"), q), 6).alias("similarity"))
    whole = c.agg((F.count("*") == len(ids)).alias("whole"))
    return c.join(F.broadcast(whole), F.col("whole")).orderBy(F.desc("similarity"), "vec_id").limit(4).select("vec_id", "similarity")


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query(f"""SELECT a.vec_id, b.vec_id AS candidate, {_COS} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id)::INT AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 WHERE {_COS} >= 0.1 QUALIFY rank <= 3""")
def orphan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a lost entity, all vectors as candidates."""
    e = table(spark, sf_dir, "embeddings")
    return search.best_candidates(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3, 0.1, block=200)


@query(f"""WITH d AS (SELECT doc_id, '# ' || source || chr(10) || coalesce(text, '') AS text FROM documents WHERE source IS NOT NULL), w AS (SELECT doc_id, {_W} AS w, regexp_extract_all(lower(array_to_string(regexp_extract_all(text, '(?m)^#+\\s+(.*)$', 1), ' ')), '[a-z0-9]+') AS h FROM d),
n AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'src1')) + 0.5::DOUBLE * len(list_filter(h, lambda x: x = 'src1')) AS n FROM w WHERE list_contains(w, 'src1'))
SELECT doc_id, round(n / (n + 1.0), 6) AS text_score, row_number() OVER (ORDER BY round(n / (n + 1.0), 6) DESC, doc_id)::INT AS rank FROM n ORDER BY text_score DESC, doc_id LIMIT 20""")
def text_search_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in headings count half as much again; every document is under the heading of its source."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return search.text_topk(d, ["src1"], 20, "doc_id", heading_weight=0.5)


@query(f"""WITH w AS (SELECT doc_id, unnest({_W}) AS term, len({_W}) AS dl FROM documents) SELECT term, doc_id, count(*)::INT AS tf, any_value(dl)::INT AS dl FROM w GROUP BY 1, 2""")
def inverted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inverted(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH w AS (SELECT doc_id, {_W.replace('text', "coalesce(text, '')")} AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), t AS (SELECT unnest(['that', 'nicht']) AS t), tf AS (SELECT doc_id, len(w) AS dl, t, len(list_filter(w, lambda x: x = t)) AS tf FROM w, t),
df AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY t)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM tf JOIN df USING (t), stats WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_by_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from an inverted table."""
    d = table(spark, sf_dir, "documents")
    terms = ["that", "nicht"]
    return search.bm25(search.inverted(d, "doc_id", terms=terms), terms, 20, "doc_id", search.corpus_stats(d))


_EXPANSIONS = ((("maker", "made"), ("brand", "small brushed"), 0.8), (("metal",), ("brass", "steel"), 0.5))


@query(f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity({_V}, {_Q}), 6), vec_id) AS rank, round(1 - round(1 - list_cosine_similarity({_V}, {_Q}), 6), 6) AS score FROM embeddings QUALIFY rank <= 20),
w AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS w FROM part), t AS (SELECT unnest([['made', 'metal', 'of'], ['brand'], ['small', 'brushed'], ['brass'], ['steel']]) AS t, unnest([1.0, 0.8, 0.8, 0.5, 0.5])::DOUBLE AS weight),
h AS (SELECT id, weight, len(list_filter(w, lambda x: list_contains(t, x)))::DOUBLE AS c FROM w, t WHERE len(list_filter(t, lambda x: NOT list_contains(w, x))) = 0), l AS (SELECT id, round(max(c / (c + 1) * weight), 6) AS score FROM h GROUP BY id),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM l QUALIFY rank <= 20), u AS (SELECT 0 AS k, id, rank FROM v UNION ALL SELECT 1, id, rank FROM r), f AS (SELECT id, round(sum(1.0::DOUBLE / (40 + rank)), 9) AS rrf, min(k * 1000 + rank) AS first FROM u GROUP BY id)
SELECT f.id, rrf, row_number() OVER (ORDER BY rrf DESC, first)::INT AS rank, v.score AS vector_score, r.score AS text_score, CASE WHEN v.id IS NULL THEN 'bm25' WHEN r.id IS NULL THEN 'vector' ELSE 'vector+bm25' END AS source_type FROM f LEFT JOIN v USING (id) LEFT JOIN r USING (id) ORDER BY rank LIMIT 15""")
def hybrid_relation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by vector and by weighted terms, the question's own and what it is expanded to."""
    terms = search.relation_terms("made of metal", _EXPANSIONS)
    v = search.vector_topk(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 20, "vec_id").select(F.col("vec_id").alias("id"), "rank", "score")
    lexical = search.term_rank(table(spark, sf_dir, "part"), terms, "p_partkey", ["p_name", "p_type"], 20).withColumnRenamed("p_partkey", "id")
    return search.hybrid_relations(v, lexical, "id", 15)


@query(f"""WITH v AS (SELECT vec_id FROM embeddings JOIN documents ON doc_id = vec_id ORDER BY round(1 - list_cosine_similarity({_V}, {_Q}), 6), vec_id LIMIT 30), w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/-][a-z0-9]+)*'), lambda t: length(t) > 2 AND t NOT IN ('and', 'are', 'does', 'for', 'from', 'how', 'that', 'the', 'was', 'what', 'when', 'where', 'which', 'who', 'with'))) AS w FROM documents WHERE doc_id IN (SELECT vec_id FROM v)),
s AS (SELECT doc_id, len(list_intersect(['thing', 'this'], w)) AS c, len(w) AS n FROM w) SELECT doc_id AS vec_id, CASE WHEN n = 0 THEN 0 ELSE round(c / 2::DOUBLE + 0.35::DOUBLE * c / n, 6) END AS score, row_number() OVER (ORDER BY CASE WHEN n = 0 THEN 0 ELSE round(c / 2::DOUBLE + 0.35::DOUBLE * c / n, 6) END DESC, doc_id)::INT AS rank FROM s ORDER BY rank LIMIT 5""")
def two_stage_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty nearest texts, reranked by words, five kept."""
    rows = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return search.two_stage(rows, _vector0(spark, sf_dir), 5, 30, "vec_id", "embedding", lambda near: shaping.local_rerank(near, "this thing", "text", "vec_id", 30))


@query("SELECT vec_id, len(v)::INT AS dim, round(list_sum(v), 5) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) WHERE vec_id % 3 > 0")
def vectors_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read from text; those with a component that is no finite number are left out."""
    e = table(spark, sf_dir, "embeddings")
    text = F.concat(F.lit("[ "), F.array_join(F.col("embedding").cast("array<string>"), ", "), F.when(F.col("vec_id") % 3 == 0, F.when(F.col("vec_id") % 2 == 0, ", NaN").otherwise(", x")).otherwise(""), F.lit("]"))
    rows = e.select("vec_id", V.parsed(text).alias("v")).where("v IS NOT NULL")
    return rows.select("vec_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""WITH n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part) SELECT name,
  (CASE WHEN lower(name) = 'brand#1' THEN 1000 WHEN starts_with(lower(name), 'brand#1') THEN 500 ELSE 100 - length(name) END + CASE WHEN lower(name) LIKE '%_brand#1%' THEN 50 ELSE 0 END)::INT AS score
  FROM n WHERE lower(name) LIKE '%brand#1%' ORDER BY score DESC, name LIMIT 20""")
def label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("name")).union(part.select("p_type"))
    return search.label_search(names, "brand#1", 20)


@query("""SELECT vec_id, len(embedding)::INT AS dim, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query("""SELECT label, count(*) AS rows, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong FROM embeddings GROUP BY label""")
def vector_dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), F.count_if(F.size("embedding") != 64).alias("wrong"))
