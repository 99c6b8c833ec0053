"""Searches through written indexes of vectors and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage, name_index, vector_index
from .registry import query, table
from .search_queries import _SIM, _TRI

_COSINE = "round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query(f"""SELECT a.vec_id AS question, b.vec_id AS id, {_COSINE} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE}, b.vec_id)::INT AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 QUALIFY rank <= 5""")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every twentieth vector, exactly: lists are passed over by their radius."""
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.build(e, lineage.folder(spark), "vec_id", list_rows=32)
    return vector_index.search(index, e.where("vec_id % 20 = 0"), 5, "vec_id", exact=True)


_L2 = _COSINE.replace("1 - list_cosine_similarity", "list_distance")


@query(f"""SELECT a.vec_id AS question, b.vec_id AS id, {_L2} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_L2}, b.vec_id)::INT AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 QUALIFY rank <= 5""")
def vector_index_exact_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.build(e, lineage.folder(spark), "vec_id", metric="l2", list_rows=32)
    return vector_index.search(index, e.where("vec_id % 50 = 0"), 5, "vec_id", exact=True)


@query()
def orphan_candidates_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a lost entity, its candidates by codes of the lists it probes."""
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.build(e, lineage.folder(spark), "vec_id", list_rows=32, k=3)
    return vector_index.search(index, e.where("vec_id % 20 = 0"), 3, "vec_id").where("distance <= 0.9")


@query(f"""WITH n AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part), t AS (SELECT p_partkey, name, {_TRI.format('name')} AS a FROM n),
s AS (SELECT q.p_partkey AS question, t.p_partkey AS id, t.name, round({_SIM.format(a='t.a', b='q.a')}, 6) AS similarity FROM t, (SELECT * FROM t WHERE p_partkey % 100 = 0) q)
SELECT * FROM s WHERE similarity > 0.6 QUALIFY row_number() OVER (PARTITION BY question ORDER BY similarity DESC, id) <= 10""")
def similar_names_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten names most like every hundredth name, through the trigram index."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    path = lineage.folder(spark)
    name_index.write(names, path, "p_partkey", "name")
    return name_index.similar(spark, path, names.where("p_partkey % 100 = 0"), "p_partkey", "name", 0.6, 10)
