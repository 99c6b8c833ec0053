"""Graph queries: parts and suppliers are nodes, the lines between them edges; nations and regions are nodes without edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import communities, graph, lineage, merging
from .registry import query, table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # grouped by numbers, which names follow
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    return pairs.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("tgt"), "weight")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("kind"))
    for name, key in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        p = p.unionByName(table(spark, sf_dir, name).select(F.concat(F.lit(name[0]), key).alias("id"), F.lit(name).alias("kind")))
    return p


_E = "e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)"
_N = "n AS (SELECT 'p' || p_partkey AS id, p_brand AS kind FROM part UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region)"
_D = "d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT tgt FROM e) GROUP BY id)"


@query(f"WITH {_E}, {_N}, {_D} SELECT n.id, coalesce(degree, 0)::BIGINT AS degree FROM n LEFT JOIN d USING (id)")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_degrees(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_E}, {_D} SELECT src, tgt, weight, a.degree + b.degree AS degree FROM e JOIN d a ON a.id = src JOIN d b ON b.id = tgt")
def edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_degrees(_edges(spark, sf_dir))


@query(f"WITH {_E}, {_D} SELECT * FROM d ORDER BY degree DESC, id LIMIT 30")
def popular_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.popular(_edges(spark, sf_dir), 30)


@query(f"WITH {_E}, {_N} SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = id OR tgt = id)")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_E}, {_N} SELECT * FROM n WHERE id IN (SELECT src FROM e UNION SELECT tgt FROM e)")
def connected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_E}, {_N}, {_D} SELECT n.id, coalesce(degree, 0)::BIGINT AS degree FROM n LEFT JOIN d USING (id) WHERE coalesce(degree, 0) <= 20")
def sparse_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sparse(_nodes(spark, sf_dir), _edges(spark, sf_dir), 20)


@query(f"WITH {_E}, i AS (SELECT 's' || unnest([1, 2, 3]) AS id) SELECT id, src, tgt FROM i JOIN e ON id = src UNION ALL SELECT id, src, tgt FROM i JOIN e ON id = tgt")
def adjacency_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string"), _edges(spark, sf_dir))


@query(f"""WITH {_E}, a AS (SELECT tgt AS a, src AS b FROM e WHERE tgt IN ('s1', 's2') UNION ALL SELECT src, tgt FROM e WHERE tgt = 's3' UNION ALL SELECT 's1', 's2'),
m AS (SELECT a, b, src, tgt, 1 AS p FROM a JOIN e ON a = src AND b = tgt UNION ALL SELECT a, b, src, tgt, 0 FROM a JOIN e ON a = tgt AND b = src)
SELECT a, b, src, tgt FROM m QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY p) = 1""")
def edge_lookup_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    pairs = e.where("tgt IN ('s1', 's2')").select(F.col("tgt").alias("a"), F.col("src").alias("b")).union(e.where("tgt = 's3'").select("src", "tgt"))
    return graph.lookup(pairs.union(spark.createDataFrame([("s1", "s2")], "a string, b string")), e)


_BFS = """b AS (SELECT src, tgt FROM e UNION SELECT tgt, src FROM e), l0 AS (SELECT 's1' AS id), l1 AS (SELECT DISTINCT tgt AS id FROM b JOIN l0 ON src = id WHERE tgt NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT tgt AS id FROM b JOIN l1 ON src = id WHERE tgt NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1))"""


@query(f"""WITH {_E}, {_BFS}, l3 AS (SELECT DISTINCT tgt AS id FROM b JOIN l2 ON src = id WHERE tgt NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1 UNION ALL SELECT id FROM l2))
SELECT id, 0 AS level FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3""")
def bfs_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "id string"), 3)[0]


@query(f"""WITH {_E}, {_D}, {_BFS}, s AS (SELECT id, 0 AS level FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2), c AS (SELECT * FROM s ORDER BY level, id LIMIT 60),
i AS (SELECT DISTINCT src, tgt FROM e WHERE src IN (SELECT id FROM c) AND tgt IN (SELECT id FROM c))
SELECT id, level, degree AS db_degree, (SELECT count(*) FROM s) > 60 AS is_truncated, (SELECT count(*) FROM i) AS n_edges FROM c JOIN d USING (id)""")
def bfs_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 60 nodes in two steps, their degree in the whole graph, whether nodes were cut, and how many edges are among them."""
    e = lineage.written(_edges(spark, sf_dir).select("src", "tgt"))  # read by each step
    found, truncated = graph.bfs(e, spark.createDataFrame([("s1",)], "id string"), 2, 60)
    nodes, inside = graph.subgraph(found, e)
    return nodes.withColumn("is_truncated", F.lit(truncated)).join(inside.agg(F.count("*").alias("n_edges")), F.lit(True))


@query(f"""WITH {_E}, {_D}, t AS (SELECT id FROM d WHERE degree >= 2 ORDER BY degree DESC, id LIMIT 200)
SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt FROM e WHERE src IN (SELECT id FROM t) AND tgt IN (SELECT id FROM t)""")
def induced_topn_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return graph.induced(e, graph.degrees(e).where("degree >= 2").orderBy(F.desc("degree"), "id").limit(200))


@query(f"""WITH {_E}, m AS (SELECT CASE WHEN src LIKE '%7' THEN 'p1' ELSE src END AS a, CASE WHEN tgt IN ('s2', 's3') THEN 's1' ELSE tgt END AS b, weight FROM e)
SELECT least(a, b) AS src, greatest(a, b) AS tgt, sum(weight) AS weight, count(*) AS n FROM m WHERE a <> b GROUP BY 1, 2""")
def entity_merge_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 10 = 7").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("p1").alias("canonical"))
    return graph.merge_nodes(_edges(spark, sf_dir), p.union(spark.createDataFrame([("s2", "s1"), ("s3", "s1")], "id string, canonical string")))


@query(f"WITH {_E}, {_D} SELECT degree, count(*) AS nodes FROM d GROUP BY degree")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(f"WITH {_E} SELECT src, tgt, weight FROM e WHERE src NOT IN ('p1', 'p3') AND tgt <> 's5'")
def remove_nodes_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.remove_nodes(_nodes(spark, sf_dir), _edges(spark, sf_dir), spark.createDataFrame([("p1",), ("p3",), ("s5",)], "id string"))[1].select("src", "tgt", "weight")


@query(f"""WITH {_E}, {_N}, nw AS (SELECT 'p' || p_partkey AS src, 's1' AS tgt, -1.0::DOUBLE AS weight FROM part WHERE p_partkey <= 50 UNION ALL SELECT 'nowhere', 's1', 5.0),
ok AS (SELECT * FROM nw WHERE src IN (SELECT id FROM n) AND tgt IN (SELECT id FROM n))
SELECT coalesce(ok.src, e.src) AS src, coalesce(ok.tgt, e.tgt) AS tgt, coalesce(ok.weight, e.weight) AS weight FROM e FULL JOIN ok ON e.src = ok.src AND e.tgt = ok.tgt""")
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "part").where("p_partkey <= 50").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.lit("s1").alias("tgt"), F.lit(-1.0).alias("weight"))
    return graph.upsert_edges(_nodes(spark, sf_dir), _edges(spark, sf_dir), new.union(spark.createDataFrame([("nowhere", "s1", 5.0)], "src string, tgt string, weight double")))


@query(f"""WITH {_N} SELECT id, CASE WHEN id IN ('p1', 'p2') THEN 'changed' ELSE kind END AS kind, CASE WHEN id IN ('p1', 'p2') THEN 'yes' END AS seen FROM n UNION ALL SELECT 'new1', 'changed', 'yes'""")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).select("id", F.create_map(F.lit("kind"), "kind").alias("properties"))
    new = spark.createDataFrame([(x, {"kind": "changed", "seen": "yes"}) for x in ("p1", "p2", "new1")], "id string, properties map<string,string>")
    out = graph.upsert_nodes(nodes, new)
    return out.select("id", F.col("properties")["kind"].alias("kind"), F.try_element_at("properties", F.lit("seen")).alias("seen"))


@query(f"""WITH {_E}, b AS (SELECT src, tgt FROM e UNION SELECT tgt, src FROM e), i AS (SELECT DISTINCT src AS id FROM b),
l1 AS (SELECT i.id, least(i.id, min(tgt)) AS l FROM i JOIN b ON src = i.id GROUP BY i.id), l2 AS (SELECT l1.id, least(any_value(l1.l), min(x.l)) AS l FROM l1 JOIN b ON src = l1.id JOIN l1 x ON x.id = tgt GROUP BY l1.id)
SELECT id, l AS label FROM l2""")
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.labels(_edges(spark, sf_dir), 2)


@query(f"WITH {_E}, a AS (SELECT 'p' || p_partkey AS a, 's' || (p_partkey % 7) AS b FROM part UNION ALL SELECT 's1', 's2') SELECT a, b, EXISTS (SELECT 1 FROM e WHERE (src = a AND tgt = b) OR (src = b AND tgt = a)) AS found FROM a")
def edge_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("a"), F.concat(F.lit("s"), F.col("p_partkey") % 7).alias("b"))
    return graph.exists(asked.union(spark.createDataFrame([("s1", "s2")], "a string, b string")), _edges(spark, sf_dir))


@query(f"WITH {_E}, {_N}, {_D} SELECT n.id, kind, degree FROM n JOIN d USING (id) WHERE n.id IN ('s1', 'p7', 'n3')")
def entity_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([("s1",), ("p7",), ("n3",)], "id string")
    return _nodes(spark, sf_dir).join(ids, "id", "left_semi").join(graph.degrees(_edges(spark, sf_dir)), "id")


@query(f"WITH {_E} SELECT src, tgt, weight FROM e WHERE NOT ((src = 'p1' AND tgt IN ('s1', 's2', 's3', 's4', 's5')) OR src = 'p2')")
def remove_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    gone = spark.createDataFrame([(f"s{i}", "p1") for i in range(1, 6)], "src string, tgt string").union(e.where("src = 'p2'").select("src", "tgt"))
    return graph.remove_relations(e, gone).select("src", "tgt", "weight")


@query(f"""WITH {_E}, {_D}, r AS (SELECT src, tgt, weight, ((src IN ('p1', 'p2'))::INT + (tgt IN ('s1', 's2', 's3'))::INT) AS ends FROM e)
SELECT src, tgt, weight, ends, a.degree + b.degree AS degree, row_number() OVER (ORDER BY ends DESC, a.degree + b.degree DESC, weight DESC, src, tgt)::INT AS rank FROM r JOIN d a ON a.id = src JOIN d b ON b.id = tgt WHERE ends > 0 ORDER BY rank LIMIT 40""")
def most_related_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(_edges(spark, sf_dir), spark.createDataFrame([(x,) for x in ("p1", "p2", "s1", "s2", "s3")], "id string"), 40)


@query("""WITH f AS (SELECT l_partkey AS src, count(*) AS sources, count(DISTINCT l_returnflag) AS predicates FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT 'sources' AS what, CAST(sources AS VARCHAR) AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'predicate', l_returnflag, count(*) FROM lineitem GROUP BY 2) QUALIFY row_number() OVER (PARTITION BY what ORDER BY n DESC, value) <= 15""")
def graph_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts have each number of source lines, and lines each predicate; the fifteen most frequent of each."""
    li = table(spark, sf_dir, "lineitem")
    sources = graph.histogram(li.groupBy("l_partkey").agg(F.count("*").cast("string").alias("value")), "value").withColumn("what", F.lit("sources"))
    every = [sources, graph.histogram(li.withColumnRenamed("l_returnflag", "value"), "value").withColumn("what", F.lit("predicate"))]
    out = every[0].orderBy(F.desc("n"), "value").limit(15)
    return out.unionByName(every[1].orderBy(F.desc("n"), "value").limit(15)).select("what", "value", "n")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("tgt"), F.col("l_quantity").alias("weight"), F.concat(F.lit(" supplies, "), F.lower("l_returnflag")).alias("keywords"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("description"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.when(F.col("l_returnflag") == "R", "negative_evidence").otherwise("affirmative").alias("polarity"),
    )


@query("""WITH f AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, * FROM lineitem), k AS (SELECT src, tgt, w, min((l_orderkey, l_linenumber, i)) AS pos FROM (SELECT *, unnest(['supplies', lower(l_returnflag)]) AS w, unnest([1, 2]) AS i FROM f) GROUP BY 1, 2, 3),
x AS (SELECT src, tgt, 'line ' || l_linenumber AS d, min((l_orderkey, l_linenumber)) AS pos FROM f GROUP BY 1, 2, 3)
SELECT g.src, g.tgt, weight, n, keywords, description FROM (SELECT src, tgt, sum(l_quantity) AS weight, count(*) AS n FROM f GROUP BY 1, 2) g JOIN (SELECT src, tgt, string_agg(w, ',' ORDER BY pos) AS keywords FROM k GROUP BY 1, 2) kk ON g.src = kk.src AND g.tgt = kk.tgt
JOIN (SELECT src, tgt, string_agg(d, '<SEP>' ORDER BY pos) AS description FROM x GROUP BY 1, 2) xx ON g.src = xx.src AND g.tgt = xx.tgt""")
def merge_relation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_facts(_facts(spark, sf_dir), ["o", "l"])


@query("SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R')")
def conflicting_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.conflicting(_facts(spark, sf_dir), "polarity")


@query("""WITH v AS (SELECT s_nationkey AS key, s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS description, CASE WHEN s_suppkey % 3 > 0 THEN 'T' || s_suppkey % 5 ELSE '' END AS entity_type, 'a<SEP>c' || s_suppkey % 6 AS source_id, 'x, y' || s_suppkey % 2 || ', ' AS tags, s_acctbal AS weight FROM supplier),
s AS (SELECT key, p, min(s_suppkey * 10 + i) AS pos FROM (SELECT key, s_suppkey, unnest(string_split(source_id, '<SEP>')) AS p, unnest([0, 1]) AS i FROM v) GROUP BY 1, 2), t AS (SELECT key, p, min(s_suppkey * 10 + i) AS pos FROM (SELECT key, s_suppkey, unnest(['x', 'y' || s_suppkey % 2]) AS p, unnest([0, 1]) AS i FROM v) GROUP BY 1, 2)
SELECT key, count(*) AS n, string_agg(description, '<SEP>' ORDER BY s_suppkey) AS description, arg_min(CASE WHEN entity_type <> '' THEN entity_type END, s_suppkey) FILTER (WHERE entity_type <> '') AS entity_type, arg_max(description, s_suppkey) FILTER (WHERE description IS NOT NULL) AS last_name,
  (SELECT string_agg(p, '<SEP>' ORDER BY pos) FROM s WHERE s.key = v.key) AS source_id, (SELECT string_agg(p, ',' ORDER BY pos) FROM t WHERE t.key = v.key) AS tags, max(weight) AS weight FROM v GROUP BY key""")
def merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of a nation as one entity, an attribute a strategy."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("key"), k, F.when(k % 4 > 0, F.col("s_name")).alias("description"), F.when(k % 3 > 0, F.concat(F.lit("T"), (k % 5).cast("string"))).otherwise("").alias("entity_type"), F.concat(F.lit("a<SEP>c"), (k % 6).cast("string")).alias("source_id"),
        F.concat(F.lit("x, y"), (k % 2).cast("string"), F.lit(", ")).alias("tags"), F.col("s_acctbal").alias("weight"), F.when(k % 4 > 0, F.col("s_name")).alias("last_name"),
    )
    return merging.merge_rows(rows, ["key"], ["s_suppkey"], {**merging.ENTITY, "tags": "join_unique_comma", "weight": "max", "last_name": "keep_last"})


@query("""WITH i AS (SELECT 's' || s_suppkey AS id, 's' || (s_suppkey % 5 + 1) AS canonical FROM supplier WHERE s_suppkey > 5), nn AS (SELECT 's' || s_suppkey AS id, s_name AS description, 'c' || s_suppkey AS source_id FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name, 'c' || p_partkey FROM part)
SELECT coalesce(canonical, nn.id) AS id, string_agg(description, '<SEP>' ORDER BY canonical IS NOT NULL, nn.id) AS description, string_agg(source_id, '<SEP>' ORDER BY canonical IS NOT NULL, nn.id) AS source_id, count(*) AS n FROM nn LEFT JOIN i USING (id) GROUP BY 1""")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0]


@query("""WITH e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), m AS (SELECT src AS a, CASE WHEN substring(tgt, 2)::INT > 5 THEN 's' || (substring(tgt, 2)::INT % 5 + 1) ELSE tgt END AS b, tgt, weight FROM e)
SELECT a AS src, b AS tgt, max(weight) AS weight, string_agg('c' || substring(tgt, 2), '<SEP>' ORDER BY tgt) AS source_id, count(*) AS n FROM m GROUP BY 1, 2""")
def merged_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1]


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers beyond the fifth become one of the first five."""
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    into = s.where("s_suppkey > 5").select(name(F.col("s_suppkey")).alias("id"), name(F.col("s_suppkey") % 5 + 1).alias("canonical"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey"), "p_name", F.concat(F.lit("c"), "p_partkey"))
    nodes = s.select(name(F.col("s_suppkey")).alias("id"), F.col("s_name").alias("description"), F.concat(F.lit("c"), "s_suppkey").alias("source_id")).union(p)
    edges = li.groupBy(F.concat(F.lit("p"), "l_partkey").alias("src"), name(F.col("l_suppkey")).alias("tgt"), F.concat(F.lit("c"), "l_suppkey").alias("source_id")).agg(F.max("l_quantity").alias("weight"))
    return merging.merge_entities(nodes, edges, into)


@query(f"WITH {_E} SELECT CASE WHEN src = 'p1' THEN 'first part' ELSE src END AS src, CASE WHEN tgt = 's2' THEN 'second supplier' ELSE tgt END AS tgt, weight FROM e")
def renamed_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2 keeps its name, as another node has the new one."""
    names = spark.createDataFrame([("p1", "first part"), ("s2", "second supplier"), ("p2", "p3")], "id string, new string")
    return merging.rename(_nodes(spark, sf_dir), _edges(spark, sf_dir), names)[1].select("src", "tgt", "weight")


@query("SELECT 'p' || p_partkey AS alias, 'p' || (p_partkey % 50) AS canonical, 'manual_merge' AS method, 1.0::DOUBLE AS confidence FROM part WHERE p_partkey <> p_partkey % 50")
def merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    into = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("p"), F.col("p_partkey") % 50).alias("canonical"))
    return merging.audit_rows(into)


@query(f"WITH {_E}, a AS (SELECT 'p' || p_partkey AS alias, 's' || (p_partkey % 9 + 1) AS canonical FROM part) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = alias AND tgt = canonical)")
def resolvable_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("alias"), F.concat(F.lit("s"), F.col("p_partkey") % 9 + 1).alias("canonical"))
    return merging.resolvable(a, _edges(spark, sf_dir))


@query("""WITH t AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS tgt FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT DISTINCT src, tgt FROM t JOIN (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region UNION ALL SELECT 'c' || c_custkey FROM customer) a ON a.id = src JOIN (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region) b ON b.id = tgt""")
def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the customer, nation and region hierarchy whose ends both exist."""
    name = lambda p, c: F.concat(F.lit(p), c)
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    edges = c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("tgt")).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    nodes = c.select(name("c", "c_custkey").alias("id")).union(n.select(name("n", "n_nationkey"))).union(r.select(name("r", "r_regionkey")))
    return edges.join(nodes.select(F.col("id").alias("src")), "src").join(nodes.select(F.col("id").alias("tgt")), "tgt").distinct().select("src", "tgt")


@query(f"WITH {_N} SELECT id, kind FROM n UNION ALL SELECT 'new1', 'made'")
def created_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.create_nodes(_nodes(spark, sf_dir), spark.createDataFrame([("new1", "made"), ("p1", "made")], "id string, kind string"))


@query("""WITH e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, sum(l_quantity) AS weight, count(*) FILTER (WHERE l_returnflag = 'R') AS spans, min(l_linestatus) FILTER (WHERE l_linenumber = 1) AS content FROM lineitem GROUP BY 1, 2), a AS (SELECT 's' || (p_partkey % 9) AS a, 'p' || p_partkey AS b FROM part)
SELECT a, b, weight, content, coalesce(spans, 0) AS spans FROM a LEFT JOIN e ON src = b AND tgt = a""")
def relation_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("src", F.concat(F.lit("p"), "l_partkey")).withColumn("tgt", F.concat(F.lit("s"), "l_suppkey"))
    pairs = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 9).alias("a"), F.concat(F.lit("p"), "p_partkey").alias("b"))
    records = li.where("l_linenumber = 1").select("src", "tgt", F.col("l_linestatus").alias("content"))
    return graph.relation_info(pairs, _edges(spark, sf_dir), records, li.where("l_returnflag = 'R'").select("src", "tgt", F.col("l_linenumber").alias("span")))


@query()
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts and suppliers by modularity, a few rounds of it."""
    return communities.louvain(_edges(spark, sf_dir), "weight", rounds=4, levels=2)[0]


@query(f"""WITH {_E}, {_N}, w AS (SELECT src AS a, tgt AS b, weight AS w FROM e UNION ALL SELECT tgt, src, weight FROM e),
o AS (SELECT id, kind AS c FROM n), s AS (SELECT x.c, sum(w) AS total, sum(CASE WHEN x.c = y.c THEN w ELSE 0 END) AS inside FROM w JOIN o x ON x.id = a JOIN o y ON y.id = b GROUP BY x.c)
SELECT round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 9) AS modularity FROM s""")
def modularity_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modularity of the communities that the kinds of nodes are: brands, and all suppliers."""
    own = _nodes(spark, sf_dir).select("id", F.col("kind").alias("community"))
    graph_ = communities.weighted(_edges(spark, sf_dir), "weight")
    return spark.createDataFrame([(round(communities.modularity(graph_, own), 9),)], "modularity double")


@query(f"""WITH {_E}, d AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS tgt FROM lineitem WHERE l_returnflag = 'R')
SELECT e.src, e.tgt, e.weight::DOUBLE AS weight, CASE WHEN d.src IS NOT NULL THEN 'returned' ELSE 'sold' END AS kind, d.src IS NOT NULL AS edited FROM e LEFT JOIN d ON d.src = e.tgt AND d.tgt = e.src""")
def relations_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of parts that came back get another kind, by edits that point the other way; their weight stays."""
    none = F.map_filter(F.create_map(F.lit("kind"), F.lit("")), lambda k, v: F.lit(False))
    edges = _edges(spark, sf_dir).select("src", "tgt", F.map_concat(none, F.create_map(F.lit("weight"), F.col("weight").cast("string"), F.lit("kind"), F.lit("sold"))).alias("properties"))
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt")).distinct()
    edits = back.withColumn("properties", F.create_map(F.lit("kind"), F.lit("returned"), F.lit("edited"), F.lit("yes")))
    out, _ = graph.edited_relations(edges, edits)
    p = F.col("properties")
    return out.select("src", "tgt", p["weight"].cast("double").alias("weight"), p["kind"].alias("kind"), F.try_element_at(p, F.lit("edited")).isNotNull().alias("edited"))
