"""Alias tables over customers and parts, guards against wrong merges, and the composed retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aliases as L
from .registry import query, table
from .router import explained, retrieve


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return c.select(F.upper("c_name").alias("alias"), F.concat(F.lit("Group "), F.col("c_nationkey").cast("string")).alias("canonical"), (F.col("c_acctbal") / 10000).alias("confidence"), (F.col("c_custkey") % 2 == 0).alias("verified"))


_A = "a AS (SELECT upper(c_name) AS alias, 'Group ' || c_nationkey AS canonical, c_acctbal / 10000 AS confidence, c_custkey % 2 = 0 AS verified FROM customer WHERE c_custkey % 3 = 0)"


@query(f"WITH {_A} SELECT c_custkey, canonical FROM customer JOIN a ON lower(c_name) = lower(alias) WHERE confidence >= 0.5")
def alias_apply_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.to_apply(table(spark, sf_dir, "customer"), _aliases(spark, sf_dir), "c_name", 0.5).select("c_custkey", "canonical")


@query(f"WITH {_A} SELECT c_custkey FROM customer WHERE lower(c_name) NOT IN (SELECT lower(alias) FROM a) AND lower(c_name) NOT IN (SELECT lower(canonical) FROM a)")
def unreviewed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unreviewed(table(spark, sf_dir, "customer"), _aliases(spark, sf_dir), "c_name").select("c_custkey")


@query(f"WITH {_A} SELECT alias, canonical, round(confidence, 6) AS confidence FROM a WHERE confidence BETWEEN 0.2 AND 0.8 AND (verified IS NULL OR NOT verified)")
def aliases_to_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.to_verify(_aliases(spark, sf_dir), 0.2, 0.8).select("alias", "canonical", F.round("confidence", 6).alias("confidence"))


_PAIRS = (
    ("Apple", "Apple Inc", "Person", "Organization", "types"), ("Apple", "Apple Inc", "unknown", "Organization", ""), ("May 2024", "2024 may", "Event", "Event", ""), ("Q1 2024", "quarter 2 2024", "Event", "Event", "dates"),
    ("2023", "2024", "Data", "Data", "dates"), ("phase 2 study", "phase 3 study", "", "", "numbers"), ("AB12", "the antibody", "", "", "short code"), ("dose", "10 mg dose", "Data", "Data", "dose"), ("IBM", "International Machines", "", "", ""),
    ("sept 2020", "2020 September", "", "", ""), ("study two", "study 2", "", "", "short code"),
)


@query("SELECT p_partkey, CASE p_partkey % {} {} END AS reason FROM part".format(len(_PAIRS), " ".join(f"WHEN {k} THEN '{x[4]}'" for k, x in enumerate(_PAIRS))))
def alias_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names, each in turn, with the reason why one must not become the other."""
    pick = lambda i: F.element_at(F.lit([x[i] for x in _PAIRS]), (F.col("p_partkey") % len(_PAIRS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(L.block_reason(pick(0), pick(1), pick(2), pick(3)), F.lit("")).alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN (o_orderstatus = 'F' AND l_returnflag = 'R') OR (o_orderstatus = 'O' AND l_returnflag = 'A') THEN 'types'
  WHEN l_linenumber % 4 = 0 AND strftime(o_orderdate, '%Y-%m') <> strftime(l_shipdate, '%Y-%m') THEN 'dates' WHEN l_linenumber % 4 = 1 AND l_quantity <> l_linenumber THEN 'numbers'
  WHEN l_linenumber % 4 = 2 AND l_tax > 0.04 THEN 'dose' WHEN l_linenumber % 4 = 3 AND l_discount > 0.05 THEN 'short code' ELSE '' END AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def alias_guard_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names made of an order's and its lines' own months, amounts and numbers, with types by their flags."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n, amount, code = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string")
    form = n % 4
    a = F.when(form == 0, F.date_format("o_orderdate", "MMMM yyyy")).when(form == 1, F.concat(F.lit("Lot "), amount)).when(form == 2, F.concat(amount, F.lit(" mg dose"))).otherwise(F.concat(F.lit("AB"), code))
    b = (
        F.when(form == 0, F.date_format("l_shipdate", "yyyy MMM"))
        .when(form == 1, F.concat(F.lit("lot no. "), n.cast("string")))
        .when(form == 2, F.when(F.col("l_tax") > 0.04, "the dose").otherwise(F.concat(amount, F.lit("mg"))))
        .otherwise(F.when(F.col("l_discount") > 0.05, "the antibody").otherwise(F.concat(F.lit("ab-"), code)))
    )
    kind_a = F.when(F.col("o_orderstatus") == "F", "Person").when(F.col("o_orderstatus") == "O", "Organization").otherwise("unknown")
    kind_b = F.when(F.col("l_returnflag") == "R", "Organization").when(F.col("l_returnflag") == "A", "Person").otherwise("")
    return rows.select("l_orderkey", n, F.coalesce(L.block_reason(a, b, kind_a, kind_b), F.lit("")).alias("reason"))


@query(f"WITH {_A} SELECT c_custkey, c_name FROM customer WHERE lower(c_name) NOT IN (SELECT lower(alias) FROM a) ORDER BY c_acctbal DESC, c_name LIMIT 500")
def unresolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unresolved(table(spark, sf_dir, "customer"), _aliases(spark, sf_dir), "c_name", "c_acctbal").select("c_custkey", "c_name")


_RULES = ((1, "Machine Works", ("building", "the machinery")), (2, "House Hold", ("household", "furniture")), (3, "Nothing", ()), (4, "Building", ("works",)))


@query("""WITH q AS (SELECT c_custkey, 'about ' || lower(c_mktsegment) || ' and  THE  Machinery, or not' AS q FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'of ' || c_mktsegment || '.' FROM customer WHERE c_custkey % 2 = 1)
SELECT c_custkey, array_to_string(list_distinct_ordered, '|') AS expanded FROM (SELECT c_custkey, list_concat(
  CASE WHEN contains(lower(q), 'building') OR c_custkey % 2 = 0 THEN ['Machine Works', 'building', 'the machinery'] ELSE [] END, CASE WHEN contains(lower(q), 'household') OR contains(lower(q), 'furniture') THEN ['House Hold', 'household', 'furniture'] ELSE [] END,
  CASE WHEN contains(lower(q), 'building') THEN ['Building', 'works'] ELSE [] END) AS list_distinct_ordered FROM q)""")
def query_aliases_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other names of what a question mentions, by rules."""
    rules = spark.createDataFrame([(p, c, list(a)) for p, c, a in _RULES], "position int, canonical string, aliases array<string>")
    q = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("about "), F.lower("c_mktsegment"), F.lit(" and  THE  Machinery, or not"))).otherwise(F.concat(F.lit("of "), "c_mktsegment", F.lit(".")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", q.alias("q"))
    return rows.join(L.expanded(rows.select("q").distinct(), rules, "q"), "q").select("c_custkey", F.array_join("expanded", "|").alias("expanded"))


@query("""SELECT least(c_custkey, c_custkey % 100) AS src, greatest(c_custkey, c_custkey % 100) AS tgt, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'builds' ELSE 'trades with' END AS predicate, count(*) AS n FROM customer WHERE c_custkey <> c_custkey % 100 GROUP BY 1, 2, 3""")
def predicate_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"BUILDING": "builds", "MACHINERY": "builds", "AUTOMOBILE": "trades with", "FURNITURE": "trades with", "HOUSEHOLD": "trades with"}
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") % 100).alias("tgt"), F.col("c_mktsegment").alias("keywords"))
    return L.canonical_relations(e, known, "trades with")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Machine Works' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Home Partners' WHEN c_mktsegment = 'BUILDING' THEN 'Building' END AS entity FROM customer""")
def entity_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity by which a question's chunks are filtered: that of the first rule that it names; a name that only tells of a partnership doesn't count."""
    rules = spark.createDataFrame([(0, "Machine Works", ["the machinery", "machinery partner"]), (1, "Home Partners", ["household"]), (2, "Building", ["partners of building"])], "position int, canonical string, aliases array<string>")
    q = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("The  MACHINERY and "), F.lower("c_mktsegment"))).otherwise(F.concat(F.lit("machinery partner, "), F.lower("c_mktsegment"), F.lit("?")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", q.alias("q"))
    return rows.join(L.entity_filters(rows.select("q").distinct(), rules, "q"), "q").select("c_custkey", "entity")


def _retrieval(spark: SparkSession, sf_dir: str, mode: str, plan=retrieve) -> DataFrame:
    """A question over documents as chunks: embeddings are their vectors, suppliers the entities that lines link with them (order and document of one number)."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("doc"), F.col("text").alias("content"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(docs.select("chunk_id"), "chunk_id", "left_semi")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("chunk_id")).distinct().join(docs.select("chunk_id"), "chunk_id", "left_semi")
    return plan("compare the parts of the world over time", docs, vectors, links, table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding, ["the", "of"], mode=mode)


@query()
def retrieve_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval: vectors, text, entities and relations, merged and shaped; held against its steps one by one in the tests."""
    return _retrieval(spark, sf_dir, "mix")


@query()
def retrieval_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and tokens of every leg and stage of the whole retrieval; its seconds are left out, as they differ from run to run."""
    return _retrieval(spark, sf_dir, "mix", explained).drop("seconds")


@query()
def shaped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as lists of fifty, each shaped for a question without a known kind; diversity is sequential, so without SQL: held against a plain version in the tests."""
    from .router import shaped
    from .shaping_queries import _ranked

    rows = _ranked(spark, sf_dir).where("text IS NOT NULL").select("q", F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("doc"), F.col("text").alias("content"), "rank", "score")
    return shaped(rows, "tell me more of the things that are said of it in all", ["the", "with"], 20, 20_000)
