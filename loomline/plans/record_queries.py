"""Extraction records made from documents, suppliers and parts: repaired, parsed, normalised, and turned into texts to search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from .registry import query, table

_BROKEN = ("<|##|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<#>", "<#|>", "<|#>", "<X#|>", "<||#||>", "<|#||#|>", "<||#>", "<|#|>|", "<|#|>")


@query("SELECT doc_id, 'entity<|#|>doc ' || doc_id || '<|#|>' || lang || '<|#|>of ' || source AS record FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def delimiters_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broken delimiter of each form between the fields."""
    form = F.element_at(F.lit(list(_BROKEN)), (F.col("doc_id") % len(_BROKEN) + 1).cast("int"))
    record = F.concat(F.lit("entity"), form, F.lit("doc "), "doc_id", form, "lang", F.lit("<|#|>"), F.lit("of "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", R.repaired(record).alias("record")).where("record IS NOT NULL")


_KINDS = "['Person', 'team', 'Dose', 'martian', 'a/b', '']"


@query(f"""WITH r AS (SELECT s_suppkey, ' "' || s_name || '" ' AS name, {_KINDS}[s_suppkey % 6 + 1] AS kind, CASE WHEN s_suppkey % 11 > 0 THEN 'supplies <br>parts' ELSE '' END AS text FROM supplier)
SELECT s_suppkey, trim(name, ' "') AS name, CASE kind WHEN 'Person' THEN 'person' WHEN 'team' THEN 'organization' WHEN 'Dose' THEN 'data' ELSE 'concept' END AS type, 'supplies parts' AS description FROM r WHERE kind NOT IN ('a/b', '') AND text <> '' AND s_suppkey % 7 <> 3""")
def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    kind = F.element_at(F.lit(["Person", "team", "Dose", "martian", "a/b", "-"]), (k % 6 + 1).cast("int"))
    parts = [F.lit("entity"), F.concat(F.lit(' "'), "s_name", F.lit('" ')), F.when(kind == "-", "").otherwise(kind), F.when(k % 11 > 0, "supplies <br>parts").otherwise("")]
    record = F.concat_ws(R.DELIMITER, *parts, F.when(k % 7 == 3, "more"))
    return R.entity_records(s.select("s_suppkey", record.alias("record")), "record", ["s_suppkey"])


_CANONICAL = {"supply": "supplies", "supplied": "supplies", "sells to": "sells to", "owns": "owns", "own": "owns"}


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS a, 's' || l_suppkey AS b, l_linenumber % 5 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 1 THEN b ELSE a END AS src, CASE WHEN k = 1 THEN a ELSE b END AS tgt, CASE k WHEN 0 THEN 'supplies,owns' WHEN 1 THEN 'represents' WHEN 2 THEN 'supplies,owns' WHEN 3 THEN 'sells to' ELSE 'odd' END AS keywords,
  CASE WHEN k = 2 THEN '' ELSE 'in the order' END AS description, CASE WHEN k = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM r WHERE k <> 4 OR l_linenumber % 2 = 0""")
def relation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 5
    words = F.element_at(F.lit([" Supply, own.", "Was represented by", "supplied and owns", "sells to then runs", "odd"]), (k + 1).cast("int"))
    record = F.concat_ws(R.DELIMITER, F.lit("relation"), F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), words, F.when(k == 2, "'0.5'").otherwise("in the order"), F.when((k == 4) & (F.col("l_linenumber") % 2 == 1), "more"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", record.alias("record"))
    return R.relation_records(rows, "record", ["l_orderkey", "l_linenumber"], _CANONICAL).withColumn("keywords", F.array_join("keywords", ","))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'relation with 4 fields' WHEN 2 THEN 'entity with 5 fields' WHEN 3 THEN 'unknown kind' END AS reason FROM documents) GROUP BY 1""")
def malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["entity<|#|>a<|#|>b<|#|>c", "relation<|#|>a<|#|>uses<|#|>b", "entity<|#|>a<|#|>b<|#|>c<|#|>d", "note<|#|>a", "relation<|#|>a<|#|>b<|#|>c<|#|>d"]
    record = F.element_at(F.lit(forms), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").groupBy(R.malformed(record).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id, lang, 1 + len(string_split(split_part(coalesce(text, ''), '.', 1), ' ')) AS n FROM documents)
SELECT doc_id, CASE lang WHEN 'en' THEN CASE WHEN n <> 4 THEN 'entity with ' || n || ' fields' END WHEN 'de' THEN CASE WHEN n <> 5 THEN 'relation with ' || n || ' fields' END ELSE 'unknown kind' END AS reason FROM r""")
def malformed_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a document's first sentence as the fields of a record whose kind is by language."""
    kind = F.when(F.col("lang") == "en", "Entity").when(F.col("lang") == "de", " RELATIONSHIP").otherwise(F.coalesce("lang", F.lit("")))
    words = F.split(F.substring_index(F.coalesce("text", F.lit("")), ".", 1), " ", -1)
    return table(spark, sf_dir, "documents").select("doc_id", R.malformed(F.concat_ws(R.DELIMITER, kind, words)).alias("reason"))


@query("SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN s_name WHEN 1 THEN s_name WHEN 2 THEN 'AB9 x' WHEN 3 THEN '甲乙c' WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN 'it is \"so\"' ELSE '甲乙' END AS name FROM supplier")
def names_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, name = F.col("s_suppkey") % 8, F.col("s_name")
    raw = F.when(m == 0, F.concat(F.lit("'"), name, F.lit("'"))).when(m == 1, F.concat(F.lit("“<p>"), name, F.lit("</P>”"))).when(m == 2, "ＡＢ９　x").when(m == 3, "甲 乙 c").when(m == 4, " 12 ").when(m == 5, "1.2.3").when(m == 6, 'it is "so"').otherwise("甲\"乙'")
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.normalized_name(raw, True).alias("name"))


@query(r"""SELECT doc_id, len(p)::INT AS parts, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\. |, |\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents)""")
def split_at_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.split_at(F.col("text"), [". ", ", ", "\n"])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("parts"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query(r"SELECT p_partkey, regexp_matches(x, '^[-+]?[0-9]*\.?[0-9]+$') AS is_float FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '-' || p_size || '.5' WHEN 2 THEN '.5' WHEN 3 THEN p_name ELSE '1.' END AS x FROM part)")
def float_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    x = F.when(m == 0, size).when(m == 1, F.concat(F.lit("-"), size, F.lit(".5"))).when(m == 2, ".5").when(m == 3, F.col("p_name")).otherwise("1.")
    return table(spark, sf_dir, "part").select("p_partkey", R.is_float(x).alias("is_float"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'no evidence that it leads to this' WHEN 1 THEN 'limited evidence' WHEN 2 THEN 'it affects that' ELSE 'plain affection' END AS t FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'negative_evidence' WHEN 1 THEN 'insufficient_evidence' ELSE 'affirmative' END AS polarity, CASE doc_id % 4 WHEN 0 THEN 'consequence,evidence,impact' WHEN 1 THEN 'evidence' WHEN 2 THEN 'consequence,impact' ELSE '' END AS facets FROM d""")
def relation_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.element_at(F.lit(["no evidence that it leads to this", "limited evidence", "it affects that", "plain affection"]), (F.col("doc_id") % 4 + 1).cast("int"))
    s = R.semantics(F.lit("Uses"), t)
    return table(spark, sf_dir, "documents").select("doc_id", s.polarity.alias("polarity"), F.array_join(s.facets, ",").alias("facets"))


@query(r"""WITH w AS (SELECT p_partkey, lower(p_brand) AS k, 'part ' || p_partkey AS a, 'type ' || p_type AS b, p_name || ' causes no evidence' AS d FROM part),
h AS (SELECT *, list_filter(regexp_extract_all(lower(k || ' ' || a || ' ' || b || ' ' || d), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('and', 'for', 'from', 'into', 'onto', 'the', 'to', 'with')) AS ws FROM w),
u AS (SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:24] AS hs FROM h)
SELECT p_partkey, md5(k || chr(9) || a || chr(10) || b || chr(10) || d || chr(10) || 'relation: ' || a || ' --' || k || '--> ' || b || chr(10) || 'source_entity: ' || a || chr(10) || 'target_entity: ' || b || chr(10) || 'predicate: ' || k || chr(10)
  || 'polarity: negative_evidence' || chr(10) || 'facets: consequence, evidence, impact' || chr(10) || 'search_hints: ' || array_to_string(hs, ' ')) AS digest, a AS src, b AS tgt, d AS description, k AS keywords FROM u""")
def relation_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each relation, and what is read back from it."""
    a, b, k = F.concat(F.lit("part "), "p_partkey"), F.concat(F.lit("type "), "p_type"), F.lower("p_brand")
    t = table(spark, sf_dir, "part").select("p_partkey", R.relation_text(a, b, k, F.concat("p_name", F.lit(" causes no evidence")), k).alias("t"))
    p = R.parsed_relation_text(F.col("t"))
    return t.select("p_partkey", F.md5("t").alias("digest"), p.src.alias("src"), p.tgt.alias("tgt"), p.description.alias("description"), p.keywords.alias("keywords"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Product' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Unknown' ELSE 'Part' END AS type FROM part")
def types_in_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    content = F.concat("p_name", F.when(m == 0, "\n Product: a thing: of use").when(m == 1, "\nno type here").when(m == 2, "\ntwo words: x").otherwise("\nPart:\nmore: text"))
    return table(spark, sf_dir, "part").select("p_partkey", R.type_in_content(content).alias("type"))


@query("SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt FROM lineitem")
def relation_keys_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("p"), "l_partkey", F.lit("<SEP>s"), "l_suppkey")
    keys = table(spark, sf_dir, "lineitem").select(key.alias("k")).distinct().union(spark.createDataFrame([("one",), ("a<SEP>b<SEP>c",)], "k string"))
    return keys.select(R.pair_of_key(F.col("k")).alias("p")).where("p IS NOT NULL").select("p.*")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN s_name END AS name, CASE WHEN s_suppkey % 4 < 3 THEN s_acctbal END AS balance FROM supplier")
def json_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as models answer: fenced, inside a sentence, plain, and broken."""
    m = F.col("s_suppkey") % 4
    body = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    said = F.when(m == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(m == 1, F.concat(F.lit("It is "), body, F.lit(" as asked"))).when(m == 2, body).otherwise("{broken")
    v = R.recovered_json(said, "name string, balance double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", v.getField("name").alias("name"), v.getField("balance").alias("balance"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '.pdf' WHEN 1 THEN 'etcpasswd' WHEN 2 THEN NULL WHEN 3 THEN 'a b' ELSE lang || '.txt' END AS name FROM documents")
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 5
    raw = F.when(m == 0, F.concat(F.lit(" "), "source", F.lit(".pdf. "))).when(m == 1, "../../etc/passwd").when(m == 2, " .. ").when(m == 3, "a\u0007 b\u007f").otherwise(F.concat(F.lit("..\\"), "lang", F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", R.safe_filename(raw).alias("name"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN c_mktsegment WHEN 2 THEN NULL ELSE 'w_' || c_nationkey END AS workspace, CASE c_custkey % 3 WHEN 0 THEN 't_' || c_nationkey WHEN 1 THEN NULL ELSE c_mktsegment END AS identifier FROM customer""")
def validated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = F.col("c_custkey") % 4, F.col("c_custkey") % 3
    space = F.when(m == 0, "  ").when(m == 1, F.concat(F.lit(" "), "c_mktsegment")).when(m == 2, "my-space").otherwise(F.concat(F.lit("w_"), "c_nationkey"))
    name = F.when(n == 0, F.concat(F.lit("t_"), "c_nationkey")).when(n == 1, F.concat("c_nationkey", F.lit("x; DROP"))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.workspace(space).alias("workspace"), R.identifier(name).alias("identifier"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda s: trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(s, ' '), '<[^>]+>', ' ', 'g'), '^#{1,6}\s*', ''), '^[-*+]\s+', ''), ' '), '\s+', ' ', 'g'), ' ')), lambda s: NOT regexp_matches(s, '^[|:\-]*$')) AS l, text FROM documents),
w AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ' ') ELSE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') END AS w FROM l), h AS (SELECT *, substring(w, 1, 250) AS h, regexp_replace(substring(w, 1, 250), ' [^ ]*$', '') AS c FROM w)
SELECT doc_id, CASE WHEN length(w) <= 250 THEN w ELSE regexp_replace(CASE WHEN contains(h, ' ') AND length(c) >= 150 THEN c ELSE h END, '[ ,;:]+$', '') || '...' END AS summary FROM h""")
def content_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page mark and a heading's sign before each text do not show."""
    text = F.concat(F.lit("<!-- PAGE 3 -->\n## "), F.ltrim("text"))
    return table(spark, sf_dir, "documents").select("doc_id", R.content_summary(F.when(F.trim("text") != "", text).otherwise(F.col("text"))).alias("summary"))


@query("""WITH t AS (SELECT p_partkey, lower(p_type || ' ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' poses risks' WHEN 1 THEN ' with limited evidence, due to size' ELSE '' END) AS t FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 4 < 2 THEN 'impact consequence effect result outcome' END, CASE WHEN p_partkey % 4 = 1 THEN 'negative evidence no evidence insufficient evidence not supported' END,
  CASE WHEN regexp_matches(t, '\\b(?:small|large)\\b') THEN 'size measure' END, CASE WHEN contains(t, 'hot gear') OR regexp_matches(t, '\\beconomy\\b') THEN 'cheap part' END], lambda x: x IS NOT NULL), '; ') AS hints FROM t""")
def relation_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of impact and evidence, and by two rules."""
    m = F.col("p_partkey") % 4
    text = F.concat("p_name", F.when(m == 0, " poses risks").when(m == 1, " with limited evidence, due to size").otherwise(""))
    rules = [(("small", "large"), "size measure"), (("hot gear", "economy"), "cheap part")]
    return table(spark, sf_dir, "part").select("p_partkey", R.semantic_hints(F.col("p_type"), text, rules).alias("hints"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/' ELSE '/../x' END AS tail FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '^[a-zA-Z0-9_-]+$') THEN path END AS id, CASE WHEN page_id % 3 = 0 AND NOT contains(path, '//') AND NOT ends_with(path, '/') THEN path END AS key,
  CASE WHEN page_id % 3 < 2 AND NOT contains(path || tail, '//') THEN rtrim(path, '/') || '/' END AS prefix, CASE WHEN len(path) BETWEEN 10 AND 40 THEN len(path)::DOUBLE END AS length FROM p""")
def validated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as ids, keys and prefixes of an object store, and their lengths as bounded numbers."""
    tail = F.expr("CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/' ELSE '/../x' END")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", R.document_id(F.concat(F.lit(" "), path)).alias("id"), R.object_key(F.concat(path, tail)).alias("key"), R.object_prefix(F.concat(path, tail, F.lit("\n"))).alias("prefix"), R.number(F.length(path).cast("string"), 10, 40).alias("length"))
