"""Operational metrics over events, and retrieval metrics over documents with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import query, table


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH f AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY ORDER BY ts DESC, event_id LIMIT 1000) SELECT event_type AS mode, count(*) AS n, round(count(*) / (SELECT count(*) FROM f)::DOUBLE, 6) AS share FROM f GROUP BY 1""")
def mode_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's events, at most 1000: how often each mode."""
    recent = E.recent(table(spark, sf_dir, "events"), "ts", "event_id", "INTERVAL '1' DAY", 1000)
    total = recent.agg(F.count("*").alias("_t"))
    return recent.groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("mode", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


@query("SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("SELECT CASE WHEN value < 10 THEN 'fast' WHEN value < 50 THEN 'normal' WHEN value < 100 THEN 'slow' ELSE 'very slow' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = E.bucket(F.col("value"), [(10, "fast"), (50, "normal"), (100, "slow")], "very slow")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT user_id, count(*) FILTER (WHERE new) AS sessions, count(*) AS events FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) AS new FROM events) GROUP BY 1")
def sessions_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "INTERVAL '30' MINUTE")


_RET = """ret AS (SELECT (doc_id % 50)::INT AS q, doc_id, source, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents),
gold AS (SELECT (doc_id % 50)::INT AS q, doc_id FROM labels WHERE quality = 0)"""


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).cast("int").alias("q"), "doc_id", "source", "n_chars")
    docs = docs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n_chars"), "doc_id"))).drop("n_chars")
    return docs, table(spark, sf_dir, "labels").where("quality = 0").select((F.col("doc_id") % 50).cast("int").alias("q"), "doc_id")


@query(f"""WITH {_RET}, g AS (SELECT q, count(*) AS n_gold FROM gold GROUP BY q), h AS (SELECT ret.q, min(rank) AS first, count(*) FILTER (WHERE rank <= 5) AS in5 FROM ret JOIN gold ON ret.q = gold.q AND ret.doc_id = gold.doc_id GROUP BY 1)
SELECT q, n_gold, (coalesce(first, 999999) <= 5)::INT AS hit_5, round(coalesce(in5, 0) / n_gold::DOUBLE, 6) AS recall_5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM g LEFT JOIN h USING (q)""")
def retrieval_hit_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.retrieval(*_retrieved(spark, sf_dir), "q", "doc_id", "rank", 5)


@query(f"""WITH {_RET}, first AS (SELECT q, source, min(rank) AS r FROM ret GROUP BY 1, 2), d AS (SELECT q, source, row_number() OVER (PARTITION BY q ORDER BY r)::INT AS rank FROM first),
gs AS (SELECT DISTINCT ret.q, source FROM ret JOIN gold USING (q, doc_id)), n AS (SELECT q, count(*) AS n_gold FROM gs GROUP BY q), h AS (SELECT d.q, min(rank) AS first, count(*) FILTER (WHERE rank <= 3) AS inn FROM d JOIN gs USING (q, source) GROUP BY 1)
SELECT q, n_gold, (coalesce(first, 999999) <= 3)::INT AS hit_3, round(coalesce(inn, 0) / n_gold::DOUBLE, 6) AS recall_3, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM n LEFT JOIN h USING (q)""")
def retrieval_doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over documents (sources): the first of each in a list counts."""
    ret, gold = _retrieved(spark, sf_dir)
    gold = ret.join(gold, ["q", "doc_id"]).select("q", "source").distinct()
    return E.retrieval(E.first_places(ret, "q", "source", "rank"), gold, "q", "source", "rank", 3)


@query("""WITH m AS (SELECT event_type, avg(value) FILTER (WHERE user_id % 2 = 0) AS a, avg(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS change, round((b - a) / a * 100, 4) AS percent, abs((b - a) / a * 100) > 5 AS notable, CASE WHEN b > a THEN 'better' WHEN b < a THEN 'worse' ELSE 'same' END AS verdict FROM m""")
def ab_metric_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("arm", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    return E.compare(e, "event_type", "arm", "value")


@query("SELECT lang AS intent, count(*) AS n, round(avg((quality = 1 AND toxic = 0)::INT), 6) AS perfect FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def intent_perfect_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.perfect_rate(rows.withColumnRenamed("lang", "intent"), "intent", [F.col("quality") == 1, F.col("toxic") == 0])


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), p AS (SELECT user_id, max(v) FILTER (WHERE event_type = 'click') AS click, max(v) FILTER (WHERE event_type = 'view') AS view FROM m GROUP BY 1)
SELECT user_id, round(click, 6) AS click, round(view, 6) AS view, CASE WHEN coalesce(click, -1e300) >= coalesce(view, -1e300) AND click IS NOT NULL THEN 'click' WHEN view IS NOT NULL THEN 'view' END AS best FROM p""")
def mode_comparison_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_mode(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view"])


@query(f"WITH {_RET} SELECT q, substring(sha1(string_agg(source || '#' || CAST(doc_id AS VARCHAR), '|' ORDER BY rank)), 1, 16) AS fingerprint FROM ret WHERE rank <= 10 GROUP BY q")
def retrieval_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fingerprint(_retrieved(spark, sf_dir)[0].where("rank <= 10"), "q", F.concat_ws("#", "source", F.col("doc_id").cast("string")), "rank")


@query("SELECT source, round(avg(CASE WHEN n_chars % 7 <> 0 THEN n_chars::DOUBLE END), 6) AS mean, min(CASE WHEN n_chars % 7 <> 0 THEN n_chars::DOUBLE END) AS least, max(CASE WHEN n_chars % 7 <> 0 THEN n_chars::DOUBLE END) AS most, round(avg((n_chars % 7 <> 0)::INT), 6) AS success FROM documents GROUP BY 1")
def nan_skipping_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("x", F.when(F.col("n_chars") % 7 == 0, float("nan")).otherwise(F.col("n_chars").cast("double")))
    return E.without_nan(rows, "source", "x")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(DISTINCT user_id) AS users, CAST(sum(length(props)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def token_usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(day.alias("day"), "event_type").agg(F.countDistinct("user_id").alias("users"), F.sum(F.length("props")).cast("long").alias("tokens"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS hits, round(avg((event_id % 3 = 0)::INT), 6) AS rate FROM events GROUP BY 1")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hit_rate(table(spark, sf_dir, "events").withColumn("hit", F.col("event_id") % 3 == 0), ["event_type"], "hit")


_AT = f"""WITH {_RET}, n AS (SELECT q, count(*) AS n FROM gold GROUP BY q), h AS (SELECT ret.q, min(rank) AS first, count(*) FILTER (WHERE rank <= 1) AS i1, count(*) FILTER (WHERE rank <= 5) AS i5, count(*) FILTER (WHERE rank <= 20) AS i20 FROM ret JOIN gold ON ret.q = gold.q AND ret.doc_id = gold.doc_id GROUP BY 1),
r AS (SELECT q, CASE WHEN n > 0 THEN (coalesce(first, 999999) <= 1)::INT END AS hit_1, CASE WHEN n > 0 THEN (coalesce(first, 999999) <= 5)::INT END AS hit_5, CASE WHEN n > 0 THEN (coalesce(first, 999999) <= 20)::INT END AS hit_20,
  CASE WHEN n > 0 THEN round(coalesce(i1, 0) / n::DOUBLE, 6) END AS recall_1, CASE WHEN n > 0 THEN round(coalesce(i5, 0) / n::DOUBLE, 6) END AS recall_5, CASE WHEN n > 0 THEN round(coalesce(i20, 0) / n::DOUBLE, 6) END AS recall_20,
  CASE WHEN n > 0 THEN round(coalesce(1.0::DOUBLE / first, 0), 6) END AS mrr FROM (SELECT DISTINCT q FROM ret) LEFT JOIN n USING (q) LEFT JOIN h USING (q))"""
_COLUMNS = ("hit_1", "hit_5", "hit_20", "recall_1", "recall_5", "recall_20", "mrr")


@query(_AT + " SELECT * FROM r")
def retrieval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a question, null where it has no gold."""
    return E.retrieval_at(*_retrieved(spark, sf_dir), "q", "doc_id", "rank", [1, 5, 20])


@query(_AT + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _COLUMNS) + ", count(*) AS n FROM r")
def retrieval_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.averages(E.retrieval_at(*_retrieved(spark, sf_dir), "q", "doc_id", "rank", [1, 5, 20]), ["q"])


_EV = "e AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS weight, bool_or(l_returnflag = 'R') AS has FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_EV} SELECT count(*) AS relations_total, count(*) FILTER (WHERE has) AS relations_with_evidence, round(avg(has::INT) * 100, 4) AS evidence_coverage_pct FROM e")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)[0]


@query(f"WITH {_EV} SELECT l_partkey, l_suppkey, weight FROM e WHERE NOT has AND weight >= 40 ORDER BY weight DESC, l_partkey, l_suppkey LIMIT 20")
def unsupported_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)[1]


def _coverage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Returned lines are the evidence of an edge."""
    li = table(spark, sf_dir, "lineitem")
    edges = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    return E.coverage(edges, li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"], "weight", 40, 20)


@query(r"""SELECT page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '^[^:]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)/*$', 1)) || '' AS name FROM pages WHERE regexp_extract(regexp_replace(regexp_replace(url, '^[^:]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)/*$', 1) <> ''""")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", E.document_name(F.col("url")).alias("name")).where("name IS NOT NULL")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::INT AS matched, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::INT AS missed, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END::INT AS extra FROM documents")
def expected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ by path, case, ending and signs are the same document."""
    n = F.col("doc_id").cast("string")
    expected = F.array(F.concat(F.lit("s3://b/in/My%20Report-"), n, F.lit(".pdf")), F.concat(F.lit("Other_"), n, F.lit(".docx")))
    retrieved = F.array(F.concat(F.lit("my report-"), n, F.lit(".md")), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("c:\\x\\OTHER "), n)).otherwise("third.txt"), F.lit("fourth.txt"))
    return table(spark, sf_dir, "documents").select("doc_id", E.document_sets(expected, retrieved).alias("s")).select("doc_id", "s.*")


@query("""WITH p AS (SELECT l_partkey, list(DISTINCT l_suppkey) AS e, list(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25) AS f FROM lineitem GROUP BY 1)
SELECT l_partkey, CASE WHEN len(f) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, round(coalesce(len(f), 0) / len(e)::DOUBLE, 6) AS recall, 0.0::DOUBLE AS noise FROM p""")
def set_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("e"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).alias("f"))
    return p.select("l_partkey", E.set_quality(F.col("e"), F.col("f")).alias("q")).select("l_partkey", "q.*")


_STOP = "(" + ", ".join(f"'{w}'" for w in E.KEYWORD_STOPWORDS) + ")"


@query(rf"""WITH w AS (SELECT b.item_id, lower(d.text) AS content, list_filter(regexp_extract_all(lower(b.text), '[a-z0-9][\p{{L}}\p{{N}}_\-]*'), lambda w: length(w) > 2 AND w NOT IN {_STOP}) AS ws FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
k AS (SELECT item_id, content, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:8] AS k FROM w) SELECT item_id, len(k)::INT AS keywords, len(list_filter(k, lambda x: contains(content, x)))::INT AS hits FROM k""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each benchmark item in the document of its number."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return rows.select("item_id", E.keyword_hits(F.col("expected"), F.col("text")).alias("k")).select("item_id", "k.*")


@query("SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def rolling_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user did in the last 3600 seconds, at every event."""
    return E.rolling(table(spark, sf_dir, "events"), "ts", ["user_id"], 3600, "value").select("event_id", "n", "mean")


@query(r"SELECT source, count(*) AS calls, CAST(sum(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/-][a-z0-9]+)*'))) AS BIGINT) AS tokens, CAST(sum(ceil(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/-][a-z0-9]+)*')) / 10.0)) AS BIGINT) AS completion FROM documents GROUP BY 1")
def token_usage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts are the texts, answers a tenth as long."""
    from ..functions import texts as T

    n = F.size(T.tokens(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("calls"), F.sum(n).alias("tokens"), F.sum(F.ceil(n / 10)).alias("completion"))
