"""Repairs, validators, scores, orders, edits, traces and the stream of answers, against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.functions import answers, records, texts
from loomline.operators import aliases, etl, graph, shaping
from loomline.operators.tracing import Trace
from loomline.plans import router
from loomline.streaming import answers as stream

# Records


def test_delimiters_are_mended_form_by_form(spark):
    """Every string of up to five signs: each form in turn, as Python's expressions do it."""
    rows = ["".join(x) for n in range(1, 6) for x in itertools.product("<|#>X:", repeat=n)] + ["<|\\#|>", "a<|\\#|>b", "<\n|#|>", "<|##|>x<|#||#|>", "||#||", "<||#||>", "", "entity<|#|>a<|>b"]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    for core, delimiter in (("#", "<|#|>"), ("X", "<|$1|>")):
        got = {r.r: r.m for r in df.select("r", records.repaired(F.col("r"), core, delimiter).alias("m")).collect()}
        for r in rows:
            want = r
            for form in records.BROKEN_FORMS:
                want = re.sub(form.replace("CORE", re.escape(core)), lambda _: delimiter, want)
            assert got[r] == want, r
    assert df.select(records.repaired(F.col("r"), "")).first()[0] == "<"


def test_and_comes_before_then(spark):
    df = spark.createDataFrame([(["a then b and c"],), (["a then b"],), (["x and a then b"],), (None,)], "k array<string>")
    got = [r[0] for r in df.select(records.predicates(F.col("k"), {"c": "c", "b": "b"})).collect()]
    assert got == [["a then b", "c"], ["a", "b"], ["x"], None]


def test_validators(spark):
    def one(f, values, **more):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"), **more)).collect()]

    assert one(records.document_id, [" a_b-1\n", "a b", "", None, "x" * 128, "x" * 129, "é", "a\nb", "."]) == ["a_b-1", None, None, None, "x" * 128, None, None, None, None]
    assert one(records.number, ["1", " 2.5 ", "x", None, "-1", "11", "NaN"], least=0, most=10)[:6] == [1.0, 2.5, None, None, None, None]
    keys = ["a/b.txt", " a ", "/a", "a/", "a//b", "a/../b", "./a", "a\\b", "a\x01", "", None, "a/.b"]
    assert one(records.object_key, keys) == ["a/b.txt", "a", None, None, None, None, None, None, None, None, None, "a/.b"]
    assert one(records.object_prefix, ["a/b", "a/b/", "", None, "  ", "/", "a//", "..", "a/./b"]) == ["a/b/", "a/b/", "", "", "", None, None, None, None]


def test_hints(spark):
    df = spark.createDataFrame([("Leads To", "no evidence of it"), ("uses", "a pump"), (None, None), ("riskto", "risk to life")], "k string, d string")
    rules = [(("pump",), "machine"), (("a pump", "uses"), "tool"), (("life",), "machine")]
    got = [r[0] for r in df.select(records.semantic_hints(F.col("k"), F.col("d"), rules)).collect()]
    assert got == ["impact consequence effect result outcome; negative evidence no evidence insufficient evidence not supported", "machine; tool", "", "impact consequence effect result outcome; machine"]


def test_entities_of_html(spark):
    rows = ["a &amp;lt; b &eacute;&#x41;&#66; &hellip;", "no entity", None, "&nosuch; & &copy", " &#xD800;x\x07 "]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(texts.sanitized(F.col("t"))).collect()]
    assert got == ["a &lt; b éAB …", "no entity", None, "&nosuch; & ©", "�x"]
    broken = spark.sql("SELECT cast(X'61EDA08062' AS string) AS t").select(texts.sanitized(F.col("t")).alias("t"))
    assert broken.select(F.is_valid_utf8("t")).first()[0]


# Scores and orders


def test_answer_scores(spark):
    rows = [
        ("How long do shipments take?", "10-12 weeks by ship", 1.5, 0.0), ("How long?", "some weeks", 0.0, 0.0), ("lead-time of the depot shipment", "the Depot: 3 days  lead, shipped in packaging", 2.5, 0.0),
        ("What impact on the Physical  flow", "Impact: the physical flow; wrong NDC", 0.0, 1.75), ("who", "3 days; results", 0.0, 0.0), (None, "3 days", 0.0, 0.0), ("How long", None, 0.0, 0.0), ("impact of how long", "results in 2 mths", 1.0, 1.0),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "q string, t string")
    got = df.select(answers.answer_match(F.col("q"), F.col("t"), answers.DURATION), answers.answer_match(F.col("q"), F.col("t"), answers.IMPACT)).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_answers_lead_the_order(spark):
    rows = [(0, i, f"d{i}", t, i + 1, 1.0 / (i + 1)) for i, t in enumerate(["of the thing", "it took 3 weeks", "the thing"])]
    df = spark.createDataFrame(rows, "q int, chunk_id int, doc string, content string, rank int, score double")
    got = {r.chunk_id: r["rank"] for r in router.shaped(df, "how long did it take", ["the"], 5).collect()}
    assert got[1] == 1
    assert {r.chunk_id: r["rank"] for r in router.shaped(df, "tell me of it", ["the"], 5).collect()}[1] != 1


def test_names_in_order(spark):
    names = ["北京", "上海", "广州", "重庆", "阿里", "Éclair", "eclair", "zebra", "Zoo", "äpfel", "apple", None, "", "Eclair"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").repartition(5)
    got = [r.n for r in sorted(shaping.ordered_names(df, "n", "i").collect(), key=lambda r: r.place)]
    assert got[:7] == [None, "", "阿里", "北京", "重庆", "广州", "上海"] and [x.lower() for x in got[7:9]] == ["äpfel", "apple"] and got[-2:] == ["zebra", "Zoo"]
    assert {x for x in got[9:12]} == {"eclair", "Eclair", "Éclair"}
    big = spark.range(5000).select(F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(700))).alias("n"), "id").repartition(9)
    placed = shaping.ordered_names(big, "n", "id").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 5001))
    assert [(r.n, r.id) for r in placed] == sorted((r.n, r.id) for r in placed)


def test_unique_names_of_a_hot_name(spark):
    files = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "same.tar.gz").otherwise(F.concat(F.lit("f"), F.col("id") % 100)).alias("name"), F.col("id").alias("page"))
    got = etl.unique_names(files.repartition(8), "name", "page").collect()
    want, n = {}, {}
    for r in sorted(got, key=lambda r: r.page):
        k = n.get(r.name, 0)
        n[r.name] = k + 1
        stem, dot, end = r.name.rpartition(".")
        want[r.page] = r.name if not k else f"{stem}_{k}{dot}{end}" if dot else f"{r.name}_{k}"
    assert {r.page: r.unique_name for r in got} == want


# Graph and aliases


def test_relations_are_edited_either_way(spark):
    edges = spark.createDataFrame([("a", "b", {"w": "1", "k": "x"}, 7), ("b", "c", None, 8)], "src string, tgt string, properties map<string,string>, n int")
    edits = spark.createDataFrame([("b", "a", {"k": "y"}), ("b", "c", {"new": "1"}), ("x", "y", {"k": "z"}), ("c", "c", {})], "src string, tgt string, properties map<string,string>")
    out, lost = graph.edited_relations(edges, edits)
    assert {(r.src, r.tgt, r.n): r.properties for r in out.collect()} == {("a", "b", 7): {"w": "1", "k": "y"}, ("b", "c", 8): {"new": "1"}}
    assert sorted((r.src, r.tgt) for r in lost.collect()) == [("c", "c"), ("x", "y")]


def test_filters_by_rules(spark):
    rules = spark.createDataFrame([(1, "Acme", ["acme partner", "ACM"]), (2, "Alliance", ["big alliance"]), (3, "Zed", None)], "position int, canonical string, aliases array<string>")
    asked = ["about ACM, please", "the acme  partner", "our alliance", "a big alliance", "zed and acme", "nothing", "", None, "acmes"]
    got = {r.q: r.entity for r in aliases.entity_filters(spark.createDataFrame([(q,) for q in asked], "q string"), rules, "q").collect()}
    assert got == {"about ACM, please": "Acme", "the acme  partner": "Acme", "our alliance": "Alliance", "a big alliance": "Alliance", "zed and acme": "Acme", "nothing": None, "": None, None: None, "acmes": None}


# Traces


def test_traces_count_what_is_there(spark, sf):
    trace = Trace()
    df = spark.range(100, numPartitions=4)
    kept = trace.cut("all", df, F.col("id"))
    few = trace.cut("few", kept.where("id < 7"))
    none = trace.cut("none", few.where("false"), F.col("id"))
    assert kept.count() == 100 and few.count() == 7 and none.count() == 0
    assert [s[:3] for s in trace.stages] == [("all", 100, 4950), ("few", 7, 0), ("none", 0, 0)]
    rows = trace.frame(spark).collect()
    assert [r.position for r in rows] == [0, 1, 2] and all(r.seconds >= 0 for r in rows)


def test_explained_retrieval(spark, sf):
    from loomline.plans.alias_queries import _retrieval

    rows = {r.stage: r for r in _retrieval(spark, sf, "local", router.explained).collect()}
    # a comparison always mixes
    assert {"entities", "relations", "vector", "text", "entity", "relation", "merged", "lexical", "per_document", "diversity", "chunks", "answerable"} == set(rows)
    out = _retrieval(spark, sf, "mix")
    assert rows["chunks"].rows == out.count() and rows["answerable"].rows == 1 and rows["vector"].rows == 20
    none = router.explained("tell me", *[spark.createDataFrame([], s) for s in ("chunk_id int, doc string, content string", "chunk_id int, embedding array<double>", "entity int, chunk_id int")], [1.0], [], mode="bypass")
    assert [tuple(r)[1:4] for r in none.collect()] == [("answerable", 0, 0)]


# Streams of answers


def plain_answer(text):
    text = re.sub(r"(?s)<think>.*?</think>", "", text)
    return re.sub(r"(?s)<think>.*$", "", text).strip(" ")


def cut_up(rng, text):
    at = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(0, 8)))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]


def text_of(rng):
    return "".join(rng.choice(["<think>", "</think>", "word ", " ", "a<b", "<th", "ink>", "</", "\n", "<<think>", "end."]) for _ in range(rng.randrange(0, 9)))


def test_any_cut_gives_the_same_answer():
    rng = random.Random(1)
    tried = 0
    while tried < 4000:
        text = text_of(rng)
        if "<think>" in re.sub(r"(?s)<think>.*?</think>", "\0", text).replace("\0", "") and "<think>" not in re.sub(r"(?s)<think>.*?</think>", "\0", text):
            continue  # a mark that only a removed block puts together
        tried += 1
        state, shown = stream.START, ""
        for part in cut_up(rng, text):
            state, more = stream.feed(state, part)
            shown += more
        assert shown + stream.finish(state) == plain_answer(text), text


def test_answers_as_a_stream(spark, tmp_path):
    rng = random.Random(2)
    whole = {f"q{i}": "  Hello <think>hidden " + "x " * i + "</think>world, " + "y" * i + "<think>open" * (i % 2) + " ." * (i % 3) for i in range(12)}
    batches = [[], [], []]
    for name, text in whole.items():
        parts = cut_up(rng, text)
        cuts = sorted(rng.randrange(len(parts) + 1) for _ in range(2))
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(parts)], strict=True)):
            batches[n] += [(name, k, parts[k] or None, False) for k in range(a, b)]
        batches[2].append((name, len(parts), None, True))
    schema = "answer string, position long, token string, done boolean"
    for rows in batches:
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = stream.visible(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = dict.fromkeys(whole, "")
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.position):
        got[r.answer] = got.get(r.answer, "") + r.text
    assert got == {k: plain_answer(v) for k, v in whole.items()}
