"""Queries whose work once grew faster than their tables, or was done several times over."""

from __future__ import annotations

import numpy as np
import pytest
from compare import assert_same, spark_rows
from pyspark.sql import functions as F

from loomline.functions import records
from loomline.operators import citations, fulltext, graph, search, shaping, vector_index
from loomline.plans.registry import QUERIES, SQL


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_carry_what_is_told_of_a_file_and_not_its_contents(spark, sf):
    plan = _optimized(QUERIES["graph_reference_list"](spark, sf))
    assert "md5" not in plan[: plan.index("Join")]  # once a file, below the join with the references
    items = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, ""), (2, None), (2, "unknown_source")], "q int, file_path string")
    chunks = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "file_path string, position int, content string")
    both = shaping.graph_references(items, items.where("q = 1 AND file_path = 'b'"), chunks, ["q"])
    assert sorted(tuple(r) for r in both.collect()) == [(1, 1, "a", "entity", 2, ["x", "y"]), (1, 2, "b", "entity+relation", 2, None), (2, 1, "b", "entity", 1, None)]


def test_questions_of_an_approximate_search_meet_groups_of_lists(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16))
    x[1000:1080] = x[7]  # copies, more than the shortlist holds
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    index = vector_index.build(df, str(tmp_path / "i"), "id", list_rows=32, k=3)
    asked = vector_index.usable(df.where("id % 20 = 0 OR id = 7"), "id", "embedding", "cosine").withColumnRenamed("id", "question")
    everywhere = np.ones((1, len(index.rows)), bool)
    group = vector_index._groups(index, 1000)
    met = vector_index._asked_groups(index, asked, lambda far: np.broadcast_to(everywhere, far.shape), group).collect()
    assert len(met) == 151 * (group.max() + 1) < 151 * 6  # not a row for each of the 93 lists
    assert sorted(i for r in met if r.question == 7 for i in r.lists) == np.flatnonzero(index.rows).tolist()
    found = vector_index.search(index, df.where("id % 20 = 0 OR id = 7"), 3, "id", probes=len(index.rows)).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    far = (1 - unit @ unit.T).round(6)
    np.fill_diagonal(far, np.inf)
    near = {(q, i) for q in range(0, 3000, 20) for i in np.lexsort((np.arange(3000), far[q]))[:3]}
    assert len(near & {(r.question, r.id) for r in found}) >= 0.9 * len(near)
    assert [r.id for r in sorted(found, key=lambda r: r["rank"]) if r.question == 7] == [1000, 1001, 1002]


def test_steps_over_records_stand_once_in_a_plan(spark, sf):
    assert _optimized(QUERIES["relation_records"](spark, sf)).count("regexp_replace") < 60  # 144 where names and records were expanded again


def test_plain_names_and_keywords_are_what_all_steps_give(spark):
    names = ["a", "ab1 ", " x", "12", "1.2.3", "1.", "a.1", "it's", "A b", "ab\n", "", None, "“q”", "甲 b", "x" * 99, "12a", "a  b"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(records.normalized_name(F.col("n"), True)).collect()]
    assert got == ["a", "ab1", "x", "", "", "", "a.1", "it's", "A b", "ab\n", "", None, "q", "甲b", "x" * 99, "12a", "a  b"]
    keys = [["own"], ["Own."], ["a,b"], ["a  b "], ["x", "x", "y"], ["p and own"], ["p then q"], [""], [], None, ["a\\,b"], ["l;"], ["a", None], ["w " * 20_000]]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k array<string>").select(records.predicates(F.col("k"), {"own": "owns"})).collect()]
    assert got == [["owns"], ["owns"], ["a", "b"], ["a b"], ["x", "y"], ["p", "owns"], ["p"], [], [], None, ["a", "b"], ["l"], None, [("w " * 20_000).strip()]]


def test_words_of_texts_are_taken_before_texts_are_paired(spark, sf):
    plan = _optimized(QUERIES["blended_support"](spark, sf))
    assert "regexp_extract_all" not in plan[: plan.index("Join")]
    texts = ["Abc äbc abc_d abc1 abcde, ab 𝐀abc 😀xyz xyzä 1abc abc", "ABC", "", None, "_abc abcé éabc qrs\nqrs-tuv"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(citations.overlap_words(F.col("t"))).collect()]
    assert got == [["abc", "abcde", "xyz"], ["abc"], [], None, ["qrs", "tuv"]]
    pairs = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0], texts[0], "abcde", 7)], "s int, v array<double>, w array<double>, st string, ct string, r int")
    assert [tuple(r) for r in citations.supported(pairs, ["s"], "v", "w", "st", "ct", "r").collect()] == [(1, 7, 0.8, 1)]


def test_levels_of_few_nodes_need_no_adjacency(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "y"), ("a", "a")], "src string, tgt string")
    start = spark.createDataFrame([("a",)], "id string")
    made, real = [], graph.Adjacency
    monkeypatch.setattr(graph, "Adjacency", lambda e: made.append(real(e)) or made[-1])
    monkeypatch.setattr(graph, "isinstance", lambda x, kind: False, raising=False)
    want = {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.id: r.level for r in graph.bfs(edges, start, 3)[0].collect()} == want and not made
    monkeypatch.setattr(graph, "NARROW", 0)
    assert {r.id: r.level for r in graph.bfs(edges, start, 3)[0].collect()} == want and len(made) == 1 and not spark.catalog.tableExists(made[0].name)
    nodes, inside = graph.subgraph(start.union(spark.createDataFrame([("zz",)], "id string")), edges)
    assert {r.id: r.db_degree for r in nodes.collect()} == {"a": 3, "zz": 0} and inside.count() == 1


def test_whole_tables_of_places_shuffle_texts_and_not_words(spark, sf):
    plan = QUERIES["positional_table"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "inline" in plan[: plan.index("Exchange")]  # words are made above the shuffle
    rows = [(1, "B a b"), (1, "a"), (2, None), (3, ""), (4, "  ,"), (5, "Äb ab äb"), (None, "z")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert spark_rows(fulltext.whole_positions(df, "id")) == spark_rows(fulltext.positions(df, "id")) != []


def test_inverted_tables_shuffle_texts_and_count_words_within_them(spark, sf, monkeypatch):
    plan = QUERIES["inverted_table"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange") and "Aggregate" not in plan
    monkeypatch.setattr(search, "POSTINGS", 2)
    rows = [(1, "B a b, 1a"), (1, "a c"), (1, None), (2, None), (3, ""), (4, "  ,ä"), (5, "K-x X"), (None, "z z")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    found = search.inverted(df, "id")
    assert found.dtypes == [("term", "string"), ("id", "int"), ("tf", "int"), ("dl", "int")]
    got = {(r.term, r.id): (r.tf, r.dl) for r in found.collect()}
    some = search.inverted(df, "id", terms=["b", "z", "y"]).collect()
    assert len(some) == 2 and {(r.term, r.id): (r.tf, r.dl) for r in some} == {k: got[k] for k in (("b", 1), ("z", None))}
    # a row for a word of an id, whatever the lengths of its texts
    assert found.count() == len(got) == 7 and got.pop(("a", 1))[0] == 2
    assert got == {("b", 1): (2, 4), ("1a", 1): (1, 4), ("c", 1): (1, 2), ("k", 5): (1, 3), ("x", 5): (2, 3), ("z", None): (2, 2)}


def test_sentences_find_few_references_where_they_are(spark, sf, monkeypatch):
    plan = _optimized(QUERIES["citations_fixed"](spark, sf))
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
    texts = ["Red cars drive", "red red CARS on the hill", "the of a", "", None, "äred cars_1 red2 hillé", "drive fast x9 red2", "İred K9 _hill 甲red", "hill.hill,red;drive", "no such"]
    rows = spark.createDataFrame([(i * 4 + q, q, t) for i, t in enumerate(texts) for q in range(4)], "k int, q int, s string").union(spark.createDataFrame([(99, None, "red")], "k int, q int, s string"))
    known = [(0, 30, "red cars"), (0, 4, "cars red hill"), (0, 4, "cars fast"), (0, 2, "of the"), (1, 7, "k9 red2 x9"), (1, 8, None), (2, None, "red"), (2, 5, "red drive ired"), (None, 1, "red")]
    refs = spark.createDataFrame(known, "q int, reference_id long, content string")
    best = lambda: {r.k: r.reference_id for r in citations.best_references(rows, refs, ["k"], "s", "q", ["content"]).collect()}
    found = best()
    assert len(found) == rows.count() and [found[i * 4] for i in range(10)] == [4, 4, 2, 2, None, None, 4, 4, 4, None]
    assert (found[25], found[29], found[8 + 2], found[3], found[99]) == (7, 7, 5, None, None)
    monkeypatch.setattr(citations, "HITS", 2)
    assert best() == found
    monkeypatch.setattr(citations, "MOST_KNOWN", 15)  # as many as there are
    assert "Join" not in _optimized(citations.best_references(rows, refs, ["k"], "s", "q", ["content"])) and best() == found
    monkeypatch.setattr(citations, "MOST_KNOWN", 14)
    assert "Join" in _optimized(citations.best_references(rows, refs, ["k"], "s", "q", ["content"])) and best() == found
