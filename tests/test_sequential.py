"""What SQL does not express, against plain versions: chunks, passages, diversity, shaping, normal forms, terms of questions."""

from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.operators import etl, search, shaping
from loomline.plans import router
from loomline.plans.registry import QUERIES

TOKEN = re.compile(r"[a-z0-9]+(?:[._/-][a-z0-9]+)*")


def mmr_by_hand(rows, weight, k):
    """rows (id, text, relevance) of one list: ids in the order in which they are taken."""
    left = [(i, set(TOKEN.findall((t or "").lower())), r) for i, t, r in sorted(rows, key=lambda x: (-x[2], x[0]))]
    empty, left, taken = [i for i, s, _ in left if not s], [x for x in left if x[1]], []
    while left and len(taken) < k:
        gain = lambda x: weight * x[2] - (1 - weight) * max(len(x[1] & t[1]) / len(x[1] | t[1]) for t in taken) if taken else x[2]
        best = max(left, key=lambda x: (gain(x), x[2], -left.index(x)))
        taken.append(best)
        left.remove(best)
    return ([i for i, _, _ in taken] + empty)[:k]


def test_mmr(spark, sf):
    rows = [(r.q, r.doc_id, r.text, 1.0 / r["rank"]) for r in __import__("loomline.plans.shaping_queries", fromlist=["x"])._ranked(spark, sf).collect()]
    got: dict[int, list] = {}
    for r in QUERIES["mmr_rerank"](spark, sf).collect():
        got.setdefault(r.q, []).append((r["rank"], r.doc_id))
    for q in {r[0] for r in rows}:
        assert [i for _, i in sorted(got[q])] == mmr_by_hand([r[1:] for r in rows if r[0] == q], 0.7, 10)


def test_shaped_lists(spark):
    """Caps, diversity, support and budget of one list, step by step in plain Python."""
    texts = {i: " ".join(["the", f"w{i % 4}", f"x{i}", "with"][: 2 + i % 3]) for i in range(12)}
    rows = [(0, i, f"d{i % 3}", texts[i], i + 1, float(20 - i), 1.0 if i == 7 else 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "q int, chunk_id int, doc string, content string, rank int, score double, exact_phrase_match double")
    question = "tell me more of the things that are said of it in all"
    got = {r.chunk_id: r for r in router.shaped(df, question, ["the", "with"], 10, 10_000).collect()}
    base = {i: (20 - i - 9) / 11 for i in range(12)}
    lexical = {i: round((0.7 * ("the" in t.split()) + 0.7 * ("with" in t.split())) / 2, 6) for i, t in texts.items()}
    now = sorted(range(12), key=lambda i: (-round(0.8 * base[i] + 0.2 * lexical[i], 6), -lexical[i], i))
    assert [got[i].lexical_rank for i in got] == [now.index(i) + 1 for i in got]
    now.sort(key=lambda i: i != 7)
    kept, seen = [], {}
    for i in now:
        if seen.get(i % 3, 0) < 2 and len(kept) < 10:
            kept.append(i)
            seen[i % 3] = seen.get(i % 3, 0) + 1
    assert {i for i, r in got.items() if r.per_document_rank} == set(kept)
    order = mmr_by_hand([(i, texts[i], 1.0 / (k + 1)) for k, i in enumerate(kept)], 0.7, 10)
    order.sort(key=lambda i: i != 7)
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == order
    assert [got[i].id for i in order] == [f"DC{k + 1}" for k in range(len(order))]
    few = router.shaped(df, question, ["the"], 10, 12).collect()
    assert 0 < len(few) < len(order)


def test_retrieval_modes(spark, sf):
    from loomline.plans.alias_queries import _retrieval

    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    for mode, legs in (("naive", {"vector", "text"}), ("local", {"entity"}), ("global", {"relation"}), ("hybrid", {"entity", "relation"}), ("mix", {"vector", "text", "entity", "relation"}), ("bypass", set())):
        rows = _retrieval_plain(spark, sf, mode)
        used = {s for r in rows for s in r.sources.split("+")}
        assert used <= legs and bool(rows) == bool(legs)
        assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and {r.chunk_id for r in rows} <= docs
    with pytest.raises(ValueError, match="mode"):
        router.mode_of("why", "other")
    assert router.mode_of("compare a and b", "local") == "mix" and _retrieval(spark, sf, "mix").columns[0] == "chunk_id"


def _retrieval_plain(spark, sf, mode):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("doc"), F.substring("text", 1, 200).alias("content"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding").join(docs.select("chunk_id"), "chunk_id", "left_semi")
    links = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("entity"), (F.col("l_orderkey") % 200).alias("chunk_id")).distinct().join(docs.select("chunk_id"), "chunk_id", "left_semi")
    return router.retrieve("what is said of the world here", docs, vectors, links, vectors.orderBy("chunk_id").first().embedding, ["the", "of"], mode).collect()


def test_unicode(spark, sf):
    samples = ["café", "a​b‮", "\U0001d400\U0001d7d8 x", "plain", "ﬁ stays", "soft­hyphen", "﻿text", None]
    got = [r.x for r in spark.createDataFrame([(s,) for s in samples], "t string").coalesce(1).select(etl.normalized_unicode(F.col("t")).alias("x")).collect()]
    assert got == ["café", "ab", "A0 x", "plain", "ﬁ stays", "softhyphen", "text", None]
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", etl.normalized_unicode(F.col("text")).alias("x")).limit(200).collect():
        assert r.text is None or r.x == unicodedata.normalize("NFC", "".join(c for c in r.text if unicodedata.category(c) != "Cf"))


def check_chunks(text, threshold):
    chunks = etl.markdown_chunks(text, threshold)
    at = 0
    for heading, content, n, a, b in chunks:
        own = text[a:b].strip()
        assert a >= at and content.endswith(own) and n == len(content.split()) and own
        assert not text[at:a].strip()
        assert len(own.split()) <= 2 * threshold or " " not in own
        at = b
    assert not text[at:].strip()
    return chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# One", "## Two", "### Three", "a few words here.", "More words follow! And more.", "", "- item one two", "  goes on", "1. first", "| a | b |", "| - | - |", "| c d | e |", "<!-- PAGE 2 -->", "x" * 30]), max_size=40), st.integers(2, 12))
def test_chunks_are_the_text(lines, threshold):
    check_chunks("\n".join(lines), threshold)


def test_chunks_by_rule():
    words = lambda n: " ".join(f"w{i}." for i in range(n))
    text = f"# A\n{words(120)}\n## B\n{words(10)}\n## C\n{words(130)}\n# D\n{words(5)}\n# E\n{words(5)}"
    heads = [(h, n) for h, _, n, _, _ in check_chunks(text, 200)]
    # tiny B goes into A that it is under; C is not tiny; D and E are not under one another
    assert heads == [("A", 134), ("A > C", 132), ("D", 7), ("E", 7)]
    table = "# T\n| h1 | h2 |\n| --- | --- |\n" + "\n".join(f"| a{i} b c | d{i} |" for i in range(60))
    rows = check_chunks(table, 40)
    assert len(rows) > 3 and all(c.split("\n")[:2] == ["| h1 | h2 |", "| --- | --- |"] for _, c, *_ in rows[1:])
    items = "# L\n" + "\n".join(f"- item {i} has words\n  and goes on here" for i in range(40))
    assert all(c.lstrip("# L\n").startswith("- item") for _, c, *_ in check_chunks(items, 30))
    sizes = [n for _, _, n, _, _ in check_chunks("\n\n".join(words(10) for _ in range(11)), 25)]
    assert min(sizes) >= 0.35 * 50  # the tail is evened out


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "<!-- PAGE 3 -->\n# H\ntext here\n<!-- PAGE 4 -->\nmore"), (2, None), (3, " ")], "doc_id long, text string")
    got = etl.semantic_chunks(df, "doc_id", "text").collect()
    assert [(r.doc_id, r.position, r.heading, r.page_start, r.page_end) for r in got] == [(1, 0, "H", 3, 4)]
    by_letters = etl.semantic_chunks(df, "doc_id", "text", 10, count=len).collect()
    assert max(r.tokens for r in by_letters) <= 20 and len(by_letters) > 1
    own = etl.with_chunker(df, "doc_id", "text", lambda t: [{"content": x} for x in t.split()]).collect()
    assert [r.content for r in own if r.doc_id == 1][:3] == ["<!--", "PAGE", "3"]
    assert [r.n for r in df.coalesce(1).select(etl.token_counts(F.col("text"), len).alias("n")).collect()] == [50, 0, 1]
    with pytest.raises(Exception, match="list of dicts"):
        etl.with_chunker(df, "doc_id", "text", lambda t: t).collect()


def test_passages(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        out, buffer = [], ""
        size = 0
        for p in [x.strip() for x in re.split(r"\n{2,}", (r.text or "").replace("\n", "\n\n")) if x.strip()]:
            if buffer and size + len(p) + 2 > 800:
                out.append(buffer)
                buffer, size = "", 0
            buffer += ("\n\n" if buffer else "") + p
            size += len(p) + 2
        want[r.doc_id] = [x for x in [*out, buffer] if len(x) >= 50]
    got: dict[int, list] = {}
    for r in QUERIES["greedy_passages"](spark, sf).orderBy("position").collect():
        got.setdefault(r.doc_id, []).append(r.passage)
    assert got == {k: v for k, v in want.items() if v}


def test_terms_of_questions():
    rules = [(("maker",), ("brand", "made by"), 0.8)]
    assert search.relation_terms("the maker, of this;  the maker", rules) == [("the maker, of this; the maker", 1.0), ("the maker", 1.0), ("of this", 1.0), ("brand", 0.8), ("made by", 0.8)]
    assert len(search.relation_terms(",".join("abcdefghijklmnop"))) == 12 and search.relation_terms("  ") == []
    got = search.fallback_queries("what does FDA say on the shipment", ["FDA", "depot lead", "the long phrase here", "lot 7"], ["the"], [("shipment", "ship")])
    assert got == ["FDA shipment", "depot lead shipment", "shipment", "FDA", "depot lead"]
    assert search.fallback_queries("shipment", [], [], [("shipment", "ship")]) == []
    assert shaping.chunk_limit(3, 10) == 5 and shaping.chunk_limit(4, 10) == 10 and shaping.chunk_limit(1, 1) == 1
