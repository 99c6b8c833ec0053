"""Pages put together: markup, native text, repeated notices, gaps, odd rows, against the definition in plain Python."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomline.operators import extraction as X

PAGES = "d string, page int, content string, native string, warning string, message string"
LONG = "A sentence that goes on for long enough to be a page of its own, with a hundred characters and some more."


def _pages(spark, rows):
    return spark.createDataFrame([(r + (None,) * 6)[:6] for r in rows], PAGES)


def test_markup_becomes_lines(spark):
    cases = {
        "a<br/>b": "a\nb",
        "<p class='x'>one</p> <p>two &amp; three</p>": "one\n\ntwo & three",
        "<ul><li>first <b>bold</b></li><li>second<br>line&nbsp;x</li></ul>": "- first bold- second\nline x".replace("\nline", " line"),
        "<div><span>in</span> <em>out</em></div>": "in out",
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>end": "| a | b |\n| --- | --- |\n| 1 | 2 |\n\nend",
        "x<table><tr><td colspan=2>a &amp; b</td></tr></table>y": "x<table><tr><td colspan=2>a &amp; b</td></tr></table>y",
        "x<table><tr><td>a</td></tr><tr><td>1</td><td>2</td></tr></table>": "x<table><tr><td>a</td></tr><tr><td>1</td><td>2</td></tr></table>",
        "a\n\n\n\nb\u0000c": "a\n\nbc",
        None: "",
    }
    rows = X.normalized(spark.createDataFrame(list(enumerate(cases)), "i int, x string"), "x", "y")
    assert [r.y for r in rows.orderBy("i").collect()] == list(cases.values())


def test_usable(spark):
    cases = {"a": True, "": False, " -- ": False, "<!-- PAGE 3 -->": False, "<b></b>": False, "&nbsp;&#32;": False, "<![CDATA[x]]>": True, "<?xml v?>": False, "<!DOCTYPE html>": False, "<!ELEMENT b>": False, "甲": True, "٣": True}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", X.usable(F.col("x")).alias("y"))
    assert [r.y for r in rows.orderBy("i").collect()] == list(cases.values())


def test_records_texts_reports(spark):
    notice = "Confidential 2024"
    rows = [("a", 1, f"{LONG}\n{notice}\nPage 1 of 6"), ("a", 2, "Confidential 7\nPage 2 of 6"), ("a", 4, "short", LONG + " Native."), ("a", 5, f"{LONG}\n{notice}\nProprietary\nPage 5 of 6", None, "vision_truncation", "cut"),
            ("a", 5, f"{LONG}\nzzz"), ("b", 1, "One page\nPage 1 of 1"), (None, 1, "lost"), ("a", 0, "lost"), ("c", 1, None, "")]
    counts = spark.createDataFrame([("a", 6), ("d", 2), (None, 3), ("e", 0)], "d string, page_count int")
    found = X.records(_pages(spark, rows), counts, "d").cache()
    got = {(r.doc, r.page): r for r in found.collect()}
    assert sorted(got) == [("a", k) for k in range(1, 7)] + [("b", 1), ("c", 1), ("d", 1), ("d", 2)]
    assert [got["a", k].status for k in range(1, 7)] == ["ok", "boilerplate_only", "empty", "native_fallback", "vision_warning", "empty"]
    # three pages of six have a number and the notice, one says proprietary
    assert got["a", 1].retrieval_content == LONG and got["a", 2].retrieval_content == "" and got["a", 5].retrieval_content == f"{LONG}\nProprietary"
    assert got["a", 1].canonical_content == f"{LONG}\n{notice}\nPage 1 of 6"
    assert got["a", 4].source_method == "vision_plus_native" and got["a", 5].warnings == ["vision_truncation: cut"]
    assert got["b", 1].status == "tiny" and got["b", 1].retrieval_content == "One page\nPage 1 of 1" and got["c", 1].status == "empty"

    texts = {r.doc: r for r in X.texts(found).collect()}
    assert texts["d"].canonical == "<!-- PAGE 1 -->\n\n<!-- PAGE_STATUS: empty -->\n\n<!-- PAGE 2 -->\n\n<!-- PAGE_STATUS: empty -->" and texts["d"].retrieval == ""
    assert texts["b"].retrieval == "<!-- PAGE 1 -->\n\nOne page\nPage 1 of 1"
    report = X.reports(found)
    of = {r.doc: r for r in report.collect()}
    assert of["a"].page_count == 6 and of["a"].empty_pages == [3, 6] and of["a"].native_fallback_pages == [4]
    assert of["a"].warning_counts == {"empty_page": 2, "native_fallback": 1, "vision_truncation": 2, "vision_quality": 1, "retrieval_omitted_boilerplate_only": 1}
    assert of["d"].warning_counts == {"empty_page": 2, "vision_quality": 1} and of["b"].tiny_pages == [1]
    whole = {r.doc: json.loads(r.manifest) for r in X.manifests(found, report, "m", "1").collect()}
    assert len(whole["a"]["page_records"]) == 6 and whole["a"]["page_records"][3]["status"] == "native_fallback" and whole["a"]["quality_report"]["empty_pages"] == [3, 6]


def test_brands_and_empty_tables(spark):
    rows = [("a", 1, f"# ACME\n{LONG}"), ("a", 2, "acme")]
    got = X.records(_pages(spark, rows), None, "d", brands=["acme"]).orderBy("page").collect()
    assert [r.retrieval_content for r in got] == [LONG, ""] and [r.status for r in got] == ["ok", "boilerplate_only"]
    none = X.records(_pages(spark, []).where("d = 'x'"), None, "d")
    assert none.count() == X.texts(none).count() == X.reports(none).count() == 0
