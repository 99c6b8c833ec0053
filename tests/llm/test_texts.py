"""Language, personal data, quality, licences, backoff scores and repeated spans: held-out accuracy, brute force and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from compare import assert_same, duck_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import backoff, language, licenses, pii, quality, substrings
from loomline.llm.registry import QUERIES, SQL

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One line. Licensed under the MIT License. And more! Yes?\nLicensed under the MIT License."), (5, "x" * 100_000), (6, "word " * 1_500),
    (7, "A b. C d. E f. G h. I j."), (8, "A b. C d. E f. G h. I j."), (9, "é漢字 ß. Ünï cödé. Third one here. A b. C d. E f."), (10, "12345 678 !!! ???"), (11, "under the MIT Licensed License"),
    (12, "Licensed under the Apache License, Version 2.0"), (13, "a"), (14, "A b. C d. E f. A b. C d. E f."), (15, "ΑΒΓ αβγ. İstanbul ǅ"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory) -> str:
    at = tmp_path_factory.mktemp("odd")
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "c d e f g h i j"), (2, None), (3, ""), (4, "A b"), (5, "word " * 12)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0), (4, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    x = np.random.default_rng(1).normal(size=(70, 64)).astype(np.float32).tolist()
    vectors = [(i, v, i % 3 or None) for i, v in enumerate(x)] + [(90 + i, x[0], 1) for i in range(5)]
    vectors += [(100, None, 1), (101, [None, *x[1][1:]], 1), (102, [float("nan"), *x[1][1:]], 2), (103, [float("-inf"), *x[1][1:]], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(SQL))
def test_odd_rows_same_as_sql(spark, odd, name):
    assert_same(QUERIES[name](spark, odd), SQL[name], odd)


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op5_near_duplicates"}))
def test_same_as_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_nearest"}))
def test_an_empty_table_gives_no_rows(spark, odd, tmp_path, name):
    spark.read.parquet(f"{odd}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for other in ("benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{other}.parquet").where("false").write.parquet(f"{tmp_path}/{other}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_clashing_and_repeated_rows(spark):
    names = "score predicted lang_pred n_email spans n_licenses licenses clean_text n_removed n_words hit items _key _lang _pii _found _cut _of".split()
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in [*ODD, *ODD[:3]]], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for out in (language.identify(df, language.fit(df.withColumn("lang", F.lit("en")))), pii.scan(df), quality.score(df, quality.Quality((), None, 1.0, 1.0)), licenses.scan(df), substrings.deduplicate(df)):
        assert out.count() == len(ODD) + 3 and len(set(out.columns)) == len(out.columns) and "items" in out.columns
        assert set(df.columns) <= set(out.columns)
        same = [n for n in ("hit", "items", "_key", "_lang", "_pii", "_found", "_cut", "_of")]
        assert set(map(tuple, out.select(*same).collect())) == {tuple(names.index(n) for n in same)}


# Language.


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op2_language_id"](spark, sf)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.collect())
    held = got.where("held_out").join(docs, "doc_id").where("lang IS NOT NULL AND length(text) > 40")
    assert held.where("lang_pred = lang").count() >= 0.93 * held.count() > 0


def test_language_by_hand(spark):
    rows = [(1, "abab abc", "x"), (2, "zzyy zz", "y"), (3, "abc ab", None), (4, None, "y"), (5, "1 2 3", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, language.fit(df)).collect()}
    assert got[3][0] == "x" and got[2][0] == "y" and got[4] == got[5] == ("und", 0.0)
    assert got[2][1] == 1.0  # the ranking that it taught
    none = language.identify(df, language.fit(df.where("false"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_marks_and_unassigned_characters_are_no_letters(spark):
    rows = [(1, "abc abd", "x"), (2, "\u0301\u0302 \u0303", None), (3, "\U0003fff0\U00030000", None), (4, "\U0003fff0", None), (5, "e\u0301", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, language.fit(df)).collect()}
    assert got == {1: "x", 2: "und", 3: "x", 4: "und", 5: "x"}


def out_of_place(text: str, profile: list[str], top: int) -> int:
    """The distance by its definition: over the text's most frequent n-grams, the difference of ranks, or top where the profile lacks one."""
    ranks = {g: k for k, g in enumerate(profile)}
    return sum(abs(ranks[g] - k) if g in ranks else top for k, g in enumerate(ranking([text], top)))


def ranking(texts: list[str], top: int) -> list[str]:
    """The most frequent n-grams of 1 to 3 characters of lower-cased ASCII texts; a blank is a word's edge. Edges sort behind letters, longer n-grams by their codes."""
    counts: dict[str, int] = {}
    for t in texts:
        t = f" {' '.join(re.findall('[a-z]+', t.lower()))} "
        for n in (1, 2, 3):
            for g in (t[i : i + n] for i in range(len(t) - n + 1)):
                if g != " ":
                    counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum((0x1FFFFF if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def test_language_against_the_distance_by_definition(spark):
    rng = np.random.default_rng(6)
    speak = {"aa": "the of and to in is that it was for", "bb": "der die und in den von zu das mit sich", "cc": "de la que el en y a los se del"}
    rows = [(i, " ".join(rng.choice(speak[name].split(), int(rng.integers(1, 30)))), name) for i, name in enumerate(sorted(speak) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, language.fit(df, top=60)).collect()}
    profiles = {name: ranking([t for _, t, n in rows if n == name], 60) for name in speak}
    for i, text, _ in rows:
        far = {name: out_of_place(text, p, 60) / (60 * len(ranking([text], 60))) for name, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[i][0] == best and abs(got[i][1] - max(0.0, 1 - far[best])) < 1e-12


# Personal data.

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, pattern in _PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], list(_PATTERNS).index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789.@+-() aZé٣", "@b.c", "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "a@b", "..", "00256", "\n", "999."]), max_size=30).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == base_by_hand(text)


def test_long_runs_are_quick():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "a@" * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_digits_that_int_does_not_take(spark):
    # a superscript after an address, in either part; more zeros than int() reads; digits of another script
    texts = ["see 1.2.3.4\u00b2 there", "v 1.2.3.\u00b2 out", "0" * 5000 + ".1.1.1", "1.2.3.\u0663 x", "x 1.2.3.4"]
    assert [pii.base_spans(t) for t in texts] == [[(4, 11, "ip")], [], [(0, 5006, "ip")], [], [(2, 9, "ip")]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_ip for r in pii.scan(df).collect()} == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}
    hidden = {r.doc_id: r.text for r in pii.hide(df).collect()}
    assert hidden[2] == "[IP]" and hidden[4] == "x [IP]"


def test_pii_rows(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op3_pii"](spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_email + r.n_phone + r.n_card + r.n_ip for r in got) > 0
    for r in got:
        base = base_by_hand(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in _PATTERNS)
        written = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | {""}


def test_crf_finds_what_it_has_not_seen():
    crf, rows = pii.default_model(), pii.examples(400, seed=99)
    found = pii.crf_spans([t for t, _ in rows], crf)
    right = sum(len(set(f) & set(s)) for f, (_, s) in zip(found, rows, strict=True))
    assert right >= 0.95 * sum(map(len, found)) and right >= 0.95 * sum(len(s) for _, s in rows)


def test_redact(spark):
    df = spark.createDataFrame([(1, "mail bob@example.com, or call +1 (555) 123-4567."), (2, None), (3, "nothing here"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", pii.redact(F.col("text"), pii.default_model()).alias("t")).collect()}
    assert got == {1: "mail [EMAIL], or call [PHONE].", 2: None, 3: "nothing here", 4: ""}


# Quality.


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op4_quality"](spark, sf)
    rows = got.join(labels, "doc_id").where("held_out AND quality IS NOT NULL").select("quality", "score", "predicted").collect()
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    above = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert above >= 0.8 and np.mean([r.predicted == r.quality for r in rows]) >= 0.75


def test_quality_learns_one_text_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {i} of the same id") for i in range(3000)] + [(2, "x x x x"), (3, None)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, quality int")
    sizes = []
    real = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: sizes.append((found := real(self)).num_rows) or found)
    model = quality.fit(docs, labels, texts=10)
    assert sizes == [3] and model.crf is not None


def test_quality_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, odd).collect()}
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert got[1].score == got[2].score == got[3].score


# Licences.


def dice_by_hand(text: str) -> set[str]:
    """Licences of which some window of words, of a template's size and anywhere in the text, reaches the threshold."""
    words, found = licenses.words_of(text), set()
    for name, template in licenses.TEMPLATES:
        t = licenses.words_of(template)
        b = set(licenses.bigrams_of(t))
        for i in range(1 - len(t), len(words)):
            a = set(licenses.bigrams_of(words[max(i, 0) : max(i + len(t), 0)]))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= licenses.THRESHOLD:
                found.add(name)
                break
    return found


def test_licence_of_the_text_wins(spark):
    """Each template's text names its own licence alone, also with words changed; two licences side by side are both found."""
    texts = [(i, text, name) for i, (name, text) in enumerate(licenses.TEMPLATES)]
    notice = next(t for n, t in licenses.TEMPLATES if n == "LGPL-2.1" and "redistribute" in t)
    bsd2 = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause").replace("Redistributions of source code", "Copies of source code")
    more = [(100, f"# {notice.replace('will be useful', 'might be useful')}", "LGPL-2.1"), (101, bsd2, "BSD-2-Clause"), (102, f"Licensed under CC BY 4.0. {texts[0][1]}", "CC-BY-4.0,MIT"),
            (103, " ".join(["lorem"] * 300) + " " + next(t for n, t in licenses.TEMPLATES if n == "WTFPL"), "WTFPL")]
    rows = spark.createDataFrame(texts + more, "i int, text string, name string")
    got = licenses.scan(rows).collect()
    wrong = {(r.name, r.licenses, r.best_license) for r in got if r.licenses != r.name or r.best_license not in r.name.split(",")}
    assert not wrong


def test_licences_wherever_they_stand(spark):
    rng = np.random.default_rng(4)
    prose = " ".join(rng.choice("the work of an author under some conditions may include other words and permission".split(), 120))
    text = dict(licenses.TEMPLATES[::-1])  # the first template of each name
    wrapped = "\n".join(" * " + x for x in re.findall(r".{1,70}(?:\s|$)", text["MIT"]))
    rows = [
        (1, text["MIT"]), (2, f"{prose}\n/*\n{wrapped}\n */\n{prose}"), (3, f"{prose} {text['CC0-1.0']} {prose}"), (4, prose), (5, text["BSD-3-Clause"].upper()), (6, text["GPL-3.0"].replace("program", "thing")),
        (7, text["Apache-2.0"][: len(text["Apache-2.0"]) // 3]), (8, "under the MIT"), (9, None), (10, ""), (11, f"{text['ISC']}\n{text['Zlib']}"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].best_license, got[1].best_score) == ("MIT", 1.0) and got[2].best_license == "MIT" and got[2].best_score == 1.0
    assert got[3].licenses == "CC0-1.0" and got[4].n_licenses == got[8].n_licenses == got[9].n_licenses == got[10].n_licenses == 0
    assert got[5].best_license == "BSD-3-Clause" and {"ISC", "Zlib"} <= set(got[11].licenses.split(","))
    for i, t in rows:
        assert set(filter(None, got[i].licenses.split(","))) <= dice_by_hand(t or "")
        assert not dice_by_hand(t or "") or got[i].n_licenses


# Backoff scores.


def test_backoff_repeated_rows_are_added_up(spark, tmp_path):
    rows = [(1, "a b a b"), (1, "a b"), (2, None), (3, "b a b a b a"), (None, "a b c"), (None, "c"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.mean_score) for r in backoff.scores(df).collect()}
    assert got[1][0] == 6 and got[1][1] < 0 and got[2] == got[4] == (0, None) and got[None][0] == 4
    assert_same(QUERIES["op7_backoff"](spark, str(tmp_path)), SQL["op7_backoff"], str(tmp_path))


@pytest.mark.parametrize("hot", [(1, 1), (30, 10), (1000, 1000), (10**9, 1)])
def test_backoff_of_rare_words(spark, sf, hot):
    # few words and pairs are frequent, so the others go through the joins; no word is taken for another
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = backoff.scores(df.withColumn("score", F.lit(1)).withColumn("key", F.lit(1)), hot_words=hot[0], hot_pairs=hot[1])
    out = out.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))
    assert_same(out, SQL["op7_backoff"], sf)


def test_no_frequent_pair_is_missed(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, 40) if i % 3 else ["hot", "pair"] * 20)) for i in range(300)], "doc_id long, text string").repartition(7)
    want: dict[tuple, int] = {}
    for r in df.collect():
        w = [None, *r.text.split()]
        for pair in zip(w, w[1:], strict=False):
            want[pair] = want.get(pair, 0) + 1
    total = sum(want.values())
    for held in (50, 10**6):
        counts = backoff.first_counts(df, hot_pairs=40, held=held).cache()
        keys, n = backoff.frequent_pairs(df, counts, total, hot_pairs=40)
        assert len(keys) <= 80 and {x for x in want.values() if x > total / 40} <= set(n.tolist()) and set(n.tolist()) <= set(want.values())


# Repeated spans.


LONG = "Alpha one two three. Beta four five six seven. Gamma eight nine ten eleven twelve. Delta the last."


def test_first_places_stay(spark, odd):
    df = spark.createDataFrame([(7, LONG), (8, LONG.upper()), (14, f"{LONG} {LONG}"), (9, f"é漢字 ß. Ünï cödé. Third one here. {LONG}"), (1, None), (2, ""), (3, "A b. C d. E f.")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.deduplicate(df).collect()}
    assert got[7].n_removed == 0 and got[7].clean_text == LONG and got[3].clean_text == "A b. C d. E f."
    assert got[8].n_removed == got[8].n_sentences > 0 and got[8].clean_text == got[14].clean_text == ""
    assert got[9].clean_text == "é漢字 ß. Ünï cödé. Third one here. "
    assert got[1].clean_text is None and got[2].clean_text == ""
    assert spark_rows(QUERIES["op10_substring_dedup"](spark, odd)) == duck_rows(SQL["op10_substring_dedup"], odd)[1]


def test_a_passage_of_51_words_is_found_wherever_it_begins(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, k = [], 0
    for end in ("", ".", "。", '."'):  # sentences of every length, some without an end
        for _ in range(30):
            passage = word(51)
            for i in np.flatnonzero(rng.random(51) < 1 / 9):
                passage[i] += end
            for _ in range(2):
                rows.append((k, " ".join(word(int(rng.integers(0, 40))) + passage + word(int(rng.integers(0, 40))))))
                k += 1
    got = {r.doc_id: r.n_removed for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 and got[i + 1] > 0 for i in range(0, k, 2))


def test_rows_that_share_an_id(spark, tmp_path):
    rows = [(0, LONG), (1, f"New here. {LONG}"), (1, "P one two three four five. Q six seven eight nine ten. R eleven twelve thirteen. S fourteen."), (1, LONG), (0, LONG), (None, LONG), (None, None)]
    rows += [(i % 3 + 20, f"{LONG} And {i} more.") for i in range(9)] + [(30, "甲乙丙。" * 20), (31, "丁戊。「甲乙丙。」" * 3 + "甲乙丙。" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(QUERIES["op10_substring_dedup"](spark, str(tmp_path)), SQL["op10_substring_dedup"], str(tmp_path))
    got = substrings.deduplicate(df, part_rows=2).collect()  # every frequent span in parts
    assert sorted(map(repr, got)) == sorted(map(repr, substrings.deduplicate(df).collect()))
    by = {(r.doc_id, r.text): r for r in got}
    assert by[0, LONG].n_removed == 0 and by[1, LONG].n_removed > 0 and by[1, rows[2][1]].n_removed == 0 and by[None, LONG].n_removed == 0
