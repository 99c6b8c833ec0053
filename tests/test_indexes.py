"""Full text by places, the vector index and the name index, against their definitions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import stems
from loomline.operators import fulltext, name_index, search, vector_index

# Stems: published pairs.
PAIRS = {
    "english": "consigned consign consigning consign consignment consign consistency consist consolation consol consolidating consolid conspicuously conspicu constancy constanc knackeries knackeri "
    "knaves knave knavish knavish kneeling kneel knightly knight knitting knit knotted knot skies sky happy happi dying die hoping hope hopping hop relational relat conditional condit electricity electr "
    "communication communic agreed agre generously generous by by say say cries cri ties tie gas gas this this gaps gap kiwis kiwi national nation",
    "german": "aufeinanderfolge aufeinanderfolg aufeinanderfolgenden aufeinanderfolg auferlegt auferlegt auffallenden auffall auffällig auffall auffälliges auffall kategorie kategori kategorisch kategor "
    "kater kat katze katz kätzchen katzch kaufleute kaufleut kaufmännischer kaufmann häuser haus freundlichkeit freundlich bedürfnisse bedurfnis",
    "french": "continu continu continuait continu continuant continu continuation continu continuelle continuel continuellement continuel continuer continu continuité continu contraire contrair "
    "contraires contrair majestueuse majestu majestueusement majestu majesté majest malade malad maladies malad mains main chevaux cheval nationaux national",
}


@pytest.mark.parametrize("name", PAIRS)
def test_stems(name):
    words = PAIRS[name].split()
    assert {w: stems.STEMMERS[name](w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))


@pytest.mark.parametrize("name", PAIRS)
def test_stems_of_any_word(name):
    rng = random.Random(1)
    for _ in range(3000):
        w = "".join(rng.choices("aeiouyäéèstlnmrqucbionegéç'", k=rng.randrange(0, 12)))
        assert isinstance(stems.STEMMERS[name](w), str)


def test_stemmed_columns(spark):
    rows = [(["running", "hoping"], "english"), (["häuser"], "de"), (["running"], None), (["running"], "tlh"), (None, "english"), ([], "fr"), (["x", None], "en")]
    got = [r[0] for r in spark.createDataFrame(rows, "w array<string>, l string").select(stems.stemmed(F.col("w"), F.col("l"))).collect()]
    assert got == [["run", "hope"], ["haus"], ["running"], ["running"], None, [], ["x", None]]


# Cover density


def covers_by_hand(words, groups, weights):
    """The sum over all shortest stretches in which a group holds, by trying every stretch."""
    asked = {w for g, _ in groups for w in g}

    def holds(a, b):
        part = words[a : b + 1]
        return any(any(tuple(part[i : i + len(g)]) == g for i in range(len(part))) if row else set(g) <= set(part) for g, row in groups)

    total, found = 0.0, False
    for a in range(len(words)):
        for b in range(a, len(words)):
            if holds(a, b):
                if not holds(a + 1, b) and not holds(a, b - 1):
                    inside = [i for i in range(a, b + 1) if words[i] in asked]
                    total += len(inside) / sum(1 / weights[i] for i in inside) / (1 + (b - a) - (len(inside) - 1))
                    found = True
                break
    return total if found else None


QUESTIONS = ["a b", "a", "a b c", 'a OR "b c"', '"a b a"', '"a b a" OR c', 'c -b', '"a b" c', "zzz", "", '"a b" OR "b a" OR "c c"']


@pytest.mark.parametrize("text", QUESTIONS)
def test_cover_density(spark, text):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randrange(0, 25)))) for i in range(60)] + [(100, None), (101, "...")]
    asked = fulltext.question(text)
    want = {}
    for i, t in rows:
        words = (t or "").split() if t != "..." else []
        if not set(asked.excluded) & set(words) and asked.groups:
            s = covers_by_hand(words, asked.groups, [0.1] * len(words))
            if s is not None:
                want[i] = round(s / (s + 1), 6)
    places = fulltext.positions(spark.createDataFrame(rows, "id long, text string"), "id")
    got = fulltext.ranked(places, asked, 1000, "id").collect()
    assert {r.id: r.score for r in got} == pytest.approx(want, abs=2e-6)
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r.score, r.id))] == list(range(1, len(got) + 1))


def test_closer_words_and_headings_rank_higher(spark):
    rows = [(1, "cats x x x dogs"), (2, "cats dogs"), (3, "# cats dogs\nnothing"), (4, "cats only"), (5, "dog a cat, dogs and cats")]
    df = spark.createDataFrame(rows, "id long, text string")
    plain = fulltext.ranked(fulltext.positions(df, "id"), fulltext.question("cats dogs"), 9, "id").collect()
    assert [r.id for r in plain] == [2, 3, 5, 1]
    headed = fulltext.ranked(fulltext.positions(df, "id", headings=True), fulltext.question("cats dogs"), 9, "id").collect()
    assert [r.id for r in headed][0] == 3
    stemmed = fulltext.ranked(fulltext.positions(df, "id", language="english"), fulltext.question("cat dog", "english"), 9, "id").collect()
    assert [r.id for r in stemmed] == [5, 2, 3, 1]
    no_stops = fulltext.positions(df, "id", stopwords=["and", "x"])
    assert {r.term for r in no_stops.collect()} == {"cats", "dogs", "nothing", "only", "dog", "a", "cat"}
    assert fulltext.ranked(no_stops, fulltext.question("cats and dogs", stopwords=["and"]), 9, "id").count() == 4  # stop words keep their places


def test_written_positions_are_read_by_term(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=50))) for i in range(200)], "id long, text string")
    places = fulltext.positions(df, "id")
    fulltext.write_positions(places, str(tmp_path / "p"), "id", buckets=32, files=2)
    asked = fulltext.question(f"{words[0]} {words[1]} -{words[2]}")
    read = fulltext.read_positions(spark, str(tmp_path / "p"), asked, 32)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in re.sub(r"#\d+", "", plan).replace("isnotnull(bucket), ", "") and "In(term" in plan.split("PushedFilters")[1]
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 3
    want = fulltext.ranked(places, asked, 50, "id").collect()
    assert want and sorted(fulltext.ranked(read, asked, 50, "id").collect()) == sorted(want)


# Vectors


def clustered(n, dim=32, seed=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 250, dim)) * 3
    return (centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dim))).astype(np.float32)


def test_vector_index_at_size(spark, tmp_path):
    x = clustered(50_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()
    index = vector_index.build(df, str(tmp_path / "v"), "vec_id")
    assert index.probes < 0.2 * len(index.centroids) and index.rows.sum() == 50_000
    asked = df.where("vec_id % 500 = 0")
    got = {}
    for r in vector_index.search(index, asked, 10, "vec_id").collect():
        got.setdefault(r.question, set()).add(r.id)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    q = np.arange(0, 50_000, 500)
    near = 1 - unit[q] @ unit.T
    near[np.arange(len(q)), q] = np.inf
    want = np.argsort(near, axis=1)[:, :10]
    assert np.mean([len(got[i] & set(w)) / 10 for i, w in zip(q.tolist(), want.tolist(), strict=True)]) >= 0.9
    # one question opens the files of its lists alone
    one = vector_index._asked(index, vector_index.usable(df.where("vec_id = 500"), "vec_id", "embedding", "cosine").withColumnRenamed("id", "question"), lambda far: far <= np.partition(far, index.probes - 1, axis=1)[:, index.probes - 1 : index.probes])
    read = vector_index._read(index, one, "id", "code")
    every = spark.read.parquet(f"{index.path}/lists")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list", plan) and "vector" not in plan.split("ReadSchema")[1]
    numbers = {int(f.split("list=")[1].split("/")[0]) for f in every.inputFiles()}
    assert 0 < one.select("list").distinct().count() < 0.2 * len(numbers)
    exact = {}
    for r in vector_index.search(index, df.where("vec_id % 5000 = 0"), 10, "vec_id", exact=True).collect():
        exact.setdefault(r.question, []).append((r["rank"], r.distance, r.id))
    for i in range(0, 50_000, 5000):
        order = np.lexsort((np.arange(50_000), near[i // 500].round(6)))[:10]
        assert [j for _, _, j in sorted(exact[i])] == order.tolist()
    df.unpersist()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vector_index_of_odd_rows(spark, tmp_path, metric):
    x = clustered(300, 8)
    rows = [(f"n{i:03}", [float(c) for c in v], "x") for i, v in enumerate(x)]
    rows += [(f"same{i:02}", rows[0][1], None) for i in range(30)]
    rows += [("null", None, ""), ("zero", [0.0] * 8, ""), ("nan", [float("nan")] * 8, ""), ("inf", [float("inf")] * 8, ""), ("part", [None] + [1.0] * 7, ""), ("short", [1.0] * 3, ""), ("none", [], ""), (None, [1.0] * 8, "")]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, list string")
    index = vector_index.build(df, str(tmp_path / "v"), "vec_id", metric=metric, list_rows=20)
    used = {i: np.array(v) for i, v, _ in rows if i is not None and (i[0] == "n" and len(i) == 4 and i[1:].isdigit() or i.startswith("same") or (i == "zero" and metric == "l2"))}
    got = {}
    for r in vector_index.search(index, df, 4, "vec_id", exact=True).collect():
        got.setdefault(r.question, []).append((r["rank"], r.id, r.distance))
    assert set(got) == set(used)

    def far(a, b):
        return round(float(np.sqrt(((a - b) ** 2).sum()) if metric == "l2" else 1 - a @ b / np.sqrt((a @ a) * (b @ b))), 6) + 0.0

    for q in ("n000", "n123", "same07", "n299"):
        want = sorted((far(used[q], v), i) for i, v in used.items() if i != q)[:4]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want]
        assert [d for _, _, d in sorted(got[q])] == pytest.approx([d for d, _ in want], abs=2e-6)
    assert vector_index.build(df.where("false"), str(tmp_path / "e"), "vec_id") is None


def test_null_vectors_are_never_near(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [1.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert [r.id for r in search.vector_topk(df, [1.0, 0.0], 9, "id").collect()] == [1, 5]
    assert [r.id for r in search.vector_topk(df, [1.0, 0.0], 9, "id", metric="l2").collect()] == [1, 3, 5]
    found = search.best_candidates(df, df, "id", "embedding", 3, 0.1, block=2).collect()
    assert {(r.id, r.candidate) for r in found} == {(1, 5), (5, 1)}
    assert search.best_candidates(df.where("false"), df.where("id = 2"), "id", "embedding", 3, 0.1).collect() == []


# Names


def test_names_by_index_are_those_of_the_scan(spark, tmp_path):
    rng = random.Random(5)
    parts = ["alpha", "alphas", "beta", "betta", "gamma", "delta corp", "é", "x1", "omega"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(1, 4)))) for i in range(400)] + [(900, None), (901, ""), (902, "---")]
    df = spark.createDataFrame(rows, "id long, name string")
    name_index.write(df, str(tmp_path / "t"), "id", "name", 16)
    for ask, threshold in (("alpha beta", 0.3), ("gama", 0.3), ("delta corp omega", 0.55), ("x1", 0.99), ("unseen", 0.3), ("", 0.3)):
        want = {(r.id, r.similarity) for r in search.trigram_topk(df, ask, 1000, "id", "name", threshold).collect()}
        q = spark.createDataFrame([(1, ask)], "q long, name string")
        assert {(r.id, r.similarity) for r in name_index.similar(spark, str(tmp_path / "t"), q, "q", "name", threshold, buckets=16).collect()} == want
    found = name_index.similar(spark, str(tmp_path / "t"), spark.createDataFrame([(1, "gama")], "q long, name string"), "q", "name", buckets=16)
    plan = re.sub(r"#\d+L?|isnotnull\(bucket\), ", "", re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString()))
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket IN \([\d,]+\)", plan)) >= 2
