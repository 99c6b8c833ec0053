"""Nearest neighbours and near-duplicate groups against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from loomline.llm import groups, neardup, neighbours
from loomline.llm.registry import QUERIES, SQL
from loomline.llm.shared import Tables


def nearest_by_hand(rows, k, asks):
    x = {}
    for i, v in rows:
        if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) or len(v) != 6:
            continue
        x.setdefault(i, []).append(v)
    ids = sorted(x)
    out = {}
    for i in ids:
        if asks(i):
            far = {j: min(float(np.sqrt(((np.array(x[j], float) - a) ** 2).sum(1)).min()) for a in np.array(x[i], float)) for j in ids if j != i}
            out[i] = sorted((s, j) for j, s in far.items())[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) + (i % 7)]) for i in range(3000)]
    rows += [(i, rows[5][1]) for i in range(4000, 4040)]  # many equal vectors
    rows += [(5000, None), (5100, [0.0] * 6), (5200, [float("nan")] + [1.0] * 5), (5300, [None] + [1.0] * 5), (5400, [float("inf")] * 6), (5500, [1.0] * 3), (5, [9.0] * 6), (5, [9.0] * 6), (50, [1.5] * 6), *[(50, [2.0 + i / 100] * 6) for i in range(20)], (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    want = nearest_by_hand(rows, 10, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        mine = [got[q][k] for k in sorted(got[q])]
        assert sorted(got[q]) == list(range(1, 11)) and mine == sorted(mine)
        hits += len({j for _, j in mine} & {j for _, j in best})
    assert hits >= 0.9 * 10 * len(want)


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 7, 0.0), (0, 2, 100, 2**0.5), (100, 1, 0, 2**0.5), (100, 2, 7, 2**0.5)]
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_recall_on_the_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    m, ids = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    got = {(r.query_id, r.vec_id) for r in QUERIES["op1_nearest"](spark, sf).collect()}
    want = {(int(i), int(j)) for i in ids if i % 100 == 0 for j in [x for x in ids[np.lexsort((ids, ((m - m[ids == i]) ** 2).sum(1)))] if x != i][:10]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_recall_where_few_lists_are_read(spark):
    # 50,000 vectors around 2,000 places, every 100th asks: the lists that it reads, and what of its nearest it finds
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 24))[rng.integers(0, 2000, 50_000)] + 0.35 * rng.normal(size=(50_000, 24))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 24).cast(pa.list_(pa.float64()))}))
    made = neighbours.index(neighbours.valid(df, "vec_id", "embedding"), Tables(spark), 24)
    read = np.mean([len(p) for p in made.graph.probes(x[::100], made.ratio)]) / len(made.graph.centres)
    assert len(made.graph.centres) > 700 and read < 0.2
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()}
    hits = 0
    for i in range(0, len(x), 100):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += sum((i, int(j)) in got for j in np.argpartition(d, 10)[:10])
    assert hits >= 0.9 * 10 * 500
    print("lists", len(made.graph.centres), "read", read, "recall", hits / 5000)


def groups_by_hand(rows, words, percent):
    sets = []
    for i, text in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    union = groups.Union()
    for i, s in sets:
        for j, t in sets:
            if i < j and s and t and 100 * len(s & t) >= percent * len(s | t):
                union.link(i, j)
    return {i: (len(s), union.root(i)) for i, s in sets}


def some_texts(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(40)]
    rows, k = [], 0
    for b in base:
        for _ in range(int(rng.integers(1, 8))):
            t = list(b)
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(0, len(t)))] = "changed"
            rows.append((k, " ".join(t)))
            k += 1
    chain = list(rng.choice(vocabulary, 200))
    for _ in range(30):  # each like the one before it, the ends unlike
        chain = chain[6:] + list(rng.choice(vocabulary, 6))
        rows.append((k, " ".join(chain)))
        k += 1
    return rows + [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "two words"), (k + 4, "Two  WORDS"), (k + 5, rows[0][1]), (k + 6, "é ü 漢 字 ß"), (k + 7, " ".join(["same"] * 30_000)), (k + 8, "same same same")]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 1500), (5, 80, 1500), (3, 85, 4)])
def test_near_duplicates(spark, words, percent, block):
    rows = some_texts(np.random.default_rng(1))
    df = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, id int, kept boolean")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, words=words, percent=percent, block=block).collect()}
    assert got == groups_by_hand(rows, words, percent)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=repr)
    assert [g[:3] for g in got if g[0]] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_same_as_sql(spark, sf):
    assert_same(QUERIES["op5_near_duplicates"](spark, sf), SQL["op5_near_duplicates"], sf)


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(2)
    name = rng.permutation(3000)
    links = [(int(name[i]), int(name[i + 1])) for i in range(1999)] + [(int(name[i]), int(name[i + 1])) for i in range(2000, 2999)]
    df = spark.createDataFrame(links, "a long, b long").repartition(64)
    got = dict(map(tuple, groups.components(df, Tables(spark)).collect()))
    assert got == {int(n): int(name[:2000].min() if k < 2000 else name[2000:].min()) for k, n in enumerate(name)}


def test_super_min_hash_estimates():
    rng = np.random.default_rng(4)
    off = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.sort(pool[:220]), np.sort(pool[60:])
        s = neardup.signatures([a, b])
        off.append((s[0] == s[1]).mean() - 160 / 300)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06
