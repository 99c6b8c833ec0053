"""Operators for groups and tables of any size: quantiles, communities, buckets, adjacency; against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import buckets, communities, graph, quantiles


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_quantiles_equal_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(1)
    rows = [("hot", rng.choice((1.5, 2.0, rng.random(), 1e300 * rng.random(), -1e-300 * rng.random()))) for _ in range(4000)]
    rows += [("one value", 3.0)] * 500 + [("few", float(i)) for i in range(3)] + [("single", -7.25)] + [(None, float(i % 11)) for i in range(100)] + [("nulls", None)] * 4 + [("hot", None)] * 9
    rows += [("special", v) for v in (float("nan"), float("inf"), float("-inf"), 0.0, 1.0)]
    df = spark.createDataFrame([(g, v, "x", 1.0) for g, v in rows], "g string, v double, _q string, q0 double").repartition(7)
    shares = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    got = {r.g: [r[f"q{i}"] for i in range(len(shares))] for r in quantiles.quantiles(df, ["g"], "v", shares).collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == (pytest.approx(want[g], nan_ok=True, rel=1e-12) if want[g] else [None] * len(shares)), g
    assert [tuple(r) for r in quantiles.quantiles(df.where("g = 'few'"), [], "v", [0.5]).collect()] == [(1.0,)]
    assert quantiles.quantiles(df.where("false"), ["g"], "v", [0.5]).collect() == []


def test_quantiles_gather_few_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    df = spark.range(30_000, numPartitions=6).select(F.lit("a").alias("g"), (F.xxhash64("id") % 10_000).cast("double").alias("v"))
    out = quantiles.quantiles(df, ["g"], "v", [0.5, 0.9])
    want = df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.9)))).first()[0]
    assert list(out.first())[1:] == want
    assert "percentile(" not in out._jdf.queryExecution().toString()


# Communities


def plain_modularity(pairs, own):
    m2 = 2 * sum(w for _, _, w in pairs)
    inside, total = {}, {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            total[own[x]] = total.get(own[x], 0) + w
            inside[own[x]] = inside.get(own[x], 0) + (w if own[x] == own[y] else 0)
    return sum(inside[c] / m2 - (total[c] / m2) ** 2 for c in total)


def plain_louvain(pairs):
    """One node at a time in order, then contraction, until modularity stops rising."""
    own = {x: x for p in pairs for x in p[:2]}
    now = list(pairs)
    while True:
        nodes = sorted({x for p in now for x in p[:2]})
        at, k, m2 = {x: x for x in nodes}, dict.fromkeys(nodes, 0.0), 2 * sum(w for *_, w in now)
        near = {x: {} for x in nodes}
        for a, b, w in now:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        total, moved = dict(k), True
        while moved:
            moved = False
            for x in nodes:
                to = {at[x]: 0.0}
                for y, w in near[x].items():
                    to[at[y]] = to.get(at[y], 0) + w
                total[at[x]] -= k[x]
                best = max(to, key=lambda c: (to[c] - k[x] * total[c] / m2, c == at[x]))
                moved |= best != at[x]
                at[x] = best
                total[best] += k[x]
        if len(set(at.values())) == len(nodes):
            return own
        own = {x: at[c] for x, c in own.items()}
        now = [(at[a], at[b], w) for a, b, w in now]


def planted(rng, groups, size, inside, outside):
    pairs = []
    for a, b in itertools.combinations(range(groups * size), 2):
        if rng.random() < (inside if a // size == b // size else outside):
            pairs.append((f"n{a:03}", f"n{b:03}", 1.0))
    return pairs


def ring_of_cliques(n, size):
    pairs = [(f"c{c:02}{i}", f"c{c:02}{j}", 1.0) for c in range(n) for i, j in itertools.combinations(range(size), 2)]
    return pairs + [(f"c{c:02}0", f"c{(c + 1) % n:02}1", 1.0) for c in range(n)]


@pytest.mark.parametrize("pairs", [ring_of_cliques(8, 5), planted(random.Random(2), 4, 14, 0.6, 0.03), [("a", "b", 1.0), ("b", "c", 5.0), ("c", "c", 2.0), ("d", "e", 1.0)]], ids=["ring", "planted", "few"])
def test_louvain(spark, pairs):
    df = spark.createDataFrame([*pairs, (None, "a", 1.0), ("zero", "weight", 0.0)], "src string, tgt string, weight double")
    found, q = communities.louvain(df, "weight", rounds=20)
    own = {r.id: r.community for r in found.collect()}
    assert set(own) == {x for p in pairs for x in p[:2]}
    assert q == pytest.approx(plain_modularity(pairs, own)) and q >= plain_modularity(pairs, plain_louvain(pairs)) - 1e-9
    if pairs[0][0].startswith("c00"):
        assert len(set(own.values())) == 8


def test_louvain_of_nothing(spark):
    found, q = communities.louvain(spark.createDataFrame([], "src string, tgt string"))
    assert found.collect() == [] and q == 0.0


# Buckets


def test_merge_rewrites_what_changes(spark, tmp_path):
    path = str(tmp_path / "t")

    def files():
        return {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}

    def rows():
        return sorted(map(tuple, buckets.current(spark, path).collect()), key=repr)

    keys = spark.createDataFrame([(i,) for i in range(40)], "k long")
    first = keys.select("k", F.concat(F.lit("a"), "k").alias("v")).union(keys.select("k", F.lit("b")))
    assert buckets.current(spark, path) is None
    assert len(buckets.merge(path, keys, first, "k", 8)) == 8 and len(rows()) == 80
    before = files()
    assert buckets.merge(path, keys, first, "k", 8) == [] and files() == before  # again: nothing
    one = spark.createDataFrame([(5, "new")], "k long, v string")
    assert len(buckets.merge(path, one.select("k"), one, "k", 8)) == 1
    changed = {f for f in files().items() if f not in before.items()}
    assert len({str(f[0]).split("_bucket=")[1].split("/")[0] for f in changed}) == 1
    assert [r for r in rows() if r[0] == 5] == [(5, "new")] and len(rows()) == 79
    none = one.where("false")
    gone = spark.createDataFrame([(i,) for i in range(1, 40)] + [(None,)], "k long")
    assert buckets.merge(path, gone, none, "k", 8)
    assert [r[0] for r in rows()] == [0, 0]  # buckets without rows are empty
    nulls = spark.createDataFrame([(None, "x"), (None, "y")], "k long, v string")
    buckets.merge(path, nulls.select("k"), nulls, "k", 8)
    buckets.merge(path, nulls.select("k"), nulls, "k", 8)
    assert len(rows()) == 4
    assert buckets.merge(path, keys.where("false"), none, "k", 8) == []


# Adjacency


def test_levels_don_t_shuffle_edges(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(400)] + [("hub", f"n{i}") for i in range(300)]
    edges = spark.createDataFrame(pairs, "src string, tgt string")
    with graph.Adjacency(edges, buckets=4, hub=50) as kept:
        assert [(r.src, r.parts) for r in kept.hubs.collect()] == [("hub", 6)]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = kept.around(spark.createDataFrame([("n1",)], "id string").repartition(3))._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        plan = plan.split("== Initial Plan ==")[-1]
        joined = plan[plan.index("SortMergeJoin") :]
        left = joined[: joined.index("FileScan")]
        assert "Exchange" not in left and "Bucketed: true" in joined and re.search(r"Exchange hashpartitioning", joined[joined.index("FileScan") :])
        got = {r.id: r.level for r in graph.bfs(kept, spark.createDataFrame([("n1",)], "id string"), 3)[0].collect()}
        again = {r.id: r.level for r in graph.bfs(edges, spark.createDataFrame([("n1",)], "id string"), 3)[0].collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, front = {"n1": 0}, {"n1"}
    for level in (1, 2, 3):
        front = {y for x in front for y in near[x]} - set(want)
        want |= dict.fromkeys(front, level)
    assert got == again == want
    assert not spark.catalog.tableExists(kept.name)


def test_numpy_agrees_on_interpolation(spark):
    x = np.random.default_rng(4).normal(size=999)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert quantiles.quantiles(df, [], "v", [0.123, 0.5]).first() == pytest.approx(tuple(np.quantile(x, [0.123, 0.5])))
