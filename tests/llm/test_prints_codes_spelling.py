"""Winnowing, vector codes and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from loomline.llm import codes, spelling, winnowing
from loomline.llm.registry import QUERIES, SQL
from loomline.llm.shared import Tables

# Winnowing


def prints_by_hand(text, gram=16, window=32):
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    if not len(points):
        return []
    grams = [points[i : i + gram] for i in range(max(1, len(points) - gram + 1))]
    h = np.array([int(winnowing.gram_hashes(g, gram)[0]) >> 19 for g in grams] if len(points) < 500 else winnowing.gram_hashes(points, gram) >> np.uint64(19), np.int64)
    last = np.lib.stride_tricks.sliding_window_view(h[::-1], min(window, len(h))).argmin(1)  # from the right, so the rightmost of equal ones
    kept = {len(h) - 1 - int(s + k) for s, k in enumerate(last)}
    h = h.tolist()
    return [(h[p] >> 1, p) for p in sorted(kept)]


def compared_by_hand(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (doc_id, text)."""
    order = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None] * any(i is None for i, _ in rows)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    least = {i: min((t or "" for j, t in rows if j == i), key=str.encode) for i in order}
    out = []
    for i, t in rows:
        t, other = t or "", least[after[i]]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        own, edits, others = prints_by_hand(t), prints_by_hand(edited), prints_by_hand(other)

        def spelt(entries):
            return "".join(f"{h >> 12:08x}{p - before:02x}" for (h, p), before in zip(entries, [0] + [p for _, p in entries], strict=False))

        def alike(a, b):
            a, b = {h for h, _ in a}, {h for h, _ in b}
            return len(a & b) / len(a | b) if a | b else 1.0

        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), spelt(own), spelt(edits), alike(own, edits), alike(own, others)))
    return sorted(out, key=repr)


def test_rolling_hashes_are_those_of_each_gram():
    points = np.random.default_rng(1).integers(1, 0x10FFFF, 200).astype(np.uint32)
    for gram in (1, 2, 7, 16, 31):
        found = winnowing.gram_hashes(points, gram)
        assert len(found) == 200 - gram + 1
        assert found.tolist() == [int(winnowing.gram_hashes(points[i : i + gram].copy(), gram)[0]) for i in range(len(found))]


@pytest.mark.parametrize("window", [1, 2, 5, 32, 100])
def test_windows(window):
    h = np.random.default_rng(2).integers(0, 6, 90).astype(np.uint64) << np.uint64(30)
    kept = {s + max(i for i, x in enumerate(h[s : s + window]) if x == min(h[s : s + window])) for s in range(max(1, 90 - window + 1))}
    assert winnowing.least_of_windows(h, window).tolist() == sorted(kept)


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = "".join(random.Random(3).choices("abcé漢𝄞 ", k=3000)) + "ab" * 300 + "x" * 500
    whole = [list(map(int, x)) for x in winnowing.winnowed(text)]
    assert list(zip(*whole, strict=True)) == prints_by_hand(text)
    for block in (1, 37, 64, 1000):
        monkeypatch.setattr(winnowing, "BLOCK", block)
        assert [list(map(int, x)) for x in winnowing.winnowed(text)] == whole


def test_shared_passages_share_an_entry():
    rng = random.Random(4)
    for _ in range(50):
        passage = "".join(rng.choices("abcdefgh", k=winnowing.GRAM + winnowing.WINDOW - 1))
        a, b = ("".join(rng.choices("klmnop", k=rng.randrange(200))) + passage + "".join(rng.choices("qrst", k=rng.randrange(200))) for _ in range(2))
        assert set(winnowing.winnowed(a)[0].tolist()) & set(winnowing.winnowed(b)[0].tolist())


@pytest.mark.parametrize("part_chars", [1 << 20, 300])
def test_neighbours_compared(spark, part_chars):
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choices("ab é漢", k=rng.choice((0, 1, 15, 16, 47, 48, 300))))) for i in range(60)]
    rows += [(7, None), (9, ""), (12, "z" * 100), (12, "a" * 100), (12, None), (None, "no id" * 20), (None, "nor this" * 9), (177, "twice" * 12), (177, "also the last id" * 3), (-5, "x" * 70)]
    df = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, part string, _p int, before boolean").repartition(5)
    got = sorted(map(tuple, winnowing.neighbours_compared(df, part_chars=part_chars).collect()), key=repr)
    assert got == compared_by_hand(rows)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(None, "b" * 60), (None, "ab" * 30), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, winnowing.neighbours_compared(df).collect()), key=repr) == compared_by_hand([tuple(r) for r in df.collect()])
    one = spark.createDataFrame([(4, "the only one, compared with itself, its halves swapped")], "doc_id long, text string")
    assert [tuple(r) for r in winnowing.neighbours_compared(one).collect()] == compared_by_hand([tuple(r) for r in one.collect()])
    assert winnowing.neighbours_compared(one.where("false")).collect() == []


def test_op11_against_the_definition(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_fingerprints"](spark, sf).collect()]
    assert sorted(got, key=repr) == compared_by_hand(rows)


def test_fingerprint_column(spark):
    df = spark.createDataFrame([("abc" * 40,), (None,), ("",), ("short",)], "text string")
    got = [[tuple(e) for e in r[0]] for r in df.select(winnowing.fingerprints(df)).collect()]
    assert got == [prints_by_hand(t) for t in ("abc" * 40, None, "", "short")]


# Vector codes


def codes_by_hand(rows, parts, entries, rounds):
    """(vec_id, code, error) of (vec_id, vector), and the codebooks, by plain rounds over whole numbers."""
    rows = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for _, x in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, own in held.items():
                books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(rows, found, strict=True)], books


@pytest.mark.parametrize("seed", range(6))
def test_bounds_give_plain_rounds_with_fewer_distances(seed):
    rng = np.random.default_rng(seed)
    # few values, so that ties abound; or clusters, where bounds hold
    x = rng.integers(-2, 3, (700, 2, 2)) if seed % 2 else (rng.integers(-9, 9, (700, 2, 2)) * 500 + rng.integers(-9, 9, (700, 2, 2)))
    entries = x[:40].transpose(1, 0, 2).copy()
    books = codes.Codebooks(entries, codes.grouped(entries), np.zeros(entries.shape[:2]))
    own = low = None
    taken = []
    for _ in range(5):
        own, far, low, n = codes.assign(x, books, own, low)
        every = ((x.transpose(1, 0, 2)[:, :, None] - books.entries[:, None]) ** 2).sum(3)
        assert (own == every.argmin(2).T).all() and (far == every.min(2).T).all()
        every[np.arange(2)[:, None], np.arange(700), own.T] = 1 << 60
        for g in range(int(books.group.max()) + 1):
            least = np.sqrt(np.where(books.group[:, None] == g, every, 1 << 60).min(2).T.astype(float))
            assert ((low[:, :, g] <= least) | (least >= 1 << 30)).all()  # bounds hold, but where a group has no other entry
        taken.append(n)
        moved = books.entries.copy()
        for p in range(2):
            for e in np.unique(own[:, p]):
                moved[p, e] = x[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
        books = codes.Codebooks(moved, books.group, np.sqrt(((moved - books.entries).astype(float) ** 2).sum(2)))
    assert taken[0] == 700 * 2 * 40
    if not seed % 2:
        assert taken[-1] < taken[0] / 2


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(400, 430)] + [(7, [0.5] * 8), (7, [-0.001] * 8), (None, [1.0] * 8)]
    odd = [(900, None), (901, [float("nan")] + [1.0] * 7), (902, [None] + [1.0] * 7), (903, [float("-inf")] * 8), (904, []), (905, [1.0] * 4), (906, [1e30] * 8)]
    labels = {r[0]: None if (r[0] or 0) % 3 == 0 else (r[0] or 0) % 5 for r in rows + odd}
    df = spark.createDataFrame([(i, v, labels[i], "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, own string, x int").repartition(4)
    state, books = codes.compressed(df, Tables(spark), parts=4, entries=20, rounds=3, groups=3)
    want, plain = codes_by_hand(rows, 4, 20, 3)
    got = [(r.vec_id, bytes(r.own).hex(), sum(r.far)) for r in state.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert books.entries.tolist() == [[list(e) for e in b] for b in plain]
    assert books.digest() == hashlib.sha256(",".join(str(c) for b in plain for e in b for c in e).encode()).hexdigest()


def test_codes_of_few(spark):
    df = spark.createDataFrame([(2, [0.5] * 6, "a"), (1, [0.25] * 6, None)], "vec_id long, embedding array<double>, label string")
    state, books = codes.compressed(df, Tables(spark), parts=4)  # padded to eight components
    assert {r.vec_id: bytes(r.own).hex() for r in state.collect()} == {1: "00000000", 2: "01010100"}
    assert books.entries.shape == (4, 2, 2)
    state, books = codes.compressed(df.where("false"), Tables(spark))
    assert state.collect() == [] and books is None


def test_sums_of_labels(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=16)], None if i % 4 == 0 else i % 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op12_codes"](spark, str(tmp_path)).collect()
    want, _ = codes_by_hand([r[:2] for r in rows], 16, 64, 2)
    total = Counter()
    for i, _, error in want:
        total[rows[i][2]] += error
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, total[rows[i][2]]) for i, c, e in want)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert QUERIES["op12_codes"](spark, str(tmp_path / "none")).collect() == []


# Spelling variants


def variants_by_hand(rows):
    n = Counter()
    letters = {*map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x100))}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in "".join(c if c in letters else " " for c in low).split(" "):
            if run:
                h = crc32(f"{'' if i is None else i}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 2 * n[w] else None for w, x in found.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(found[w]), n[form[w]] if form[w] else None) for w in n)


def words_of(rng, rows):
    base = ["".join(rng.choices("abceé", k=rng.randrange(5, 9))) for _ in range(60)] + ["Straßen", "ÀÉÎÕü", "x×÷yzz", "a" * 400, "a" * 401, "a" * 200 + "b" + "a" * 200]
    return [(i, " ".join(rng.choice(base)[: rng.choice((4, 5, 6, 999))] + rng.choice(("", ".", "s", "A")) for _ in range(40))) for i in range(rows)]


@pytest.mark.parametrize("block", [spelling.BLOCK_BYTES, 200])
def test_variants(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_BYTES", block)
    rows = [*words_of(random.Random(6), 150), (3, None), (4, ""), (5, "4 5-6"), (None, "nobody nobody nobody nobodx"), (2, "repeated " * 30), (2, "repeated " * 30), (8, "ñandúes " * 9 + "nandúes " * 4)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, mask int").repartition(3)
    tables = Tables(spark)
    got = [tuple(r) for r in spelling.variants(tables.put(spelling.words(df)), tables).collect()]
    assert sorted(got) == variants_by_hand(rows)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of forms


def test_no_words(spark):
    tables = Tables(spark)
    df = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert spelling.variants(tables.put(spelling.words(df)), tables).collect() == []
    assert spelling.variants(tables.put(spelling.words(df.where("false"))), tables).collect() == []


def test_long_chains_of_forms(spark):
    n = [("a" * (5 + k), 3 * 2**k) for k in range(12)]
    tables = Tables(spark)
    got = {r.word: r for r in spelling.variants(tables.put(spark.createDataFrame(n, "word string, n long")), tables).collect()}
    assert {r.root for r in got.values()} == {n[-1][0]}
    assert got["aaaaaa"].form == "aaaaaaa" and got["aaaaaa"].n_near == 2 and got[n[-1][0]].form is None


@pytest.mark.parametrize("name", ["op12_codes", "op13_spelling"])
def test_same_as_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), SQL[name], sf)


def test_words_are_counted_in_parts(spark, monkeypatch):
    rows = words_of(random.Random(7), 40)
    found = spelling.words(spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("Word"), "text"), key="Word").collect()
    assert sorted((r.word, r.n) for r in found) == [(r[0], r[3]) for r in variants_by_hand(rows)]
