"""Benchmark windows and packing against brute force and round trips."""

from __future__ import annotations

import hashlib
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm import decontaminate, packing, tokens
from loomline.llm.registry import QUERIES
from loomline.llm.shared import Tables


def words_of(text: str | None) -> list[str]:
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c > "\x7f" or c.isalnum():
            word += c
        else:
            out, word = out + [word] * bool(word), ""
    return out + [word] * bool(word)


def hits_by_hand(docs, items, window):
    wanted: dict[tuple, set] = {}
    for i, t in items:
        w = words_of(t)
        size = min(window, len(w))
        for p in range(len(w) - size + 1) if size else ():
            wanted.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for size in {len(x) for x in wanted}:
            for p in range(len(w) - size + 1):
                if at := wanted.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    found |= at
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def test_windows(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "cé", "d1", "e"], n))
    docs = [(i, text(int(rng.integers(0, 120)))) for i in range(150)] + [(200, None), (201, ""), (202, "a, b; (Cé)"), (203, "a " * 50_000), (204, docs_same := "e e e e"), (205, docs_same)]
    items = [(i, text(int(rng.integers(0, 12)))) for i in range(25)] + [(30, None), (31, ""), (32, "e"), (7, "a b cé"), (33, "a b cé")]
    left = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n_hit int, contaminated int")
    right = spark.createDataFrame(items, "item_id long, text string")
    for more in ({}, {"most": 40}, {"most_chars": 0}, {"most_chars": 0, "bits": 4}, {"most_chars": 0, "hot": 1}, {"most_chars": 0, "hot": 8}):  # all tables to tasks, in parts; joined
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(left, right, window=5, **more).collect()}
        assert got == hits_by_hand(docs, items, 5)
    assert decontaminate.decontaminate(left, right, most_chars=0).columns == decontaminate.decontaminate(left, right).columns
    none = decontaminate.decontaminate(left, right.where("false")).where("contaminated OR n_items > 0")
    assert none.count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=14))
def test_plans_hold_every_piece(counts):
    made = packing.plan(counts, 64, nodes=2000)
    used = Counter()
    for lengths, n in made:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] += n
    assert used == Counter(counts)
    fit = sum(n for _, n in packing._best_fit(counts, 64))
    assert -(-sum(k * v for k, v in counts.items()) // 64) <= sum(n for _, n in made) <= fit


def least_bins(pieces: tuple[int, ...], room: int) -> int:
    """The exact least number of bins, by trying every piece in every bin."""
    best = len(pieces)

    def fit(k: int, free: list[int]) -> None:
        nonlocal best
        if len(free) >= best:
            return
        if k == len(pieces):
            best = len(free)
            return
        for i in range(len(free)):
            if free[i] >= pieces[k] and free[i] not in free[:i]:
                fit(k + 1, [*free[:i], free[i] - pieces[k], *free[i + 1 :]])
        fit(k + 1, [*free, room - pieces[k]])

    fit(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=10))
def test_plans_are_optimal(lengths):
    made = packing.plan(dict(Counter(lengths)), 60)
    assert sum(n for _, n in made) == least_bins(tuple(sorted(lengths, reverse=True)), 60)


def test_the_filling_of_three():
    # 26 + 23 + 11 fill a room of 60 exactly; every greedy completion leaves some free
    have = np.zeros(61, np.int64)
    have[[50, 26, 24, 23, 17, 14, 11, 9]] = 1
    assert next(f for f in packing._fillings(60, have, lambda: 60) if f is not None) == (26, 23, 11)


def test_all_fillings_are_tried_where_likely_ones_miss_the_bound():
    """Lengths whose pairs and triples rarely fit: the full search has steps of its own, and finds better fillings."""
    lengths = np.random.default_rng(5).integers(300, 700, 3000).tolist()
    counts = dict(Counter(lengths))
    told = {}
    found = packing.plan(counts, told=told)
    pieces = Counter()
    for filling, times in found:
        assert sum(filling) <= packing.CAPACITY
        for x in filling:
            pieces[x] += times
    assert pieces == Counter(lengths)
    least = -(-sum(lengths) // packing.CAPACITY)
    used, likely, best_fit = (sum(n for _, n in p) for p in (found, packing.plan(counts, nodes=0), packing._best_fit(counts, packing.CAPACITY)))
    assert told["every"] > 100 and least <= used < likely <= best_fit


def test_bin_completion_beats_best_fit():
    # best fit puts 6 + 4 first and needs three; 6 + 3 + 3 ... fill two exactly
    counts = {44: 2, 24: 2, 28: 1, 36: 1, 16: 0, 40: 2, 20: 4}
    assert sum(n for _, n in packing.plan(counts, 64)) <= sum(n for _, n in packing._best_fit(counts, 64))


def test_two_full_sequences():
    # 1000 + 508 + 300 + 240 and 900 + 450 + 360 + 338
    made = packing.plan(dict.fromkeys((1000, 900, 508, 450, 360, 338, 300, 240), 1))
    assert sorted(sum(lengths) * n for lengths, n in made) == [2048, 2048]


def fillings_by_hand(room, counts):
    """All fillings of which none has lengths, in order, that another's are all at least as large as."""
    every = [()]
    for length, n in counts.items():
        every = [f + (length,) * k for f in every for k in range(n + 1) if sum(f) + k * length <= room]
    every = [tuple(sorted(f, reverse=True)) for f in every]
    return sorted(f for f in every if not any(g != f and len(g) >= len(f) and all(a >= b for a, b in zip(g, f, strict=False)) for g in every))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 24), st.dictionaries(st.integers(1, 24), st.integers(1, 3), max_size=6))
def test_every_undominated_filling(room, counts):
    have = np.zeros(25, np.int64)
    have[list(counts)] = list(counts.values())
    found = [f for f in packing._fillings(room, have, lambda: room) if f is not None]
    assert sorted(found) == fillings_by_hand(room, counts)
    assert [sum(f) for f in found] == sorted(map(sum, found), reverse=True)


def test_more_pieces_than_slots():
    # in a process of its own with a limit of time, as a full table never ends
    code = "import sys; sys.path.insert(0, sys.argv[1])\nimport numpy as np\nfrom loomline.llm.tokens import Numbers\n" \
        "t, h = Numbers(), np.unique(np.random.default_rng(3).integers(1, 1 << 63, 1_300_000, np.uint64))\nnp.random.default_rng(4).shuffle(h)\nt.add(h[:400_000]); t.add(h[400_000:])\n" \
        "print((t.find(h) == np.arange(len(h))).all(), (t.find(h[:1000] + np.uint64(1 << 63)) == -1).all())"  # fmt: skip
    said = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[2])], capture_output=True, text=True, timeout=60)
    assert said.stdout.split() == ["True", "True"], said.stderr


def test_a_text_of_more_pieces_than_are_remembered(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "_SLOTS", 64)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 30)
    encoder = tokens.Encoder(packing.default_tokenizer())
    texts = ["a b c", " ".join(f"w{i}x" for i in range(500)), "a b c d", " ".join(f"v{i}y" for i in range(20))]
    got = [ids.tolist() for t in texts for _, ids in encoder.encode(pa.array([t], pa.string()))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_round_trip(spark, sf):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    assert tokenizer.encode("<|endoftext|> x", add_special_tokens=False).ids == [50256, 2124]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x y " * 20_000), (-4, "<|endoftext|> don't 漢字  \n\n 1½ ´s 'ſ")], "doc_id long, text string"))
    rows = packing.pack(docs).collect()
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc.pop(r.doc_id), key=lambda p: p.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]]).tolist()[:-1]
        assert all(p.length == 2048 for p in pieces[1:]) and sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    assert not by_doc
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in places.values():
        at.sort()
        assert [a for a, _ in at] == np.cumsum([0, *[n for _, n in at]]).tolist()[:-1] and sum(n for _, n in at) <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(places) <= least + max(1, least // 50)


def test_hot_lengths_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 500, "same text here", i) for i in range(3000)] + [(9, None, 0)] * 5 + [(7, "x y " * 3000, 1)] * 2, "doc_id long, text string, length int")
    pieces = Tables(spark).put(packing.token_pieces(docs, packing.default_tokenizer()))
    for rows in (packing.pack(docs).collect(), packing.place(pieces, part_rows=100).collect()):
        assert len(rows) == 3005 + 2 * -(-6001 // 2048) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        places: dict[int, list] = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for at in places.values():
            at.sort()
            assert [a for a, _ in at] == np.cumsum([0, *[n for _, n in at]]).tolist()[:-1] and sum(n for _, n in at) <= 2048


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab Z'’st1½\n\t 　é漢ſ.,!-_́", max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", " ", "<|", "a", "don't", "endoftext|>"]), max_size=6).map("".join), min_size=1, max_size=6))
def test_ids_are_the_library_s(texts):
    import pyarrow as pa

    path = packing.default_tokenizer()
    encoder = tokens.encoder(path)
    got = [ids.tolist() for _, ids in encoder.encode(pa.array(texts, pa.string()))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_query_are_whole(spark, sf):
    rows = QUERIES["op9_pack"](spark, sf)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
