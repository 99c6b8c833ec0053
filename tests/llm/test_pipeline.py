"""The corpus pipeline: every stage on odd rows and against a plain version, and all stages in a row."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_searching import groups_by_hand
from test_texts import base_by_hand
from test_windows_and_packing import hits_by_hand
from tokenizers import Tokenizer

import corpus_pipeline as C
from loomline.llm import packing, pii, quality

CLASHING = "score predicted kept component_id n_hit n_words items contaminated spans n_email sequence hit _gone _slot _scan0 _pii _key id".split()
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, " ".join(WORDS)), (5, " ".join(WORDS)), (5, " ".join(WORDS)), (6, " ".join(WORDS[:19]) + " changed"), (7, "word " * 30_000), (8, "x" * 200_000), (None, "no id here at all"), (None, None),
    (9, "mail bob@example.com or call +1 (555) 123-4567 from 10.0.0.1"), (10, "the quick brown fox jumps over the lazy dog and runs away"), (11, "é漢字 ß <|endoftext|>"), (4, "another text under the same id"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "Fox jumps over the lazy dog and runs away"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def odd(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(k))
    return docs


@pytest.mark.parametrize(("name", "stage"), C.STAGES)
def test_odd_rows_and_clashing_names(spark, folder, name, stage):
    docs = odd(spark, folder)
    out = stage(spark, docs, folder)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {i for i, _ in ODD}
        return
    assert out.columns == docs.columns and out.schema == docs.schema
    assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in rows)
    got = sorted(((r.doc_id, r.text) for r in rows), key=repr)
    if name == "near_duplicates":
        assert got == sorted(((i, t) for i, t in ODD if i not in (5, 6)), key=repr)
    elif name == "benchmarks":
        assert got == sorted(((i, t) for i, t in ODD if i != 10), key=repr)
    elif name == "personal_data":
        assert got == sorted(((i, "mail [EMAIL] or call [PHONE] from [IP]" if i == 9 else t) for i, t in ODD), key=repr)
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
    else:
        assert len({i in {r.doc_id for r in rows} for i in (1, 2, 3)}) == 1 and set(got) <= set(ODD)


@pytest.mark.parametrize(("name", "stage"), C.STAGES)
def test_empty_table(spark, folder, name, stage):
    none = odd(spark, folder).where("false")
    out = stage(spark, none, folder)
    assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


@pytest.mark.parametrize("name", ["n_chars", "lang"])
def test_a_column_may_be_missing(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop(name)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_all_stages_in_a_row(spark, sf):
    """run() against the stages in plain Python, the trained models apart."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = quality.trained(spark, sf)
    raw = [(t or "").encode() for _, t in docs]
    scores = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    docs = [d for d, s in zip(docs, scores, strict=True) if s >= 0.5]
    groups = groups_by_hand(docs, 5, 80)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    hit = hits_by_hand(docs, items, 10)
    docs = [(i, t) for i, t in docs if not hit[i][4]]
    crf = pii.default_model()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want: dict[int, list] = {}
    for i, t in docs:
        base = base_by_hand(t or "")
        extra = [s for s in pii.crf_spans([t or ""], crf)[0] if not any(s[0] < b and a < s[1] for a, b, _ in base)]
        spans, hidden, at = sorted(base + extra, key=lambda s: (s[0], pii.KINDS.index(s[2]))), "", 0
        for k, (a, b, kind) in enumerate(spans):
            if a >= at:
                end = b
                for x, y, _ in spans[k + 1 :]:
                    end = max(end, y) if x < end else end
                hidden += t[at:a] + f"[{kind.upper()}]"
                at = end
        hidden += (t or "")[at:]
        ids = [*tokenizer.encode(hidden, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [(0, first), *((x, x + 2048) for x in range(first, len(ids), 2048))]
        want[i] = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(cuts)]
    got: dict[int, list] = {}
    places: dict[int, list] = {}
    for r in C.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sorted(x) for i, x in got.items()} == want
    for at in places.values():
        at.sort()
        assert [a for a, _ in at] == np.cumsum([0, *[n for _, n in at]]).tolist()[:-1] and sum(n for _, n in at) <= 2048
