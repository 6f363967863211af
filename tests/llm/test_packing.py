from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from outcomelens.llm import common
from outcomelens.llm.packing import best_bounds, pack

SCHEMA = "doc_id long, text string, bucket string"


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= size) - size) for size, n in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_bounds_pad_the_least(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 60), r.randrange(1, 9)))
    counts = [r.randrange(1, 30) for _ in lengths]
    for buckets in (1, 2, 3, 5):
        got = best_bounds(lengths, counts, buckets)
        assert got == sorted(set(got)) and len(got) <= buckets and got[-1] == lengths[-1]
        options = [[*c, lengths[-1]] for k in range(buckets) for c in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1))]
        assert padding(lengths, counts, got) == min(padding(lengths, counts, o) for o in options)


def test_no_lengths():
    assert best_bounds([], [], 4) == []


def test_batches(spark, scratch):
    r = random.Random(4)
    rows = [(k, "w " * r.choice([1, 3, 9, 40, 41, 300]), "x") for k in range(400)]
    rows += [(400, None, "x"), (401, "", "x"), (402, "w " * 5000, None), (7, rows[7][1], "x"), (None, "a b", "x")]
    got = pack(spark.createDataFrame(rows, SCHEMA), scratch, budget=1000, buckets=3, longest=500).collect()
    words = {}
    for i, text, _ in rows:
        words.setdefault(i, []).append(len((text or "").split()))
    pieces: dict = {}
    for p in got:
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == set(words)
    for i, own in pieces.items():
        assert sum(p.n_tokens for p in own) == sum(words[i])
        assert all(p.start == 500 * p.piece and p.n_tokens <= 500 for p in own)
    batches: dict = {}
    for p in got:
        if p.n_tokens == 0:
            assert p.bucket is None and p.batch is None
            continue
        assert p.n_tokens <= p.pad_to
        batches.setdefault((p.bucket, p.batch), []).append(p)
    room = {p.bucket: 1000 // p.pad_to for p in got if p.n_tokens}
    for (bucket, _), own in batches.items():
        assert len(own) * own[0].pad_to <= 1000
        assert sorted(p.place for p in own) == list(range(len(own)))
    for bucket, most in room.items():
        sizes = [len(own) for (b, _), own in batches.items() if b == bucket]
        assert sum(s < most for s in sizes) <= 1
        assert {n for b, n in batches if b == bucket} == set(range(len(sizes)))
    lengths: dict = {}
    for p in got:
        if p.n_tokens:
            lengths[p.n_tokens] = lengths.get(p.n_tokens, 0) + 1
    assert sorted({p.pad_to for p in got if p.n_tokens}) == best_bounds(sorted(lengths), [lengths[k] for k in sorted(lengths)], 3)


def test_own_lengths_and_empty_table(spark, scratch):
    docs = spark.createDataFrame([(1, "abc", "x"), (2, None, "x")], SCHEMA)
    got = pack(docs, scratch, length=F.length("text")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 3), (2, 0)]
    assert pack(spark.createDataFrame([], SCHEMA), scratch).count() == 0


def test_many_rows_with_one_key_and_a_very_long_text(spark, scratch, monkeypatch):
    """Pieces of rows alike are dealt out; batches hold as many rows as the budget allows and no place is taken twice."""
    from outcomelens.llm import packing

    monkeypatch.setattr(packing, "numbered", lambda *a: common.numbered(*a, rows_per_block=50))
    rows = [(None, "a b c", "x")] * 400 + [(k, "w " * (k % 9), "x") for k in range(300)] + [(500, "w " * 100_000, "x")]
    got = pack(spark.createDataFrame(rows, SCHEMA), scratch, budget=4096, longest=1024).collect()
    assert sum(r.n_tokens for r in got) == sum(len(t.split()) for _, t, _ in rows)
    places = [(r.bucket, r.batch, r.place) for r in got if r.bucket is not None]
    assert len(set(places)) == len(places)
    full = {}
    for r in got:
        if r.bucket is not None:
            full[r.bucket, r.batch] = full.get((r.bucket, r.batch), 0) + r.pad_to
    assert max(full.values()) <= 4096
