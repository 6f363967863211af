from __future__ import annotations

import hashlib
import random

import pytest
from pyarrow import fs

from outcomelens.llm import exact_dedup as D

SCHEMA = "doc_id long, text string, first string, row int"


def corpus(seed, n=500):
    r = random.Random(seed)
    texts = [f"text {k} " * r.randrange(1, 60) for k in range(n // 3)]
    rows = [(k, texts[0] if r.random() < 0.33 else r.choice(texts), f"c{k}", k) for k in range(n)]
    return rows + [(n, None, "x", 1), (n + 1, "", None, 2), (n + 2, " ", "x", 3), (3, rows[3][1], "again", 4), (None, texts[1], "x", 5), (None, None, "x", 6)]


def expected(rows):
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(
        ((i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=repr
    )


@pytest.mark.parametrize(("seed", "room"), [(1, D.TABLE_BYTES), (2, 2000), (3, 1)])
def test_marks(spark, scratch, seed, room):
    rows = corpus(seed)
    got = D.mark_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6), scratch, room=room, fanout=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_drops_rows_and_keeps_their_columns(spark, scratch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = D.drop_duplicates(docs, scratch)
    assert got.columns == docs.columns
    got = got.collect()
    assert {tuple(r) for r in got} <= set(rows)
    assert sorted(r.text or "" for r in got) == sorted({t or "" for _, t, *_ in rows})


def test_spills_until_buckets_fit(tmp_path):
    """A table of two records, texts whose hash codes are all equal, and a recursion that settles every record."""
    r = random.Random(7)
    records = [(k, f"{r.randrange(80)}".encode() * 9) for k in range(700)]
    got = dict(D.grace(records, fs.LocalFileSystem(), str(tmp_path / "s"), room=150, fanout=2))
    first: dict = {}
    for k, c in records:
        first.setdefault(got[k], set()).add(c)
    assert len(got) == 700 and all(len(c) == 1 for c in first.values()) and len(first) == len({c for _, c in records})
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]


def test_equal_codes_do_not_merge_texts(monkeypatch, tmp_path):
    monkeypatch.setattr(D, "hash_code", lambda content: 5)
    got = dict(D.grace([(1, b"a"), (2, b"b"), (3, b"a"), (4, b"c")], fs.LocalFileSystem(), str(tmp_path), room=100, fanout=2))
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_empty_table(spark, scratch):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.mark_duplicates(empty, scratch).count() == 0
    assert D.drop_duplicates(empty, scratch).columns == empty.columns


def test_very_long_texts(spark, scratch):
    long = "ä b " * 1_000_000
    rows = [(1, long, "x", 1), (2, long, "x", 2), (3, long + "c", "x", 3), (4, "short", "x", 4)]
    got = D.mark_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(2), scratch, room=1000, fanout=2).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 2, False), (2, 2, True), (3, 3, True), (4, 4, True)]
