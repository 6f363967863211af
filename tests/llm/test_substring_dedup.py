from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from outcomelens.llm import substring_dedup as S
from outcomelens.llm.common import keyed

SCHEMA = "_file string, doc_id long, text string, start int"


def brute(rows, window):
    """(words, spans removed, text kept) of each row, with rows of one doc_id in the order given."""
    seen: set = set()
    out = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][1] is None, rows[k][1] or 0, k)):
        words = (rows[k][2] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        spans = []
        for i, g in enumerate(gone):
            if g and i and gone[i - 1]:
                spans[-1][1] = i + 1
            elif g:
                spans.append([i, i + 1])
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out[k] = (len(words), sum(gone), [tuple(s) for s in spans], kept)
    return [out[k] for k in range(len(rows))]


def corpus(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["ä", "b\xa0c", "\x00"]
    passages = [[r.choice(vocabulary) for _ in range(r.randrange(5, 60))] for _ in range(12)]
    rows = []
    for k in range(n):
        words: list[str] = []
        for _ in range(r.randrange(5)):
            words += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randrange(40))]
        rows.append(("x", r.randrange(10 * n), r.choice([" ", "\n\t"]).join(words), k))
    rows += [("x", 5, None, 0), ("x", 6, "", 0), ("x", 7, " ", 0), ("x", None, rows[0][2], 0), ("x", None, rows[1][2], 0), ("x", 8, "again " * 400, 0)]
    return rows + [("x", 9, " ".join(["a b c d e f g"] * 30), 0), ("x", 9, " ".join(["a b c d e f g"] * 30), 1)]


def shown(frame):
    return [(r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept) for r in frame.collect()]


@pytest.mark.parametrize(("seed", "window", "anchor", "words", "most"), [(1, 20, 6, 500_000, 20_000), (2, 20, 6, 300, 3), (3, 5, 2, 200, 1), (4, 1, 1, 100, 2)])
def test_against_all_windows(spark, scratch, seed, window, anchor, words, most):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)  # rows of one id keep the order they are stored in
    got = S.drop_repeats(docs, scratch, window, anchor, shard_words=words, most=most)
    assert got.columns == ["_file", "doc_id", "start", "n_words", "n_removed", "removed", "kept"]
    want = brute(rows, window)
    assert sorted(shown(got)) == sorted(want)
    assert sorted(((r.doc_id, r.n_removed) for r in got.collect()), key=repr) == sorted(((row[1], w[1]) for row, w in zip(rows, want, strict=True)), key=repr)


def test_rows_from_files_are_not_written_again(spark, scratch):
    rows = corpus(5)
    stored = scratch.table(spark.createDataFrame([(*r[:2], r[2], r[3]) for r in rows], SCHEMA).coalesce(1))
    held = len(scratch.paths)
    key = keyed(stored.where("start >= 0").drop("_file"), scratch)
    assert len(scratch.paths) == held and key.select("_at").distinct().count() == len(rows)
    assert sorted(shown(S.drop_repeats(stored, scratch))) == sorted(brute(rows, 20))
    keyed(stored.union(stored).drop("_file"), scratch)
    assert len(scratch.paths) > held


def test_one_passage_in_a_third_of_all_rows_and_many_contexts(spark, scratch):
    """The passage is one row from its shuffle on; the windows around it go by window, not to the passage's shard."""
    common = " ".join(f"c{k}" for k in range(30))
    rows = [("x", k, " ".join([f"a{k}.{j}" for j in range(8)] + [common] * (k % 3 == 0) + [f"b{k}.{j}" for j in range(8)]), 0) for k in range(3000)]
    got = S.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(8), scratch, most=50)
    assert {(r.doc_id % 3 == 0 and r.doc_id > 0, r.n_removed) for r in got.collect()} == {(False, 0), (True, 30)}


def test_very_long_texts_and_words(spark, scratch):
    r = random.Random(7)
    long = " ".join(str(r.randrange(1000)) for _ in range(150_000))
    rows = [("x", 1, long, 0), ("x", 2, "start " + long[: len(long) // 2], 0), ("x", 3, "q" * 3_000_000, 0), ("x", 4, "q" * 3_000_000 + " x" * 30, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = {r.doc_id: r.n_removed for r in S.drop_repeats(docs, scratch).collect()}
    assert got == {r[1]: w[1] for r, w in zip(rows, brute(rows, 20), strict=True)}


def test_empty_tables_and_clashing_names(spark, scratch):
    assert S.drop_repeats(spark.createDataFrame([], SCHEMA), scratch).count() == 0
    short = spark.createDataFrame([("x", 1, "few words", 0)], SCHEMA)
    assert shown(S.drop_repeats(short, scratch)) == [(2, 0, [], "few words")]
    with pytest.raises(ValueError, match="removed"):
        S.drop_repeats(spark.createDataFrame([], "doc_id long, text string, removed int"), scratch)


def test_backward_search_counts_occurrences():
    r = np.random.default_rng(8)
    for symbols in (1, 2, 5, 70):
        sequence = r.integers(0, symbols, 400)
        index = S.FmIndex(sequence, symbols, 12)
        ring = np.concatenate([sequence, sequence])
        for _ in range(60):
            n, a = int(r.integers(1, 13)), int(r.integers(0, 400))
            pattern = ring[a : a + n]
            low, high = index.one(pattern[-1:])
            for c in pattern[-2::-1]:
                low, high = index.back(np.array([c]), low, high)
            found = sorted(index.suffixes[low[0] : high[0]].tolist())
            assert found == [k for k in range(400) if (ring[k : k + n] == pattern).all()]


def test_wavelet_matrix_counts():
    r = np.random.default_rng(9)
    values = r.integers(0, 21, 300)
    matrix = S.WaveletMatrix(values, 21)
    symbols = np.arange(21)
    base = matrix.down(symbols, np.zeros(21, dtype=np.int64))
    for at in (0, 1, 63, 64, 65, 200, 300):
        assert (matrix.down(symbols, np.full(21, at)) - base == [(values[:at] == s).sum() for s in range(21)]).all()


@pytest.mark.parametrize("piece", [S._PIECE, 40])
def test_passages_cover_each_window_once(monkeypatch, piece):
    monkeypatch.setattr(S, "_PIECE", piece)
    r = random.Random(piece)
    for window, anchor in ((20, 6), (5, 2), (4, 4), (3, 1)):
        texts = [None if r.random() < 0.1 else "".join(r.choice(["a", "bc", "ü ", " ", "\n", "x ", "long" * 9 + " ", "y\x0b"]) for _ in range(r.randrange(120))) for _ in range(40)]
        column = pa.array(range(40), pa.int64())
        batch = pa.RecordBatch.from_arrays([column, column, pa.array(texts, pa.string())], names=["_file", "_at", "text"])
        anchors: dict = {}
        covered = []
        for part in S._cut(window, anchor)(iter([batch.slice(0, 15), batch.slice(15)])):
            for row, _, code, start, n in zip(*part.to_pydict().values(), strict=True):
                words = (texts[row] or "").encode().split()
                for i in range(start, start + n):
                    covered.append((row, i))
                    assert anchors.setdefault(tuple(words[i : i + window]), code) == code
        assert sorted(covered) == [(k, i) for k, t in enumerate(texts) for i in range(len((t or "").encode().split()) - window + 1)]
