from __future__ import annotations

import random

import numpy as np
import pytest

from outcomelens.llm import periodic_runs as P

SCHEMA = "doc_id long, text string, part string, start long"


def brute(words, least=6, times=4):
    """Every lag at every word; of the lags with the same stretch the smallest."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(seed, count, longest=90):
    r = random.Random(seed)
    for _ in range(count):
        n, letters = r.randrange(longest), r.choice([1, 2, 3, 5, 20])
        words = [str(r.randrange(letters)) for _ in range(n)]
        for _ in range(r.randrange(4) if n else 0):
            a, p = r.randrange(n), r.randrange(1, 12)
            for i in range(a + p, min(n, a + r.randrange(1, 60))):
                words[i] = words[i - p]
        yield words


@pytest.mark.parametrize("lookups", [P.LOOKUPS, 7])
def test_runs_against_every_lag(monkeypatch, lookups):
    monkeypatch.setattr(P, "LOOKUPS", lookups)
    for words in texts(1, 1500):
        assert P.runs_of(P.word_codes(words)) == brute(words)
    for words in texts(2, 300):
        assert P.runs_of(P.word_codes(words), 10, 5) == brute(words, 10, 5)


def test_segments_are_stable_and_hold_every_run():
    for words in texts(3, 300):
        codes = P.word_codes(words)
        parts = P.segments(codes)
        for a, b in parts:
            assert min(np.bincount(codes[a:b])[codes[a:b]]) >= 4 and b - a >= 6
        assert all(any(a <= s and s + n <= b for a, b in parts) for s, n, _ in brute(words))
        assert all(x[1] <= y[0] for x, y in zip(parts, parts[1:], strict=False))


def test_splitting_recurses():
    # x is frequent as a whole, but not between the rare words
    words = ["x", "r1", "x", "r2", "x", "r3", "x", "r4"] + ["a", "b"] * 5
    assert P.segments(P.word_codes(words)) == [(8, 18)]
    assert P.runs_of(P.word_codes(words)) == [(8, 10, 2)]


def test_smallest_period_and_overlaps():
    assert P.runs_of(P.word_codes(list("aaaaaaaa"))) == [(0, 8, 1)]
    assert P.runs_of(P.word_codes(list("aaaaa"))) == []
    assert P.runs_of(P.word_codes(list("abababab"))) == [(0, 8, 2)]
    assert P.runs_of(P.word_codes(list("aaaaaabaaaaaab" * 4))) == brute(list("aaaaaabaaaaaab" * 4))
    assert P.runs_of(P.word_codes([])) == []


def test_very_long_texts():
    one, two = ["a"] * 300_000, [f"w{k % 977}" for k in range(100_000)]
    assert P.runs_of(P.word_codes(one)) == [(0, 300_000, 1)]
    assert P.runs_of(P.word_codes(two)) == [(0, 100_000, 977)]
    r = random.Random(4)
    noise = [r.choice("ab") for _ in range(3000)]
    assert P.runs_of(P.word_codes(noise)) == brute(noise)


def test_rows(spark):
    rows = [(k, " ".join(w), "p", k) for k, w in enumerate(texts(5, 60))]
    rows += [(7, rows[7][1], None, 0), (None, "ab ab\tab\nab ab ab x", "p", 1), (100, None, "p", 2), (101, "", "p", 3), (102, " \x0b ", "p", 4), (103, "ä\xa0b " * 9, "p", 5)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = P.periodic_runs(docs).withColumn("best", P.strongest(P.F.col("runs"))).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "part", "start", "n_words", "runs", "collapsed", "best"}

    def shown(text):
        words = (text or "").encode().split()
        runs = brute(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        return len(words), runs, b" ".join(kept).decode(), best

    want = sorted(((i, p, s, *shown(t)) for i, t, p, s in rows), key=repr)
    assert sorted(((r[0], r[1], r[2], r[3], [tuple(x) for x in r[4]], r[5], r[6] and tuple(r[6])) for r in got), key=repr) == want


def test_empty_table_and_clashing_names(spark):
    assert P.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        P.periodic_runs(spark.createDataFrame([], "text string, runs int"))
    with pytest.raises(ValueError, match="four times"):
        P.runs_of(P.word_codes([]), 6, 3)
