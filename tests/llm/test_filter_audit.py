from __future__ import annotations

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from outcomelens.llm import filter_audit as A

SCHEMA = "doc_id long, text string, lang string, n int, part string"
WORDS = ["Alpha", "beta", "GAMMA", "d#lta", "x|y", "ä", "one", "two"]


def corpus(seed, n=400):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and r.random() < 0.3:
            text = r.choice(rows)[1]
        else:
            few = r.sample(WORDS, r.randrange(1, 6))
            text = " ".join(r.choice(few) + (str(r.randrange(400)) if r.random() < 0.9 else "") for _ in range(r.choice([3, 60, 140])))
        rows.append((k, text, r.choice(["en", "de", "", None]), k, "other"))
    rows += [(3, rows[3][1], "en", 0, None), (3, rows[3][1], "en", 0, None), (None, rows[5][1], "en", 0, None), (None, "", "fr", 0, None)]
    return rows + [(900, None, "de", 0, None), (901, "", "de", 0, None), (902, " \t", "de", 0, None), (903, "w " * 30_000, "de", 0, None), (904, "Q" * 200_000, "de", 0, None)]


def fails(rows):
    """By row: part, doc_id and the letters it fails."""
    out = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = t.encode().split()
        letters = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t))
        letters += "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and any((u or "") == t and j is not None and j < i for j, u, *_ in rows))
        out.append((lang or "", i, letters))
    return out


def by_playing(rows, good, letters="ABCDE"):
    """Every order applied to the rows, one filter after another."""
    failing, out, shares = fails(rows), {}, {}
    for part in {p for p, *_ in failing}:
        mine = [(i, f) for p, i, f in failing if p == part]
        for order in map("".join, permutations(letters)):
            left = mine
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                redundant = sum(x in f for _, f in mine) - len(gone)
                out[part, order, step] = [x, len(left), len(gone), redundant, sum(f == x for _, f in mine), sum(i in good for i, _ in gone)]
                shares[part, x] = shares.get((part, x), 0) + len(gone)
    return sorted((*key, *row, shares[key[0], row[0]]) for key, row in out.items())


def audited(spark, scratch, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sets = A.failure_sets(docs, scratch, A.quality_failures(F.col("text")), F.coalesce("lang", F.lit("")), copies="E")
    sets = A.with_marks(sets, spark.createDataFrame(labels, "doc_id long, quality int, n int"), {"good": F.col("quality") == 1})
    return sorted(map(tuple, A.interactions(sets, "ABCDE", ("good",)).collect()))


def test_against_playing_every_order(spark, scratch):
    rows = corpus(1)
    labels = [(k, k % 2, 0) for k in range(0, 300, 3)] + [(6, 1, 0), (9, None, 0), (None, 1, 0), (5000, 1, 0)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    got = audited(spark, scratch, rows, labels)
    assert got == by_playing(rows, good) and len(got) == 600 * 4


def test_potentials_are_shapley_values(spark):
    rows = [("p", 0b001, 5), ("p", 0b011, 2), ("p", 0b111, 1), ("p", 0, 9), ("q", 0, 4)]
    got = A.interactions(spark.createDataFrame(rows, "part string, failed int, n long"), "xyz").collect()
    share = {(r.part, r.filter): r.shapley for r in got}
    # 3! times: alone 5, half of 2, a third of 1
    assert share == {("p", "x"): 38, ("p", "y"): 8, ("p", "z"): 2, ("q", "x"): 0, ("q", "y"): 0, ("q", "z"): 0}
    assert all(r.kept == 4 and r.removed == 0 for r in got if r.part == "q")


def test_a_text_shared_by_a_third_of_all_rows(spark, scratch):
    """Its rows are joined by text and doc_id: no exchange by the text alone carries them."""
    rows = [(k, "same text" if k % 3 == 0 else f"text {k}", "en", 0, None) for k in range(6000)]
    got = audited(spark, scratch, rows, [(0, 1, 0)])
    e = [r for r in got if r[3] == "E" and r[2] == 1]
    assert {r[5] for r in e} == {1999}


def test_without_copies_and_empty_tables(spark, scratch):
    docs = spark.createDataFrame([(1, "Ab", "x", 0, None)], SCHEMA)
    sets = A.failure_sets(docs, scratch, A.quality_failures(F.col("text")), F.col("lang"))
    assert [tuple(r) for r in sets.collect()] == [(1, "x", 0b101, 1)]
    assert audited(spark, scratch, [], [(1, 1, 0)]) == []
    with pytest.raises(ValueError, match="filters"):
        A.interactions(sets, "AA")
