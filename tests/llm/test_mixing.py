from __future__ import annotations

import random
import re

import numpy as np
import pytest

from outcomelens.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, target string"


def corpus(seed, n=3000):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        source = r.choice(["hot"] * 6 + ["b", "Ä", "z", "a", None])
        rows.append((k, " ".join(["w"] * min(400, int(r.lognormvariate(3, 1)))), source, "t"))
    return rows + [(n, None, "b", "t"), (n + 1, "", None, "t"), (n + 2, " \t", "only empty", "t"), (5, rows[5][1], rows[5][2], "t")]


def expected_targets(rows):
    """By handing the excess round until none is above."""
    size: dict = {}
    for _, text, source, _ in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted([s for s in size if s is not None]) + [s for s in size if s is None]
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, full, left = {s: 0.0 for s in names}, set(), 1.5 * sum(size.values())
    while left > 1e-6 and len(full) < len(names):
        total = sum(weight[s] for s in names if s not in full)
        give, left = left, 0.0
        for s in names:
            if s not in full:
                target[s] += give * weight[s] / total
        for s in names:
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s] if s not in full else 0
                target[s] = 2.0 * size[s]
                full.add(s)
    return size, target


@pytest.mark.parametrize(("seed", "block"), [(1, M.BLOCK), (2, 50)])
def test_contract(spark, scratch, seed, block):
    rows = corpus(seed)
    size, target = expected_targets(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = M.mix(docs, scratch, block=block).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s, _ in rows}
    taken = {s: 0 for s in size}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s]
        assert r.target == pytest.approx(target[s], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in size:
        # only the landing can miss, by one document at most
        assert abs(taken[s] - target[s]) <= max((r.size for r in got if source[r.doc_id] == s), default=0)
    again = M.mix(docs.repartition(7), scratch, block=block).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    chance, size = np.full(500, 0.37), r.integers(0, 50, 500).astype(float)
    flown = M._fly(chance, size, np.random.default_rng(2))
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(185, abs=1e-6)
    assert (flown * size).sum() == pytest.approx((chance * size).sum(), abs=1e-4)


def test_equal_sizes_and_inclusion_is_not_biased():
    taken = sum(M._land(M._fly(np.full(40, 0.25), np.full(40, 7.0), np.random.default_rng(k)), np.full(40, 7.0)) for k in range(300))
    assert taken.sum() == 3000
    assert abs(taken / 300 - 0.25).max() < 0.13


def test_mixed_repeats_rows_with_their_columns(spark, scratch):
    rows = corpus(3, 400)[:400]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = {r.doc_id: r.taken // r.size if r.size else 1 for r in M.mix(docs, scratch).collect()}
    got = M.mixed(docs, scratch)
    assert got.columns == docs.columns
    seen: dict = {}
    for r in got.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert {i: n for i, n in counts.items() if n} == seen


def test_empty_table(spark, scratch):
    assert M.mix(spark.createDataFrame([], SCHEMA), scratch).count() == 0


def test_rows_that_share_an_id_keep_their_own_counts(spark, scratch):
    rows = [(None if k % 2 else 7, "w " * (1 + k % 50), "a", k) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k long").repartition(3)
    got = M.mixed(docs, scratch)
    assert got.columns == docs.columns
    taken = [r.k for r in got.collect()]
    size = {k: 1 + k % 50 for *_, k in rows}
    assert set(taken) == set(size) and max(taken.count(k) for k in size) == 2
    assert abs(sum(size[k] for k in taken) - 1.5 * sum(size.values())) <= 50


def test_targets_by_ranges_of_sources(spark, scratch):
    r = random.Random(8)
    rows = [(k, " ".join(["w"] * r.randrange(30)), f"s{r.randrange(300)}" if k % 50 else None, "t") for k in range(900)]
    size, target = expected_targets(rows)
    sizes = spark.createDataFrame(rows, SCHEMA).select("source", M.words(M.F.col("text")).alias("size"))
    got = M.targets(sizes, scratch, range_rows=40).collect()
    assert {x.source: x.source_size for x in got} == size
    assert all(x.target == pytest.approx(target[x.source], abs=1e-6) for x in got)


def test_many_rows_alike_are_dealt_out(spark, scratch):
    """A third of all rows without an id and of one size: no block has more than its share."""
    block = 256
    rows = [(None, "a b c", "hot", "t")] * 6000 + [(k, "w " * (k % 20), "hot", "t") for k in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    apart = M.told_apart(scratch.table(docs.select("doc_id", "source")), scratch, ["doc_id", "source"], block // 4)
    numbers = sorted(x[0] for x in apart.where("doc_id is null").select("_copy").collect())
    assert numbers == list(range(6000)) and apart.where("doc_id is not null and _copy <> 0").isEmpty()
    got = M.mix(docs, scratch, block=block).collect()
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert len(got) == 12_000 and abs(sum(x.taken for x in got) - 1.5 * total) <= 20
    again = M.mix(docs.repartition(3), scratch, block=block).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_very_long_text_and_ties(spark, scratch):
    rows = [(1, "w " * 400_000, "a", "t"), (2, "w " * 400_000, "a", "t"), (3, "w", "b", "t"), (4, "w", "b", "t")]
    got = {x.doc_id: x for x in M.mix(spark.createDataFrame(rows, SCHEMA), scratch).collect()}
    assert got[1].size == 400_000 and got[1].source_size == 800_000 and got[3].target == 4.0
    assert got[1].taken + got[2].taken == 1_200_000 and got[3].taken + got[4].taken == 4
