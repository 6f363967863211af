from __future__ import annotations

import random
import re

import numpy as np
import pytest

from outcomelens.llm import ngram_join as J


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(rows, n, percent):
    """Component of every row, by comparing all pairs."""
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least: dict[int, int] = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [(doc, len(s), least.get(find(k))) for k, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, docs=240, long=90):
    """Families of texts with edits around the threshold, shared passages, short texts and copies."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = r.choices(vocabulary, k=25)
    rows = []
    while len(rows) < docs:
        base = r.choices(vocabulary, k=r.choice([2, 4, 6, 9, 15, 30, 60, long]))
        if r.random() < 0.5:
            base = passage + base if r.random() < 0.5 else base + passage
        for _ in range(r.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocabulary).upper()
            rows.append((len(rows) * 3 % 1009, r.choice([" ", "\t", "\n "]).join(words)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, rows[0][1]), (5004, rows[0][1]), (None, rows[1][1]), (None, "alone here")]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85), (4, 3, 60)])
def test_same_components_as_all_pairs(spark, scratch, seed, n, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", J.F.lit(1)).repartition(5)
    got = J.jaccard_components(docs, scratch, n, percent).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(rows, n, percent), key=key)
    leaders = [r.component_id for r in got if r.leader and r.component_id is not None]
    assert len(leaders) == len(set(leaders)) == len({r.component_id for r in got if r.component_id is not None})


def test_large_cells_are_tiled_and_looked_at_again(spark, scratch, monkeypatch):
    """Tiny tiles and leaves force trees, tile pairs and the second round."""
    monkeypatch.setattr(J, "TILE", 20)
    monkeypatch.setattr(J, "LEAF", 2)
    monkeypatch.setattr(J, "PAIRS_A_SET", 1)
    r = random.Random(9)
    base = [f"w{k}" for k in r.choices(range(500), k=80)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(k % 9):
            words[r.randrange(80)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.jaccard_components(docs, scratch).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 85))


def test_empty_table(spark, scratch):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), scratch).count() == 0


def test_linked_sets_share_a_key():
    """Sets at the threshold whose differences are spread as widely as they can still meet in a cell."""
    r = np.random.default_rng(3)
    for size in [7, 8, 12, 19, 20, 33, 60, 200, 900]:
        for _ in range(60):
            most = size * 15 // 100
            gone = int(r.integers(0, most + 1))
            x = r.integers(0, 2**63, size).astype(np.uint64)
            more = int(r.integers(0, most + 1))
            y = np.concatenate([x[gone:], r.integers(0, 2**63, more).astype(np.uint64)])
            shared, union = size - gone, size + more
            if 100 * shared < 85 * union or not gone + more:
                continue
            one = next(c for c in J.classes_up_to(2000, 85) if c.low <= max(len(x), len(y)) < c.high)
            assert gone + more <= one.touched
            assert set(J.slice_keys(x, one)) & set(J.slice_keys(y, one))
            vectors = np.stack([np.frombuffer(J.count_vector(v, one), np.uint8) for v in (x, y)])
            assert J.overlap_bound(vectors, np.array([0]), np.array([1]))[0] >= shared


def test_tree_finds_what_all_pairs_find():
    r = np.random.default_rng(5)
    centre = r.integers(0, 6, (12, 32))
    points = np.clip(np.repeat(centre, 25, axis=0) + r.integers(-1, 2, (300, 32)), 0, 255).astype(np.uint8)
    points[:2] = 255
    sizes = points.sum(axis=1, dtype=np.int64)
    i, j = np.triu_indices(300, 1)
    close = J.close_pairs(points, sizes, i, j, 85)
    found = [(min(a, b), max(a, b)) for x, y in J.RTree(points, sizes, 8).join(85) for a, b in zip(x, y, strict=True)]
    assert sorted(found) == sorted(zip(i[close], j[close], strict=True))


def test_very_long_texts_and_groups_of_near_copies(spark, scratch):
    """A text of 60,000 words and its near copy; a group in which only neighbours link is one component."""
    r = random.Random(12)
    words = [str(r.randrange(5000)) for _ in range(60_000)]
    other = list(words)
    for k in range(0, 60_000, 3000):
        other[k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:30_000]))]
    chain = [str(k) for k in range(200)]
    rows += [(100 + k, " ".join(chain[2 * k : 2 * k + 100])) for k in range(40)]
    got = {x.doc_id: x.component_id for x in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 5, 80).collect()}
    assert [got[k] for k in (1, 2, 3)] == [1, 1, 3] and {got[100 + k] for k in range(40)} == {100}


@pytest.mark.parametrize("rounds", [1, 3, 8])
def test_rounds_of_keys_lose_no_link(spark, scratch, monkeypatch, rounds):
    r = random.Random(rounds)
    rows = []
    for _ in range(25):
        base = [str(r.randrange(300)) for _ in range(r.choice([12, 60, 140]))]
        for _ in range(4):
            text = list(base)
            for _ in range(r.choice([0, 1, 2])):
                text[r.randrange(len(text))] = "x" + str(r.randrange(9))
            rows.append((len(rows), " ".join(text)))
    monkeypatch.setattr(J, "ROUNDS", rounds)
    found = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch, 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(brute(rows, 4, 85))
    assert sum("/round-" in path for path in scratch.paths) == rounds


def test_texts_of_files_are_not_written_again(spark, scratch, tmp_path):
    base = " ".join(str(k) for k in range(90))
    rows = [(7, base, "a"), (3, base + " end", "b"), (3, base + " end", "c"), (5, "other words " * 30, "d"), (None, None, "e")]
    spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(2).write.parquet(f"{tmp_path}/docs")
    kept = J.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/docs"), scratch)
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(found, key=str) == sorted([(3, base + " end"), (5, "other words " * 30), (None, None)], key=str)
    for path in scratch.paths:
        assert "string" not in dict(spark.read.parquet(path).dtypes).values()


def test_points_are_kept_small_and_come_back_whole():
    one = J.size_class(12, 80)
    codes = np.arange(one.low, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    point = J.count_vector(codes, one)
    assert len(J._packed(point)) < len(point)
    assert J.zlib.decompress(J._packed(point), -15) == point
