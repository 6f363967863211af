from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcomelens.llm import toxicity as T
from outcomelens.llm.language_id import held_out

BAD = ["vilex", "grotk", "snarv"]


def corpus(seed, n=700):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnr')}{r.choice('aeiou')}{r.randrange(4)}" for _ in range(r.randrange(3, 60))]
        toxic = int(r.random() < 0.25)
        for _ in range(toxic * r.randrange(1, 4)):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "ish", "ly!", "ed"]))
        rows.append((k, " ".join(words), f"lang{toxic}"))
        if k % 10 < 9:
            labels.append((k, toxic, 1 - toxic))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, toxic string", "doc_id long, toxic int, quality int"


def test_held_out_scores_and_spans(spark):
    rows, labels = corpus(1)
    rows += [(5000, None, ""), (5001, "", ""), (5002, "?! 12", ""), (5003, "bala1 " * 50_000 + "vilexish", ""), (None, "grotk", ""), (3, "snarvly!", "")]
    labels += [(1, None, 0), (2, 7, 0), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    kept_back = held_out("doc_id", 5, 0)
    field = T.learn(docs, marks, ~kept_back)
    got = T.score(docs, field).withColumn("held_out", kept_back).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    text = {i: t for i, t, _ in rows}
    truth = {i: int(any(b in t for b in BAD)) for i, t, _ in rows if t}
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert len(tested) > 80
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.98
    for r in tested:
        if r.doc_id != 3:
            assert all(any(b in text[r.doc_id][s.begin : s.end] for b in BAD) for s in r.spans)
    special = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 5000}
    assert all(special[k].predicted == 0 and special[k].spans == [] for k in (5000, 5001, 5002))
    assert special[5003].predicted == 1 and [(s.begin, s.end) for s in special[5003].spans] == [(300_000, 300_008)]


def test_nothing_to_learn_from(spark):
    docs, marks = spark.createDataFrame([(1, "a", "")], DOCS), spark.createDataFrame([(1, 0, 1)], LABELS)
    assert T.learn(docs, marks, F.lit(True)) is None
    assert [(r.score, r.predicted) for r in T.score(docs, None).collect()] == [(0.0, 0)]
    empty = spark.createDataFrame([], DOCS)
    assert T.score(empty, T.learn(empty, spark.createDataFrame([], LABELS), F.lit(True))).count() == 0


def all_paths(emit, start, step):
    """Partition and marginals of one sequence by listing every labelling."""
    total, on = 0.0, np.zeros(len(emit))
    for path in itertools.product((0, 1), repeat=len(emit)):
        value = start * path[0] + sum(e * y for e, y in zip(emit, path, strict=True)) + sum(step[a][b] for a, b in itertools.pairwise(path))
        total += np.exp(value)
        on += np.exp(value) * np.array(path)
    return np.log(total), on / total


def test_forward_backward_against_all_labellings():
    r = np.random.default_rng(2)
    emit, step = r.normal(size=(5, 6)), r.normal(size=(2, 2))
    real = np.arange(6) < np.array([6, 5, 3, 1, 2])[:, None]
    total, p, _ = T.forward_backward(emit * real, 0.4, step, real)
    for k in range(5):
        want, on = all_paths(emit[k][real[k]], 0.4, step)
        assert total[k] == pytest.approx(want)
        assert p[k][real[k]] == pytest.approx(on)


def test_tagger_against_all_labellings():
    field = T.Field({"=bad": 2.0, "terr": 1.5}, -1.0, 0.3, np.array([[0.2, -0.7], [0.1, 0.5]]), np.array([0.0, 1.0, 0.0]))
    texts = ["a bad Terrible day", "", "bad", "one two three bad, four bad terrific"]
    p, begin = T.Tagger(field).marginals(texts)
    for k, text in enumerate(texts):
        emit = [-1.0 + sum(field.weights.get(f, 0) for f in T.features(t)) for t in text.split()]
        assert p[begin[k] : begin[k + 1]] == pytest.approx(all_paths(emit, 0.3, field.step)[1] if emit else [])
