from __future__ import annotations

import random

import numpy as np
import pytest

from outcomelens.llm import language_id as L

SYLLABLES = {"aa": ["the", "tion", "ing", "er", "and"], "bb": ["ung", "schaft", "der", "ö", "ich"], "cc": ["ción", "que", "los", "ñ", "ar"]}


def sentence(language, r, words=40):
    return " ".join("".join(r.choices(SYLLABLES[language], k=r.randrange(1, 4))) for _ in range(words))


def corpus(seed, n=400):
    r = random.Random(seed)
    return [(k, sentence(lang := r.choice(["aa", "aa", "bb", "cc"]), r), lang, "x") for k in range(n)]


SCHEMA = "doc_id long, text string, lang string, score string"
QUICK = L.Settings(hidden=6, block=48, steps=120, batch=96)


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(1) + [(900, None, "aa", "x"), (901, "", "bb", "x"), (902, "12 --- 34!", "cc", "x"), (903, sentence("bb", random.Random(5), 60_000), None, "x"), (None, "the and", None, "x"), (3, "the ing tion", "aa", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept_back = L.held_out("doc_id", 4, 2)
    network = L.learn(docs, ~kept_back, QUICK)
    assert network.languages == ["aa", "bb", "cc"]
    got = L.identify(docs, network)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    out = got.withColumn("held_out", kept_back).collect()
    assert len(out) == len(rows)
    tested = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(tested) > 50
    assert np.mean([r.lang_pred == r.lang for r in tested]) > 0.97
    by_id = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id >= 900}
    assert all((by_id[k].lang_pred, by_id[k].score) == (L.UNKNOWN, 0.0) for k in (900, 901, 902))
    assert by_id[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text", None, "x")], SCHEMA)
    assert L.learn(docs, L.F.lit(True)) is None
    assert [(r.lang_pred, r.score) for r in L.identify(docs, None).collect()] == [(L.UNKNOWN, 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty, L.learn(empty, L.F.lit(True))).count() == 0


QUICK = L.Settings(hidden=4, block=24, steps=30, batch=32)


@pytest.mark.parametrize("languages", [0, 1, 3, 100])
def test_every_label_is_learned_and_none_loses_its_documents(spark, languages):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} " * 20, f"l{k % languages}" if languages else None, "x") for k in range(400)]
    rows += [(900, None, "l0", "x"), (901, "", None, "x"), (902, "12 %", None, "x"), (903, "ä", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    network = L.learn(docs, L.F.lit(True), QUICK)
    assert (network.languages if network else []) == sorted(f"l{k}" for k in range(languages))
    kept = {r.doc_id: r.lang_pred for r in L.recognised(docs, network).collect()}
    assert not {900, 901, 902} & set(kept)
    if languages < 2:
        assert set(kept) == {*range(400), 903} and set(kept.values()) == {"l0" if languages else L.UNKNOWN}


def test_the_bar_is_relative_to_the_number_of_languages():
    bars = [L.least_score(L.Network(["x"] * n, 8)) for n in (1, 2, 4, 100)]
    assert bars[0] == 0 and bars[2] == pytest.approx(0.3) and all(b > 1 / n for b, n in zip(bars[1:], (2, 4, 100), strict=True))


def test_ties_of_hash_and_likelihood(spark):
    rows = [(1, f"text {k}", lang, "x") for k in range(60) for lang in ("b", "a")]  # one id, so one hash
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = (L.learn(d, L.F.lit(True), QUICK, docs_per_language=10) for d in (docs, docs.repartition(5)))
    assert one.languages == ["a", "b"] and all((one.weights[k] == two.weights[k]).all() for k in one.weights)
    flat = L.Network(["b", "a"], 8, {k: v * 0 for k, v in L._start(3, 2, np.random.default_rng(1)).items()})
    assert {r.lang_pred for r in L.identify(docs, flat).collect()} == {"b"}


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame(corpus(2, 600), SCHEMA)
    got = L.sampled(docs.select("doc_id", "lang"), "lang", {"aa": 300, "bb": 150, "cc": 150}, 10, L.F.xxhash64("doc_id"), "doc_id").collect()
    assert {lang: sum(r.lang == lang for r in got) for lang in ("aa", "bb", "cc")} == {"aa": 10, "bb": 10, "cc": 10}


@pytest.mark.parametrize("name", ["xf", "uf", "cf", "vf", "xb", "ub", "cb", "vb", "o"])
def test_gradients_by_differences(name):
    r = np.random.default_rng(3)
    w = L._start(3, 2, r)
    codes, label = r.integers(0, 257, (4, 6)), np.array([0, 1, 1, 0])
    codes[:, 0] = 65
    _, grads = L.loss_and_gradients(w, codes, label)
    flat = w[name].reshape(-1)
    for k in np.argsort(-abs(grads[name].reshape(-1)))[:4]:
        keep, values = flat[k], []
        for step in (1e-5, -1e-5):
            flat[k] = keep + step
            values.append(L.loss_and_gradients(w, codes, label)[0])
        flat[k] = keep
        assert (values[0] - values[1]) / 2e-5 == pytest.approx(grads[name].reshape(-1)[k], abs=1e-6)


def test_labeller_equals_the_trained_network():
    r = np.random.default_rng(4)
    w = L._start(5, 3, r)
    network = L.Network(["a", "b", "c"], 16, w)
    texts = [b"x" * 40, b"hello w\xc3\xb6rld", b"", b"0123456789abcdef"]
    got = L.Labeller(network, rows=2).label(texts)
    for text, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        codes, _ = L._blocks([text], 16)
        if len(codes):
            score = L._run(w, "f", codes)[0] @ w["vf"] + L._run(w, "b", codes)[0] @ w["vb"] + w["o"]
            p = np.exp(score) / np.exp(score).sum(axis=2, keepdims=True)
            total = (p * (codes.T < 256)[:, :, None]).sum(axis=(0, 1))
        assert row == pytest.approx(total / max(1, len(text)), abs=1e-5)
