from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from outcomelens.llm import language_id

from .test_ngram_join import brute

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"


@pytest.fixture(autouse=True)
def quick(monkeypatch):
    monkeypatch.setattr(language_id, "Settings", lambda: language_id_settings)


language_id_settings = language_id.Settings(hidden=5, block=48, steps=60, batch=64)


def corpus(seed=1):
    r = random.Random(seed)
    words = {"en": ["the", "thing", "and", "tion", "with"], "de": ["der", "ung", "schön", "und", "ist"]}
    rows = []
    for k in range(220):
        lang = r.choice(["en", "en", "de"])
        base = [r.choice(words[lang]) + str(r.randrange(60)) for _ in range(r.choice([2, 30, 60, 90]))]
        for _ in range(r.choice([1, 1, 2, 3])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                text[r.randrange(len(text))] = r.choice(words[lang])
            rows.append((len(rows), " ".join(text), lang, r.choice(["a", "a", "b", None]), 5, "k", 0.5))
    n = len(rows)
    rows += [(n, None, "en", "a", 0, None, None), (n + 1, "", None, "a", 0, "k", 1.0), (n + 2, "123 ...", "de", "b", 7, "k", 1.0)]
    return rows + [(n + 3, "der ung " * 9_000, None, None, 9, "k", 1.0), rows[5], rows[5]]


def test_stages_on_what_the_one_before_kept(spark, scratch):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    text_of = {r[0]: r[1] for r in rows}
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before, after = kept.collect(), None
        kept = scratch.table(stage(spark, kept, FOLDER), name)
        assert kept.columns == docs.columns
        after = kept.collect()
        ids = [r.doc_id for r in after]
        if name == "language_id":
            assert sorted(ids) == sorted(r[0] for r in rows if r[1] and any(map(str.isalpha, r[1])))
            assert all(r.lang for r in after)
        elif name == "exact_dedup":
            best: dict = {}
            for r in before:
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert sorted(ids) == sorted(best.values())
        elif name == "ngram_join":
            groups = brute([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(ids) == sorted({g[2] for g in groups}) and len(ids) < len(before)
        else:
            assert max(ids.count(i) for i in set(ids)) <= 2 and set(ids) <= {r.doc_id for r in before}
        assert all(r.text == text_of[r.doc_id] for r in after)
    name, stage = P.STAGES[-1]
    packed = stage(spark, kept, FOLDER).collect()
    words = sum(len(r.text.split()) for r in kept.collect())
    assert sum(r.n_tokens for r in packed) == words


def test_empty_documents(spark, scratch):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        docs = scratch.table(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0


def test_run(spark):
    assert P.run(spark, FOLDER).count() > 100
    assert P.ORACLE_SQL is None
