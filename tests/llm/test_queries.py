"""Every registered operator over its whole small table, against SQL or what the tables are known to hold."""

from __future__ import annotations

import re
from html import unescape

import duckdb
import pytest

import __spark_entry__ as entry
from outcomelens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


def rows_of(table, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{table}.parquet'").fetchall()


def test_all_are_registered():
    assert [re.match(r"op(\d+)_", q)[1] for q in QUERIES] == [str(k) for k in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = QUERIES[name](spark, FOLDER), con.sql(ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_html_extract", "page_id url text n_chars"),
        ("op2_language_id", "doc_id held_out lang_pred score"),
        ("op3_vector_dedup", "vec_id n_links component_id kept"),
        ("op4_toxicity", "doc_id held_out score predicted"),
        ("op5_warc", "page_id payload_bytes payload_digest record_type refers_to"),
        ("op6_exact_dedup", "doc_id keep_id group_size kept text_sha256"),
        ("op7_mixing", "doc_id size source_size target taken"),
        ("op8_sharding", "doc_id size text_crc32 law shard slot grown_shard"),
        ("op9_ngram_join", "doc_id n_shingles component_id"),
        ("op11_periodic_runs", "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"),
        ("op12_substring_dedup", "doc_id n_words n_removed kept_sha256"),
    ],
)
def test_one_row_per_row(spark, name, columns):
    got = QUERIES[name](spark, FOLDER)
    table, key = {"op1": ("pages", "page_id"), "op3": ("embeddings", "vec_id"), "op5": ("pages", "page_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    assert set(columns.split()) <= set(got.columns)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in rows_of(table, key))


def test_language_of_held_out_documents(spark):
    lang = dict(rows_of("documents", "doc_id, lang"))
    tested = [r for r in QUERIES["op2_language_id"](spark, FOLDER).collect() if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) > 0.97 * len(tested) > 100


def test_toxicity_of_held_out_documents(spark):
    """Few labels here: precision is what the small table can show."""
    toxic = dict(rows_of("labels", "doc_id, toxic"))
    tested = [r for r in QUERIES["op4_toxicity"](spark, FOLDER).collect() if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in tested) > 0.93 * len(tested) > 50


def test_pages_hold_their_article(spark):
    html = dict(rows_of("pages", "page_id, html"))
    for r in QUERIES["op1_html_extract"](spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", html[r.page_id], re.S)[1]
        first = unescape(re.search(r"<h1>([^<]*)", article)[1]).split()
        assert r.text.split()[: len(first)] == first
        assert "track(" not in r.text and "<p>" not in r.text


def test_mixing_comes_near_its_targets(spark):
    source = dict(rows_of("documents", "doc_id, source"))
    taken, target, largest = {}, {}, {}
    for r in QUERIES["op7_mixing"](spark, FOLDER).collect():
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        largest[s] = max(largest.get(s, 0), r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
