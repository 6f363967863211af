from __future__ import annotations

import math
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from outcomelens.llm.common import numbered
from outcomelens.llm.queries import QUERIES
from outcomelens.llm.sharding import jump_shard, shard

SCHEMA = "doc_id long, text string, shard string"


def rows_of(n):
    return [(k, f"text {k}" * (k % 5), "x") for k in range(n)] + [(n, None, "x"), (n + 1, "", None), (None, "ä", "x"), (3, "text 3text 3text 3", "x")]


def test_contract(spark, scratch):
    rows = rows_of(600)
    got = shard(spark.createDataFrame(rows, SCHEMA), 8, scratch).collect()
    assert len(got) == len(rows)
    size = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got)
    assert size == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by_shard: dict[int, list[int]] = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key"
        assert r.grown_shard in (r.shard, 8)
    assert set(by_shard) == set(range(8))
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
        assert 40 < len(slots) < 120


@pytest.mark.parametrize(("shards", "more"), [(1, 2), (2, 3), (9, 10), (40, 45), (300, 301)])
def test_appending_shards_moves_keys_into_the_new_ones_only(spark, shards, more):
    got = spark.range(20_000).select(jump_shard(F.col("id"), shards).alias("a"), jump_shard(F.col("id"), more).alias("b")).collect()
    moved = [r for r in got if r.a != r.b]
    assert all(0 <= r.a < shards for r in got)
    assert all(r.b >= shards for r in moved)
    share = 1 - shards / more
    assert abs(len(moved) / len(got) - share) < 0.02
    assert max(abs(sum(r.b == k for r in got) - 20_000 / more) for k in range(min(more, 12))) < 6 * (20_000 / more) ** 0.5


def test_blocks_number_without_gaps(spark, scratch):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = numbered(rows, scratch, ["g"], ["id"], "slot", rows_per_block=37).collect()
    for g in range(3):
        assert sorted(r.slot for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_empty_table(spark, scratch):
    assert shard(spark.createDataFrame([], SCHEMA), 8, scratch).count() == 0


def test_no_python_in_the_plan(spark, scratch):
    plan = shard(spark.createDataFrame(rows_of(5), SCHEMA), 8, scratch)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def jumped(key, shards):
    """The walk as a plain loop, with the hashes of the keys' bytes."""
    start = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    at, ahead, step = -1, 0, 0
    while ahead < shards:
        step += 1
        draw = ((xxhash.xxh64_intdigest(struct.pack("<i", step), seed=start) >> 33) + 1) / 2**31
        at, ahead = ahead, math.floor((ahead + 1) / draw)
    return at


def test_shards_against_a_plain_loop(spark, scratch):
    rows = rows_of(3000)
    got = shard(spark.createDataFrame(rows, SCHEMA), 8, scratch).collect()
    assert all((r.shard, r.grown_shard) == (jumped(r.doc_id, 8), jumped(r.doc_id, 9)) for r in got)


def test_whole_table_against_a_plain_loop(spark):
    folder = "/root/testdata/sf0.01"
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op8_sharding"](spark, folder).collect()
    assert len(got) == len(text)
    assert all((r.size, r.text_crc32, r.shard, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), jumped(r.doc_id, 8), jumped(r.doc_id, 9)) for r in got)


@pytest.mark.parametrize("key", [None, 7])
def test_a_third_of_all_rows_with_one_key(spark, scratch, key):
    """They are dealt out by a number each, so none of the blocks holds them all, and slots stay gapless."""
    rows = spark.range(3000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(key)).alias("id"))
    got = numbered(rows, scratch, ["g"], ["id"], "slot", rows_per_block=100)
    assert got.columns == ["g", "id", "slot"]
    assert sorted(r.slot for r in got.collect()) == list(range(3000))
    marked = next(t for t in (spark.read.parquet(p) for p in reversed(scratch.paths) if "numbered" in p) if "_copy" in t.columns)
    copies = sorted(r[0] for r in marked.where(F.col("id").eqNullSafe(F.lit(key))).select("_copy").collect())
    assert copies[-1000:] == list(range(len(copies)))[-1000:] and len(copies) >= 1000


def test_very_long_texts_and_repeated_rows(spark, scratch):
    rows = [(1, "ä" * 2_000_000, "x"), (1, "ä" * 2_000_000, "x"), (2, "y" * 3_000_000, "x")]
    got = sorted((r.doc_id, r.size, r.slot) for r in shard(spark.createDataFrame(rows, SCHEMA), 1, scratch).collect())
    assert [r[:2] for r in got] == [(1, 4_000_001), (1, 4_000_001), (2, 3_000_001)] and sorted(r[2] for r in got) == [0, 1, 2]
