"""Sharding by jump consistent hashing, in DataFrame expressions only.

A key's pseudo-random walk jumps to ever larger shard numbers; the last one below the number of shards is
its shard. The walk does not depend on the number of shards, so appending a shard moves only the keys
whose walk lands on it. There is no ring table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .common import numbered

#: A walk jumps past n shards in about ln n steps. Beyond this many steps the row raises an error.
MOST_STEPS = 256


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a key of any type; all null keys share a shard.

    A walk has at most ``shards`` jumps, so up to 256 shards every walk ends; with more, one that needs over 256
    jumps (never seen: a million shards take 14 on average) raises an error rather than getting a wrong shard.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    steps = min(shards, MOST_STEPS)

    def jump(walk: Column, step: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, step), 33) + 1) / F.lit(float(2**31))  # in (0, 1]
        further = F.floor((walk["next"] + 1) / draw).cast("long")
        on = walk["next"] < shards
        return F.struct(
            F.when(on, walk["next"]).otherwise(walk["at"]).alias("at"),
            F.when(on, further).otherwise(walk["next"]).alias("next"),
        )

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)
    return F.when(walk["next"] >= shards, walk["at"]).otherwise(
        F.raise_error(F.lit("a jump walk did not end")).cast("long")
    ).cast("int")


def shard(docs: DataFrame, shards: int, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its shard, its slot there, and its shard if one more were appended.

    ``size`` is the UTF-8 length plus 1 (1 for null). A null text has the checksum of an empty one. Slots are
    gapless from 0 in each shard, by blocks, so that no task sorts a whole shard, and rows with one key go to several of them. Texts may have any length. The shard is a function
    of key and shard count; rows with equal keys share a shard. Other columns are not read.
    """
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    return numbered(rows, scratch, ["shard"], [key, "size", "text_crc32"], "slot")
