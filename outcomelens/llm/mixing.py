"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is to be taken at the same rate: the whole part of the rate as sure copies, the
rest as an inclusion probability. The flight moves probabilities along the null space of two constraints, the
number of documents and the number of words, until they are 0 or 1: three documents span a plane that has one
free direction. It runs in blocks of a source; what a block leaves open (two documents at most) meets again
in a later round. The last two of a source land on the rounding that comes nearest to the word total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_rank
from ..sources.scratch import Scratch
from .common import bounded, keyed, told_apart, words

#: Weights by the sources' code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of a source that one task balances.
BLOCK = 4096
_NEAR = 1e-9


def targets(
    rows: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, range_rows: int | None = None
) -> DataFrame:
    """(source, documents, source_size, target) from rows with (source, size).

    Sources share ``share`` times all sizes by weight, null last in their order; a target stops at ``most`` times
    its source's size and the excess goes to the others by weight. The level at which that ends follows from
    running sums over the sources in the order in which they fill up. Sources are numbered and summed by ranges (of ``range_rows``), so
    there may be as many of them as documents.
    """
    if not 0 < share <= most:
        raise ValueError("the sources cannot fill the mix")
    sources = rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    sources = global_rank(sources, [F.col("source").asc_nulls_last()], scratch, "_rank", range_rows=range_rows)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    sources = sources.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    filling = {"_caps": "_cap", "_weights": "_weight"}
    sources = scratch.table(global_rank(sources, ["_ratio", "_rank"], scratch, "_place", filling, range_rows), "filling")
    size, weight = sources.agg(F.sum("source_size"), F.sum("_weight")).first()
    still = F.lit(float((size or 0) * share)) - (F.col("_caps") - F.col("_cap"))
    level = still / (F.lit(weight or 1) - F.col("_weights") + F.col("_weight"))
    # the first source, in that order, that does not fill up
    first = sources.withColumn("_level", level).where("_ratio >= _level").agg(F.min_by("_level", "_place")).first()[0]
    target = F.col("_cap") if first is None else F.least("_cap", F.lit(first) * F.col("_weight"))
    return sources.select("source", "documents", "source_size", target.cast("double").alias("target"))


def _fly(chance: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Moves probabilities to 0 or 1 with both totals kept; at most two stay open."""
    chance = chance.astype(float).copy()
    waiting: Iterator[int] = iter(range(len(chance)))
    active: list[int] = []
    draws = random.random(2 * len(chance) + 8)
    step = 0
    while True:
        while len(active) < 3 and (k := next(waiting, None)) is not None:
            if _NEAR < chance[k] < 1 - _NEAR:
                active.append(k)
        s = [float(size[k]) for k in active]
        if len(active) == 3:
            way = (s[2] - s[1], s[0] - s[2], s[1] - s[0])
            if way == (0.0, 0.0, 0.0):
                way = (1.0, -1.0, 0.0)
        elif len(active) == 2 and s[0] == s[1]:
            way = (1.0, -1.0)
        else:
            return chance
        up, down = np.inf, np.inf
        for k, w in zip(active, way, strict=True):
            if w:
                p = chance[k]
                up = min(up, (1 - p) / w if w > 0 else -p / w)
                down = min(down, p / w if w > 0 else (p - 1) / w)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        still = []
        for k, w in zip(active, way, strict=True):
            p = chance[k] + move * w
            chance[k] = p = 0.0 if p <= _NEAR else 1.0 if p >= 1 - _NEAR else p
            if 0.0 < p < 1.0:
                still.append(k)
        active = still


def _land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds what the flight left: the choice whose words come nearest to the expected, then whose documents do."""
    left = np.flatnonzero((chance > 0) & (chance < 1))
    out, best = chance.copy(), None
    for choice in range(1 << len(left)):
        taken = np.array([choice >> i & 1 for i in range(len(left))], dtype=float)
        off = (abs(((taken - chance[left]) * size[left]).sum()), abs((taken - chance[left]).sum()), choice)
        if best is None or off < best:
            best, out[left] = off, taken
    return out


def _balance(last: bool, seed: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        random = np.random.default_rng([seed, len(rows), int(rows["_order"].iloc[0]) & 0xFFFFFFFF])
        size = rows["size"].to_numpy(float)
        chance = _fly(rows["chance"].to_numpy(float), size, random)
        rows["chance"] = _land(chance, size) if last else chance
        return rows.drop(columns=["_block", "documents"])

    return block


def mix(docs: DataFrame, scratch: Scratch, seed: int = 0, block: int = BLOCK, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted). Texts may have any length.

    ``size`` counts the words of the whole text (null: none). Null is a source of its own, the last. Documents without
    words are taken at any count, as 0 words. A document is taken at most twice. The same rows and seed give the
    same result; rows equal in all columns read are interchangeable. Columns ``keys`` are passed on; others are not read.
    """
    rows = scratch.table(docs.select("doc_id", "source", words(F.col("text")).alias("size"), *keys), "sizes")
    # where very many rows have one id and size, each has a number of its own to be dealt out by
    rows = told_apart(rows, scratch, ["doc_id", "source", "size"], max(1, block // 4))
    goal = bounded(scratch.table(targets(rows, scratch), "targets").withColumnRenamed("source", "_source"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(2.0))).otherwise(0.0)
    rows = (
        rows.join(goal, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("copies", F.floor(rate).cast("long"))
        .withColumn("chance", rate - F.floor(rate))
        .withColumn("_order", F.when(F.col("_copy") > 0, F.xxhash64("doc_id", "size", "_copy", F.lit(seed))).otherwise(F.xxhash64("doc_id", "size", F.lit(seed))))
        .drop("_copy")
    )
    done, last = [], False
    while not last:
        largest = rows.agg(F.max("documents")).first()[0] or 0
        last = largest <= block
        rows = rows.withColumn("_block", F.pmod(F.col("_order"), F.ceil(F.col("documents") / block)))
        schema = rows.drop("_block", "documents").schema
        # dealt by block, so that a join by source before never keeps a large source together
        rows = rows.repartition("source", "_block")
        moved = scratch.table(rows.groupBy("source", "_block").applyInPandas(_balance(last, seed), schema), "flight")
        if last:
            done.append(moved)
        else:
            is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
            done.append(moved.where(~is_open))
            rest = moved.where(is_open)
            counts = rest.groupBy("source").agg(F.count("*").alias("documents")).withColumnRenamed("source", "_source")
            counts = bounded(scratch.table(counts, "open"))
            rows = rest.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            # a later round deals its rows anew, else the same ones would meet again
            rows = rows.withColumn("_order", F.xxhash64("_order", F.lit(len(done))))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    taken = (F.col("size") * (F.col("copies") + F.col("chance"))).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keys)


def mixed(docs: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """The mix itself: the documents' rows with all their columns, each as often as it is taken.

    Every row has a key of its own, its place in the files it is read from, so rows that share a doc_id, or have none, each keep their
    own count, and texts are written only where they come from no file.
    """
    plain = keyed(docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), scratch)
    read = {name: F.col(f"c{docs.columns.index(name)}").alias(name) for name in ("doc_id", "source", "text")}
    counts = mix(plain.select(*read.values(), "_file", "_at"), scratch, seed, keys=("_file", "_at"))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    times = counts.select("_file", "_at", times.alias("_times"))
    times = bounded(scratch.table(times.where("_times > 0"), "times"))
    rows = plain.join(times, ["_file", "_at"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return rows.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)])
