"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and rotated so that the leading dimensions hold the most energy; a rotation keeps
cosines. Tiles of vectors are compared pairwise. A tile pair multiplies the leading dimensions first; the
rest of a product is at most the product of the suffix norms, so a pair stops as soon as what it
has plus that bound cannot reach the threshold. Survivors are decided in double precision on the
vectors as they came.

Equal vectors are compared once. A tile pair returns a count and a smallest linked vector for each of its vectors,
never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .common import components

#: Numbers in a tile, and the bounded sample of vectors that the rotation is fitted to (it affects speed only).
TILE, SAMPLE = 1 << 19, 4096
#: Dimensions after which the bound is tried, as shares of all.
STOPS = (0.25, 0.5)
#: Single precision decides nothing: a bound within this of the threshold survives.
SLACK = 1e-4


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthonormal directions by falling energy of the unit vectors; the unit matrix without any."""
    if not len(sample):
        return np.eye(sample.shape[1])
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(unit.T @ unit)
    return vectors[:, ::-1]


class Tile:
    """Unit vectors, their rotation in single precision, and the norms of what follows each stop."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.turned = (self.unit @ turn).astype(np.float32)
        self.stops = sorted({max(1, round(s * turn.shape[1])) for s in STOPS})
        square = self.turned.astype(np.float64) ** 2
        self.rest = {k: np.sqrt(square[:, k:].sum(axis=1)).astype(np.float32) for k in self.stops}


def linked(a: Tile, b: Tile, rows: slice, threshold: float, dense: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the pairs of some rows of a with all of b that reach the threshold."""
    had, x, y = 0, None, None
    sums = None
    for stop in a.stops:
        bar = threshold - SLACK
        if x is None:
            sums = a.turned[rows, :stop] @ b.turned[:, :stop].T
            reach = np.outer(a.rest[stop][rows], b.rest[stop])
            reach += sums
            x, y = np.nonzero(reach >= bar)
            if len(x) > dense * reach.size:  # a block of copies: one product in double precision is cheaper
                whole = a.unit[rows] @ b.unit.T
                x, y = np.nonzero(whole >= threshold)
                return x + rows.start, y
            sums = sums[x, y]
        else:
            sums = sums + np.einsum("ij,ij->i", a.turned[rows][x, had:stop], b.turned[y, had:stop])
            keep = sums + a.rest[stop][rows][x] * b.rest[stop][y] >= bar
            x, y, sums = x[keep], y[keep], sums[keep]
        had = stop
    keep = np.zeros(len(x), bool)
    for k in range(0, len(x), 1 << 15):
        part = slice(k, k + (1 << 15))
        keep[part] = np.einsum("ij,ij->i", a.unit[rows][x[part]], b.unit[y[part]]) >= threshold
    return x[keep] + rows.start, y[keep]


def _least_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Lowers labels to the smallest that links reach; links between equal labels cost nothing."""
    while True:
        differ = label[x] != label[y]
        if not differ.any():
            return
        x, y = x[differ], y[differ]
        p, q = label[x], label[y]
        high, low = np.maximum(p, q), np.minimum(p, q)
        onto = np.arange(len(label))
        np.minimum.at(onto, high, low)
        while (onto[onto] != onto).any():
            onto = onto[onto]
        label[:] = onto[label]


def _compare(turns: dict[int, np.ndarray], threshold: float, block: int = 512):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        turn = turns.get(vectors.shape[1])
        turn = np.eye(vectors.shape[1]) if turn is None else turn
        own, other = rows["left"].iloc[0], rows["right"].iloc[0]
        left = np.flatnonzero(rows["tile"].to_numpy() == own)
        right = np.flatnonzero(rows["tile"].to_numpy() == other)
        copies, node = rows["copies"].to_numpy(), rows["node"].to_numpy()
        count, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        if len(left) and len(right):
            a = Tile(vectors[left], turn)
            b = a if own == other else Tile(vectors[right], turn)
            for at in range(0, len(left), block):
                x, y = linked(a, b, slice(at, min(at + block, len(left))), threshold)
                if own == other:
                    x, y = x[x < y], y[x < y]
                x, y = left[x], right[y]
                count += np.bincount(x, weights=copies[y], minlength=len(rows)).astype(np.int64)
                count += np.bincount(y, weights=copies[x], minlength=len(rows)).astype(np.int64)
                _least_labels(label, x, y)
        has = count > 0
        return pd.DataFrame({"node": node[has], "links": count[has], "least": node[label[has]]})

    return run


def _fitted(rows: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """A rotation for each length of vector, from the sample with the smallest hashes."""
    picked = rows.orderBy(F.xxhash64("vec", F.lit(29)), "vec", "node").limit(sample).select("embedding").collect()
    by_length: dict[int, list] = {}
    for (vector,) in picked:
        by_length.setdefault(len(vector), []).append(vector)
    return {n: rotation(np.array(v, dtype=np.float64)) for n, v in by_length.items()}


def _valid(vector: Column) -> Column:
    """Whether all components are finite numbers and some is not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicates(
    table: DataFrame, scratch: Scratch, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine is at least ``threshold``. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing, nor do vectors of different lengths. ``n_links`` counts other rows, equal
    vectors included; ``component_id`` is the smallest vec_id that links reach. Rows with a null vec_id link with nothing and
    have a null component; rows that repeat a vec_id are vectors of their own. Other columns are
    ignored.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = scratch.table(rows, "vectors")
    usable = rows.where(_valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    equal = usable.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"))
    classes = scratch.table(equal.withColumn("node", F.monotonically_increasing_id()), "classes")
    turns = _fitted(classes, SAMPLE)

    # tiles hold vectors of one length
    size = F.size("embedding")
    room = F.greatest(F.lit(16), F.floor(F.lit(tile) / size))
    counted = classes.groupBy(size.alias("_size")).agg(F.ceil(F.count("*") / F.first(room)).cast("long").alias("_tiles"))
    # one row of two numbers for each length of vector, of which there are no more than the longest vector has components
    dealt = classes.withColumn("_size", size).join(F.broadcast(counted), "_size")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    dealt = dealt.select(
        "_size", F.least("tile", "_other").alias("left"), F.greatest("tile", "_other").alias("right"), "tile", "node", "copies", "embedding"
    )
    # dealt by tile pair whatever the plan so far is partitioned by
    dealt = dealt.repartition("_size", "left", "right")
    found = dealt.groupBy("_size", "left", "right").applyInPandas(
        _compare(turns, threshold), "node long, links long, least long"
    )
    found = scratch.table(found, "found")
    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    links = found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    known = scratch.table(components(links, scratch), "components")
    members = classes.select("node", "vec").join(known, "node")
    first = members.groupBy("component").agg(F.min("vec").alias("_first"))
    named = members.join(first, "component").select("node", "_first")

    per_class = (
        classes.join(direct, "node", "left")
        .join(named, "node", "left")
        .select(
            F.col("embedding").alias("_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("_first", "vec").alias("component_id"),
        )
    )
    # a class that many rows share is split by Spark's skew join
    named = usable.join(per_class, F.col("embedding") == F.col("_embedding")).select("vec_id", "n_links", "component_id")
    rest = rows.where(~_valid(F.col("embedding")) | F.col("vec_id").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return named.unionByName(rest).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
