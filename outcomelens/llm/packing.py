"""Packing documents into token-budget batches with optimal length buckets.

The histogram of lengths over all documents goes to the driver: one row per length, at most ``longest`` of
them because longer documents are cut into pieces. Dynamic programming over it finds the bucket bounds
with the least padding; batches form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .common import numbered, words


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that pad the least in total; the last is the largest length.

    ``lengths`` ascend. Of equal solutions, the one whose upper buckets begin earliest. No lengths, no bounds.
    """
    n = len(lengths)
    if n == 0:
        return []
    size = np.array(lengths, dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    total = np.concatenate([[0], np.cumsum(size * np.array(counts, dtype=np.int64))])
    # cost[j]: least padding of the first j lengths; a last bucket over lengths i .. j-1 pads to size[j-1]
    cost = np.concatenate([[0], size * rows[1:] - total[1:]])
    came: list[np.ndarray] = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(min(buckets, n) - 1):
        better, origin = cost.copy(), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            through = cost[:j] + size[j - 1] * (rows[j] - rows[:j]) - (total[j] - total[:j])
            origin[j] = np.argmin(through)
            better[j] = through[origin[j]]
        cost = better
        came.append(origin)
    bounds, j = [], n
    for origin in reversed(came):
        if j:
            bounds.append(int(size[j - 1]))
            j = int(origin[j])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    scratch: Scratch,
    budget: int = 32_768,
    buckets: int = 8,
    longest: int = 2_048,
    length: Column | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, pad_to, batch, place.

    Tokens are the words of the whole text, or ``length`` if given. A text of more than ``longest`` tokens is cut into
    pieces that begin at ``start``. ``batch`` numbers the batches of a bucket, ``place`` the rows of a batch: as many as
    ``budget`` holds at the bucket's padded length ``pad_to``. A document without tokens (null or empty text) keeps one
    row with 0 tokens and no bucket. No documents give no rows. Equal doc_ids are numbered in any order.
    """
    if not 0 < longest <= budget:
        raise ValueError("a piece must fit the budget")
    size = words(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    rows = docs.select("doc_id", size.alias("_size"))
    last = F.greatest(F.ceil(F.col("_size") / longest) - 1, F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).select(
        "doc_id",
        "piece",
        (F.col("piece") * longest).alias("start"),
        F.least(F.col("_size") - F.col("piece") * longest, F.lit(longest)).cast("long").alias("n_tokens"),
    )
    pieces = scratch.table(pieces, "pieces")
    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    bounds = best_bounds([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    bucket, pad = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, bound in reversed(list(enumerate(bounds))):
        within = F.col("n_tokens") <= bound
        bucket, pad = F.when(within, k).otherwise(bucket), F.when(within, F.lit(bound).cast("long")).otherwise(pad)
    filled = F.col("n_tokens") > 0
    pieces = pieces.withColumn("bucket", F.when(filled, bucket)).withColumn("pad_to", F.when(filled, pad))
    ranked = numbered(pieces, scratch, ["bucket"], ["doc_id", "piece", "n_tokens"], "_rank")
    room = F.floor(F.lit(budget) / F.col("pad_to")).cast("long")
    return ranked.select(
        *pieces.columns, F.when(filled, F.floor(F.col("_rank") / room)).alias("batch"), F.when(filled, F.col("_rank") % room).alias("place")
    )
