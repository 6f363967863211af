"""Train and test rows, reproducible in any engine."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import after, order_statistics


def hash_order(id_col: str, seed: int) -> Column:
    """52 bits of md5 over seed and id: a random but fixed order, exact in a double."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def class_sizes(counts: Mapping[Any, int], fraction: float) -> dict[Any, int]:
    """Test rows per class: ``ceil(fraction * n)`` in all, shared out by largest remainder."""
    total = sum(counts.values())
    wanted = math.ceil(fraction * total)
    exact = {k: wanted * n / total for k, n in counts.items()}
    sizes = {k: int(x) for k, x in exact.items()}
    by_remainder = sorted(counts, key=lambda k: (sizes[k] - exact[k], str(k)))
    for k in by_remainder[: wanted - sum(sizes.values())]:
        sizes[k] += 1
    return sizes


def stratified_split(
    df: DataFrame, id_col: str, label: str, fraction: float = 0.25, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Append ``is_test``: per class of ``label``, exactly the first rows in hash order.

    Only one cut per class has to be found; marking the rows needs no shuffle. A NULL ``label`` is refused.
    """
    keyed = df.select(hash_order(id_col, seed).alias("_hash"), id_col, label)
    sizes: dict[Any, int] = {}

    def positions(counts: dict[Any, int]) -> list[tuple[Any, int]]:
        if counts.get(None):
            raise ValueError(f"NULL {label} in {counts[None]} rows")
        sizes.update({k: size for k, size in class_sizes(counts, fraction).items() if size > 0})
        return list(sizes.items())

    cuts = order_statistics(keyed, ["_hash", id_col], positions, stratum=label)
    keys = [hash_order(id_col, seed), F.col(id_col)]
    test = F.lit(False)
    for k, cut in zip(sizes, cuts):
        test = F.when(F.col(label) == F.lit(k), ~after(keys, cut)).otherwise(test)
    return df.withColumn(name, test)
