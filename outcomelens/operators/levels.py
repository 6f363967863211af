"""Levels of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_levels(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent levels with their counts; of equally frequent ones the first by name."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), col).limit(n)


def top_level_names(df: DataFrame, col: str, n: int) -> list[str]:
    """At most ``n`` names, small enough to go into an expression (see ``keep_levels``)."""
    return [row[0] for row in top_levels(df, col, n).collect()]


def distinct_levels(df: DataFrame, cols: Sequence[str], max_levels: int = 2000) -> dict[str, list[str]]:
    """Sorted levels of each column, as text, in one pass. Refuses columns of more than ``max_levels`` levels."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("level")) for c in cols])
    found = df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct().limit(max_levels * len(cols) + 1).collect()
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for col, level in found:
        levels[col].append(level)
    if crowded := [c for c, names in levels.items() if len(names) > max_levels]:
        raise ValueError(f"more than {max_levels} levels in {crowded}")
    return {c: sorted(names) for c, names in levels.items()}
