"""Data-quality suite: rules in, one row per rule out.

All row predicates and orphan checks are counted in one pass over the data. Each duplicate check is
an aggregate of its own that reads only its key column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_half_even, tidy_label
from .lookups import Lookup, mark_orphans, repeated_labels


@dataclass(frozen=True)
class CountWhere:
    """Rows for which a predicate holds."""

    predicate: Column


@dataclass(frozen=True)
class DuplicateKeys:
    """Rows beyond the first of each key; rows with a NULL key count as duplicates."""

    key: str


@dataclass(frozen=True)
class OrphanCodes:
    """Rows with a code that is missing from its lookup."""

    lookups: Sequence[Lookup]


@dataclass(frozen=True)
class RepeatedLabels:
    """Labels that a lookup gives to more than one code."""

    table: DataFrame
    label: str = "description"


@dataclass(frozen=True)
class Rule:
    check_id: int
    check_name: str
    test: CountWhere | DuplicateKeys | OrphanCodes | RepeatedLabels
    handling: str


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """``count(*) - count(distinct key)`` as ``n``.

    Grouped by the key rather than as a distinct count: Catalyst would merge the distinct counts of several
    keys into one aggregate, which copies every row for every key.
    """
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.count(key)).alias("n"))


def run_suite(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``check_id, check_name, affected_rows, handling`` for every rule."""
    checked, counts, single = df, [], {}
    for rule in rules:
        name = f"_check_{rule.check_id}"
        match rule.test:
            case CountWhere(predicate):
                counts.append(F.count_if(predicate).alias(name))
            case OrphanCodes(lookups):
                checked = mark_orphans(checked, lookups, name)
                counts.append(F.count_if(name).alias(name))
            case DuplicateKeys(key):
                single[name] = duplicate_rows(df, key).select("n").scalar()
            case RepeatedLabels(table, label):
                single[name] = repeated_labels(table, label).agg(F.count("*").alias("n")).select("n").scalar()

    totals = checked.agg(F.count("*").alias("_rows"), *counts)
    rows = F.array(
        *[
            F.struct(
                F.lit(rule.check_id).alias("check_id"),
                F.lit(rule.check_name).alias("check_name"),
                single.get(f"_check_{rule.check_id}", F.col(f"_check_{rule.check_id}")).alias("affected_rows"),
                F.lit(rule.handling).alias("handling"),
            )
            for rule in rules
        ]
    )
    return totals.select(F.inline(rows))


def missing_share(
    results: DataFrame, total: Column, check_ids: Sequence[int], literal: tuple[str, str], drop_pattern: str
) -> DataFrame:
    """Chosen checks as a share of all rows, under tidied labels; a check without hits has share 0."""
    return (
        results.where(F.col("check_id").isin(*check_ids))
        .select(
            "check_id",
            tidy_label(F.col("check_name"), literal, drop_pattern).alias("label"),
            "affected_rows",
            round_half_even(F.lit(100.0) * F.col("affected_rows") / total, 2).alias("share_pct"),
        )
        .orderBy("share_pct", "check_id")
    )


def quality_table(results: DataFrame) -> DataFrame:
    """The checks with hits, as shown to readers: name, rows, handling."""
    shown = results.where(F.col("affected_rows") > 0).orderBy("check_id")
    return shown.select("check_name", "affected_rows", "handling")
