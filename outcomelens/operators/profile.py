"""Outcome rates: overall, by many dimensions at once, and what the report says about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rate_pct, round_half_away


def outcome_counts(outcome: str) -> list[Column]:
    """The aggregates every rate table shares."""
    return [
        F.count("*").alias("patients"),
        F.sum(F.col(outcome).cast("int")).alias("readmitted"),
        rate_pct(F.col(outcome)).alias("readmission_rate_pct"),
    ]


def kpi_row(df: DataFrame, outcome: str, means: Mapping[str, str], shares: Mapping[str, str]) -> DataFrame:
    """One row: count, events, event rate, then means (2 dp) and shares of true flags (1 dp) by name."""
    return df.agg(
        F.count("*").alias("patients"),
        F.sum(F.col(outcome).cast("int")).alias(outcome),
        rate_pct(F.col(outcome)).alias("readmission_rate_pct"),
        *[round_half_away(F.avg(col), 2).alias(name) for name, col in means.items()],
        *[rate_pct(F.col(col), 1).alias(name) for name, col in shares.items()],
    )


def rate_profile(
    df: DataFrame, outcome: str, dimensions: Mapping[str, Column], min_rows: int = 100
) -> DataFrame:
    """``dimension, category, patients, readmitted, readmission_rate_pct``, groups under ``min_rows`` hidden.

    The data is read once. Rows are unpivoted inside the map task and summed there; what is
    shuffled is one row per task and category.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), category.alias("category"))
            for name, category in dimensions.items()
        ]
    )
    return (
        df.select(F.inline(pairs), F.col(outcome).alias("_outcome"))
        .groupBy("dimension", "category")
        .agg(*outcome_counts("_outcome"))
        .where(F.col("patients") >= min_rows)
    )


def flag_drivers(
    profile: DataFrame,
    baseline: Column,
    ordinal: Sequence[str],
    high: float = 1.15,
    low: float = 0.85,
) -> DataFrame:
    """Each category against the overall rate, in the order a reader sees it.

    Ordinal dimensions keep their natural order, the others go from high to low.
    """
    rate = F.col("readmission_rate_pct")
    return (
        profile.withColumn("baseline_pct", baseline)
        .select(
            "dimension",
            "category",
            "patients",
            "readmission_rate_pct",
            "baseline_pct",
            F.when(rate > F.col("baseline_pct") * high, F.lit("bad"))
            .when(rate < F.col("baseline_pct") * low, F.lit("good"))
            .otherwise(F.lit("neutral"))
            .alias("flag"),
            (rate > F.col("baseline_pct")).alias("above_average"),
        )
        .orderBy(
            "dimension",
            F.when(F.col("dimension").isin(*ordinal), F.col("category")),
            F.desc("readmission_rate_pct"),
            "category",
        )
    )


def profile_slice(profile: DataFrame, dimension: str, baseline: Column) -> DataFrame:
    """One dimension with the overall rate beside it, lowest rate first."""
    return (
        profile.where(F.col("dimension") == dimension)
        .withColumn("baseline_pct", baseline)
        .withColumn("above_average", F.col("readmission_rate_pct") > F.col("baseline_pct"))
        .orderBy("readmission_rate_pct", "category")
    )


def top_category(profile: DataFrame, baseline: Column) -> DataFrame:
    """The category with the highest rate in each dimension; of equal ones the last by name."""
    best = F.max(F.struct("readmission_rate_pct", "category", "patients")).alias("_best")
    return (
        profile.groupBy("dimension")
        .agg(best)
        .select(
            "dimension",
            F.col("_best.category").alias("category"),
            F.col("_best.readmission_rate_pct").alias("readmission_rate_pct"),
            F.col("_best.patients").alias("patients"),
        )
        .withColumn("baseline_pct", baseline)
    )


def category_rates(profile: DataFrame, wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row with the rates of chosen ``(dimension, category)`` pairs, by name; hidden ones are NULL."""
    return profile.agg(
        *[
            F.max(
                F.when((F.col("dimension") == dim) & (F.col("category") == cat), F.col("readmission_rate_pct"))
            ).alias(name)
            for name, (dim, cat) in wanted.items()
        ]
    )
