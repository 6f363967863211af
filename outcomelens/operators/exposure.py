"""Comparing an exposed with an unexposed group, overall and within strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rate_pct


def exposure_groups(tested: Column, normal: Column, changed: Column, labels: tuple[str, str, str, str]) -> Column:
    """Four exclusive groups, in this order: not tested, normal, high and unchanged, high and changed."""
    not_tested, tested_normal, high_unchanged, high_changed = labels
    return (
        F.when(~tested, F.lit(not_tested))
        .when(normal, F.lit(tested_normal))
        .when(~changed, F.lit(high_unchanged))
        .otherwise(F.lit(high_changed))
    )


def exposure_summary(df: DataFrame, group: str, outcome: str) -> DataFrame:
    return (
        df.groupBy(group)
        .agg(F.count("*").alias("patients"), rate_pct(F.col(outcome)).alias("readmission_rate_pct"))
        .orderBy(group)
    )


def exposure_by_stratum(
    df: DataFrame, stratum: str, strata: Sequence[str], unexposed: Column, outcome: str
) -> DataFrame:
    """Both rates side by side per stratum, largest stratum first; NULL where a side is empty."""
    event = F.col(outcome).cast("int")
    rows = df.where(F.col(stratum).isin(*strata)).select(
        stratum, event.alias("_event"), unexposed.alias("_unexposed")
    )
    return (
        rows.groupBy(stratum)
        .agg(
            rate_pct(F.when(F.col("_unexposed"), F.col("_event"))).alias("not_tested_pct"),
            rate_pct(F.when(~F.col("_unexposed"), F.col("_event"))).alias("tested_pct"),
            F.count_if(~F.col("_unexposed")).alias("tested_patients"),
            F.count("*").alias("patients"),
        )
        .orderBy(F.desc("patients"), stratum)
    )
