"""Points scores and their validation by band."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import round_half_away
from .profile import outcome_counts


def points_score(
    df: DataFrame,
    points: Mapping[str, Column],
    score: str,
    bands: Sequence[tuple[int, str]],
    lowest_band: str,
    band: str = "risk_band",
) -> DataFrame:
    """Append the point columns, their sum as ``score`` and the band.

    ``bands`` are ``(minimum, label)``, highest first.
    """
    scored = df.withColumns(dict(points))
    scored = scored.withColumn(score, reduce(Column.__add__, [F.col(name) for name in points]))
    label = None
    for minimum, text in bands:
        hit = F.col(score) >= minimum
        label = F.when(hit, F.lit(text)) if label is None else label.when(hit, F.lit(text))
    return scored.withColumn(band, label.otherwise(F.lit(lowest_band)))


def band_validation(scored: DataFrame, score: str, outcome: str, band: str = "risk_band") -> DataFrame:
    """Size, share, events and rate per band, lowest scores first."""
    n, events, rate = outcome_counts(outcome)
    grouped = scored.groupBy(band).agg(n, events, rate, F.min(score).alias("_lowest"))
    share = F.lit(100.0) * F.col("patients") / F.sum("patients").over(Window.partitionBy())
    return (
        grouped.withColumn("share_of_patients_pct", round_half_away(share, 1))
        .orderBy("_lowest")
        .select(band, "patients", "share_of_patients_pct", "readmitted", "readmission_rate_pct")
    )
