"""How well a score ranks a yes/no outcome."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import round_half_even
from ..sources.scratch import Scratch
from .ordering import after, order_statistics, running_totals


def _scored(df: DataFrame, scores: Mapping[str, str], *more: str) -> DataFrame:
    """A row per method and row of ``df``: method, score."""
    each = F.array(*[F.struct(F.lit(name).alias("method"), F.col(c).cast("double").alias("score")) for name, c in scores.items()])
    return df.select(*more, F.inline(each))


def _by_score(df: DataFrame, scores: Mapping[str, str], label: str, falling: bool = False) -> DataFrame:
    event = F.col(label).cast("int")
    rows = _scored(df.select(event.alias("event"), *dict.fromkeys(scores.values())), scores, "event")
    score = -F.col("score") if falling else F.col("score")
    return (
        rows.groupBy("method", score.alias("score"))
        .agg(F.sum("event").alias("pos"), F.sum(1 - F.col("event")).alias("neg"), F.count_if(F.col("event").isNull()).alias("_blank"))
        .withColumn("pos", F.when(F.col("_blank") > 0, F.raise_error(F.lit("NULL outcome"))).otherwise(F.col("pos")))
        .drop("_blank")
    )


def areas(
    df: DataFrame, scores: Mapping[str, str], label: str, scratch: Scratch, range_rows: int | None = None
) -> DataFrame:
    """``method, auc, positives, negatives`` for every score, all in the same passes.

    AUC is the share of (event, non-event) pairs ranked right, ties counting half. Rows are first summed per distinct
    score; only those sums are accumulated. NULL and NaN scores and NULL outcomes are refused.
    """
    sums = _by_score(df, scores, label)
    ranked = running_totals(sums, "score", {"neg_upto": "neg"}, scratch, by="method", range_rows=range_rows)
    right = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return ranked.groupBy("method").agg(
        (F.sum(right) / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def auc(df: DataFrame, score: str, label: str, scratch: Scratch, range_rows: int | None = None) -> DataFrame:
    """ROC AUC of one score as one row; NULL if the outcome does not vary."""
    return areas(df, {score: score}, label, scratch, range_rows).drop("method")


def roc_points(df: DataFrame, score: str, label: str, scratch: Scratch, steps: int | None = None) -> DataFrame:
    """``threshold, tpr, fpr``: rates among rows scored at least that high, from (0, 0) at an infinite threshold.

    One row per distinct score at which the curve turns: points on a straight piece between two others are left out. A continuous score
    turns at nearly every row. With ``steps`` such a curve of more than 2 * steps + 1 points is cut down: of the points whose rates fall
    into the same pair of steps of 1 / steps the last one stays. There are 2 * steps + 1 of them at most then, however many rows, and every point left out
    has one that stays within 1 / steps of it in both rates. Curves of fewer points are exact.
    """
    falling = _by_score(df, {score: score}, label, falling=True)
    ranked = running_totals(
        falling, "score", {"tp": "pos", "fp": "neg"}, scratch, following={"pos_next": "pos", "neg_next": "neg"}
    )
    if steps is not None:
        ranked = scratch.table(ranked, "curve")
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    turns = (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
    kept = ranked.where(first | F.col("pos_next").isNull() | turns)
    sums = scratch.table(ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")), "sums")
    if steps is not None and kept.limit(2 * steps + 2).count() > 2 * steps + 1:
        p, n = sums.first()
        cell = lambda reached, total: F.floor(reached * F.lit(steps) / F.lit(max(1, total)))
        same = (cell(F.col("tp"), p) == cell(F.col("tp") + F.col("pos_next"), p)) & (cell(F.col("fp"), n) == cell(F.col("fp") + F.col("neg_next"), n))
        kept = ranked.where(F.col("pos_next").isNull() | ~same)
    points = kept.select(
        (-F.col("score")).alias("threshold"),
        (F.col("tp") / F.nullif(sums.select("p").scalar(), F.lit(0))).alias("tpr"),
        (F.col("fp") / F.nullif(sums.select("n").scalar(), F.lit(0))).alias("fpr"),
    )
    origin = sums.where("p + n > 0").select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    return origin.unionByName(points)


def captures(df: DataFrame, scores: Mapping[str, str], label: str, id_col: str, fraction: float) -> DataFrame:
    """One row per method on following up the top ``fraction`` by its score, equal scores by lower id.

    Share of all events captured, event rate inside, overall rate, and the lift over random choice. All methods' cuts are
    searched in the same rounds and counted in one pass.
    """
    wanted: dict[str, int] = {}

    def positions(counts):
        wanted.update({m: int(n * fraction) for m, n in counts.items() if int(n * fraction)})
        return list(wanted.items())

    falling = _scored(df, scores, id_col).select("method", (-F.col("score")).alias("_falling"), id_col)
    cuts = dict(zip(wanted, order_statistics(falling, ["_falling", id_col], positions, "method"), strict=True)) if scores else {}
    event = F.col(label).cast("int")
    counted = []
    for i, (name, score) in enumerate(scores.items()):
        cut = cuts.get(name)
        in_top = ~after([-F.col(score).cast("double"), F.col(id_col)], cut) if cut else F.lit(False)
        counted += [F.count_if(in_top).alias(f"top_{i}"), F.coalesce(F.sum(F.when(in_top, event)), F.lit(0)).alias(f"hit_{i}")]
    totals = df.agg(F.count("*").alias("n_rows"), F.sum(event).alias("events"), *counted)
    each = F.array(
        *[
            F.struct(F.lit(name).alias("method"), F.col(f"top_{i}").alias("followed_up"), F.col(f"hit_{i}").alias("events_caught"))
            for i, name in enumerate(scores)
        ]
    )
    caught = F.col("events_caught") / F.nullif("events", F.lit(0))
    return totals.select("n_rows", "events", F.inline(each)).select(
        "method",
        "n_rows",
        "followed_up",
        "events",
        "events_caught",
        caught.alias("captured_share"),
        (F.col("events_caught") / F.nullif("followed_up", F.lit(0))).alias("rate_in_top"),
        (F.col("events") / F.nullif("n_rows", F.lit(0))).alias("baseline_rate"),
        (caught / F.lit(float(fraction))).alias("lift"),
    )


def capture_at(df: DataFrame, score: str, label: str, id_col: str, fraction: float) -> DataFrame:
    """``captures`` of one score, as one row."""
    return captures(df, {score: score}, label, id_col, fraction).drop("method")


def with_quantile(df: DataFrame, score: str, id_col: str, bins: int = 10, name: str = "decile") -> DataFrame:
    """Append the equal-count bin (1 = lowest scores), equal scores ordered by id.

    Bin b ends at position ``1 + floor(b * (n - 1) / bins)``, as interpolated quantiles of the ranks do.
    """
    cuts = order_statistics(
        df.select(score, id_col),
        [score, id_col],
        lambda counts: [(None, 1 + b * (counts[None] - 1) // bins) for b in range(1, bins) if counts[None]],
    )
    bin_ = F.lit(1)
    for cut in cuts:
        bin_ = bin_ + after([F.col(score), F.col(id_col)], cut).cast("int")
    return df.withColumn(name, bin_)


def decile_table(df: DataFrame, decile: str, label: str) -> DataFrame:
    """Size and event rate per decile, with the rate over all deciles and the two highest marked."""
    event = F.col(label).cast("int")
    rates = df.groupBy(decile).agg(
        F.count("*").alias("patients"),
        round_half_even(F.lit(100.0) * F.avg(event), 2).alias("readmission_rate_pct"),
    )
    everything = Window.partitionBy()
    return rates.select(
        decile,
        "patients",
        "readmission_rate_pct",
        F.sum("patients").over(everything).alias("total_patients"),
        (
            F.sum(F.col("readmission_rate_pct") * F.col("patients")).over(everything)
            / F.sum("patients").over(everything)
        ).alias("weighted_rate_pct"),
        (F.col(decile) > F.max(decile).over(everything) - 2).alias("highlighted"),
    ).orderBy(decile)


def compare_scores(
    df: DataFrame, scores: Mapping[str, str], label: str, id_col: str, scratch: Scratch, fraction: float = 0.2
) -> DataFrame:
    """One row per scoring method, in the order given: AUC, events caught and event rate in the top fraction, baseline.

    The number of passes does not depend on the number of methods.
    """
    area = areas(df, scores, label, scratch).select(F.col("method").alias("_method"), "auc")
    place = F.array_position(F.array(*map(F.lit, scores)), F.col("method"))
    table = captures(df, scores, label, id_col, fraction).join(area, F.col("method") == F.col("_method"), "left")
    return table.orderBy(place).select(
        "method",
        round_half_even(F.col("auc"), 3).alias("auc"),
        round_half_even(F.lit(100.0) * F.col("captured_share"), 1).alias("readmissions_caught_top20_pct"),
        round_half_even(F.lit(100.0) * F.col("rate_in_top"), 1).alias("readmission_rate_in_top20_pct"),
        round_half_even(F.lit(100.0) * F.col("baseline_rate"), 2).alias("baseline_rate_pct"),
    )
