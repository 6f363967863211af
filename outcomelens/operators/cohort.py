"""One index row per entity, and the funnel that documents what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_entity(df: DataFrame, entity: str, order: str) -> DataFrame:
    """The first row of every entity.

    The rank filter also runs before the shuffle, so an entity with a huge share of all rows sends
    at most one row per map task.
    """
    by_entity = Window.partitionBy(entity).orderBy(F.col(order).asc_nulls_last())
    ranked = df.withColumn("_seq", F.row_number().over(by_entity))
    return ranked.where(F.col("_seq") == 1).drop("_seq")


def index_cohort(df: DataFrame, entity: str, order: str, keep: Column) -> DataFrame:
    """First row per entity, then the exclusions.

    An entity whose first row is excluded is gone: its second row is not promoted.
    """
    return first_per_entity(df, entity, order).where(keep)


def cohort_funnel(
    df: DataFrame, entity: str, order: str, keep: Column, descriptions: tuple[str, str, str]
) -> DataFrame:
    """``step, description, encounters, share_pct`` for all rows, distinct entities and kept rows.

    One scan and one narrow shuffle: each entity is reduced to its row count and to whether its
    first row is kept.
    """
    per_entity = (
        df.select(entity, order, F.coalesce(keep, F.lit(False)).alias("_keep"))
        .groupBy(entity)
        .agg(F.count("*").alias("_rows"), F.min_by("_keep", order).alias("_keep"))
    )
    totals = per_entity.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("all_rows"),
        F.count(entity).alias("entities"),
        F.count_if("_keep").alias("kept"),
    )
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(text).alias("description"), F.col(count).alias("encounters"))
            for i, (text, count) in enumerate(zip(descriptions, ("all_rows", "entities", "kept")), start=1)
        ]
    )
    share = F.lit(100.0) * F.col("encounters") / F.col("all_rows")
    return totals.select("all_rows", F.inline(steps)).select(
        "step", "description", "encounters", share.alias("share_pct")
    )
