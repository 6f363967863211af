"""Joining coded columns to lookup tables.

The lookups' joins carry no broadcast hint: Spark broadcasts a lookup when its size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting hot codes at run time. ``attach_groups`` is for mappings of any
size: it measures them first and joins frequent codes apart from the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


@dataclass(frozen=True)
class Lookup:
    """A lookup table for one code column of the fact table."""

    table: DataFrame
    key: str
    code: Column
    label: str = "description"


def attach_labels(fact: DataFrame, lookups: dict[str, Lookup]) -> DataFrame:
    """Left join every lookup; the label arrives as the dict key's name, NULL where no code matches.

    Keys are made distinct first, so a repeated key never multiplies fact rows, and Catalyst can
    drop the join altogether when the label is not used.
    """
    out = fact
    for name, lookup in lookups.items():
        key = f"_{name}_key"
        labels = lookup.table.groupBy(F.col(lookup.key).alias(key)).agg(F.min(lookup.label).alias(name))
        out = out.join(labels, lookup.code == F.col(key), "left")
    return out.drop(*[f"_{name}_key" for name in lookups])


def mark_each(fact: DataFrame, lookups: Sequence[Lookup], flags: Sequence[str]) -> DataFrame:
    """Append a flag per lookup: true where its code has no row there. One join a lookup."""
    out = fact
    for i, (lookup, flag) in enumerate(zip(lookups, flags, strict=True)):
        key = f"_{flag}_{i}"
        keys = lookup.table.select(F.col(lookup.key).alias(key)).where(F.col(key).isNotNull()).distinct()
        out = out.join(keys, lookup.code == F.col(key), "left").withColumn(flag, F.col(key).isNull()).drop(key)
    return out


def mark_orphans(fact: DataFrame, lookups: Sequence[Lookup], flag: str) -> DataFrame:
    """Append ``flag``: true where at least one code has no row in its lookup."""
    flags = [f"_{flag}_miss_{i}" for i in range(len(lookups))]
    marked = mark_each(fact, lookups, flags)
    return marked.withColumn(flag, reduce(Column.__or__, map(F.col, flags))).drop(*flags)


def orphan_keys(fact: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """One row: fact rows, rows with any orphan code, and orphan rows per lookup key."""
    flags = [f"orphan_{lookup.key}" for lookup in lookups]
    return mark_each(fact, lookups, flags).agg(
        F.count("*").alias("n_rows"),
        F.count_if(reduce(Column.__or__, map(F.col, flags))).alias("rows_with_orphan"),
        *[F.count_if(flag).alias(flag) for flag in flags],
    )


def repeated_labels(table: DataFrame, label: str = "description", min_times: int = 2) -> DataFrame:
    """Labels used by several rows of a lookup, with how often."""
    return table.groupBy(label).agg(F.count("*").alias("times")).where(F.col("times") >= min_times)


#: Bytes of codes and labels up to which a mapping is broadcast.
MAPPING_BYTES = 32 << 20


def attach_groups(
    fact: DataFrame, code: Column, mapping: DataFrame, default: str, name: str, scratch: Scratch, most_bytes: int = MAPPING_BYTES
) -> DataFrame:
    """Append the label of a code, as ``map_codes`` does, from a mapping table of (code, label): thousands of codes need no nested conditions.

    A code in no row of the mapping, or NULL, gets ``default``; of several labels of a code the first by name wins. The mapping's bytes are
    measured and it is broadcast up to ``most_bytes``. Beyond, codes that a thousandth of all rows have are joined to their labels by broadcast, a
    thousand at most, and the others by a shuffle, in which none of them is hot. ``fact`` is read twice then: pass a written table.
    """
    labels = mapping.where(F.col("code").isNotNull()).groupBy(F.col("code").alias("_code")).agg(F.min("label").alias("_label"))
    labels = scratch.table(labels, "mapping")
    size = F.octet_length(F.col("_code").cast("string")) + F.coalesce(F.octet_length("_label"), F.lit(0)) + 32
    coded = fact.withColumn("_own", code)
    on = F.col("_own") == F.col("_code")
    if (labels.agg(F.sum(size)).first()[0] or 0) <= most_bytes:
        out = coded.join(F.broadcast(labels), on, "left")
    else:
        counts = scratch.table(coded.where("_own IS NOT NULL").groupBy("_own").agg(F.count("*").alias("_n")), "codes")
        least = (counts.agg(F.sum("_n")).first()[0] or 0) / 1000
        often = counts.where(F.col("_n") >= least).select(F.col("_own").alias("_often")).limit(1000)
        hot = scratch.table(often.join(labels, F.col("_often") == F.col("_code"), "left").select(F.col("_often").alias("_code"), "_label"), "hot")
        cold = coded.join(F.broadcast(hot.select("_code")), on, "left_anti").join(labels, on, "left")
        out = coded.join(F.broadcast(hot), on).unionByName(cold)
    return out.select(*fact.columns, F.coalesce("_label", F.lit(default)).alias(name))
