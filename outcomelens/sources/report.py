"""The report payload: the result tables as one JSON record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def in_order(name: str, values: Sequence[str]) -> Column:
    """Place of a column's value in a list, to sort by."""
    return F.array_position(F.array(*map(F.lit, values)), F.col(name))


def _ordered(df: DataFrame, order: Sequence[str | Column]) -> Column:
    """All rows of a small aggregate as one sorted array."""
    places = [(F.col(c) if isinstance(c, str) else c).alias(f"_order_{i}") for i, c in enumerate(order)]
    keyed = F.struct(*places, F.struct("*").alias("_row"))
    rows = F.transform(F.array_sort(F.collect_list(keyed)), lambda r: r["_row"])
    return df.agg(rows.alias("rows")).select("rows").scalar()


#: Bytes of JSON that a part of the payload may have.
PART_BYTES = 16 << 20


def measured(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Bytes of each table as JSON, in one job."""
    sizes = [df.select(F.lit(name).alias("name"), F.octet_length(F.to_json(F.struct("*"))).alias("size")) for name, df in tables.items()]
    found = reduce(DataFrame.unionByName, sizes).groupBy("name").agg(F.sum("size")).collect() if sizes else []
    return dict.fromkeys(tables, 0) | dict(map(tuple, found))


def report_payload(
    spark: SparkSession,
    single: Mapping[str, DataFrame],
    listed: Mapping[str, tuple[DataFrame, Sequence[str | Column]]],
    order: Sequence[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row, one column ``payload``.

    ``single`` tables have one row and become objects; ``listed`` ones come with their sort columns
    and become lists. ``order`` names all parts in the order in which they stand; without it the objects come first. Each part ends up in one
    cell, so its rows are measured beforehand: one of more than ``part_bytes`` is refused.
    """
    sizes = measured({**single, **{name: df for name, (df, _) in listed.items()}})
    if large := {name: size for name, size in sizes.items() if size > part_bytes}:
        raise ValueError(f"too large for a report, of which a part may have {part_bytes} bytes: {large}")
    fields = [df.select(F.struct("*").alias("row")).scalar().alias(name) for name, df in single.items()]
    fields += [_ordered(df, order).alias(name) for name, (df, order) in listed.items()]
    if order is not None:
        if sorted(order) != sorted([*single, *listed]):
            raise ValueError(f"an order of other parts: {list(order)}")
        fields = [dict(zip([*single, *listed], fields, strict=True))[name] for name in order]
    return spark.range(1).select(F.to_json(F.struct(*fields)).alias("payload"))
