"""Exact global order without a global sort.

``order_statistics`` finds the rows at given positions of a total order. Callers turn those few rows
into constants, so "is this row in the top 20 %" or "which decile is this row in" becomes a plain
expression inside the map task: no sort, no shuffle and no single task that holds a large group.

``running_totals`` gives cumulative sums over distinct values and ``global_rank`` numbers all rows in an order, both cut into
ranges of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch

_BINS = 1024
#: Rows of a range of running totals.
_RANGE = 100_000


def after(keys: Sequence[Column], row: Sequence[Any]) -> Column:
    """Whether a row sorts after ``row`` by ``keys``, ascending, first key first."""
    later, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, row):
        later = later | (equal & (key > F.lit(value)))
        equal = equal & (key == F.lit(value))
    return later


def blank(key: Column, kind: str) -> Column:
    """NULL or not a number."""
    return key.isNull() | F.isnan(key) if kind in ("double", "float") else key.isNull()


def refuse_blank(df: DataFrame, cols: Sequence[str], what: str) -> int:
    """The number of rows; raises if a column holds NULL or NaN."""
    kinds = dict(df.dtypes)
    tests = [blank(F.col(c), kinds[c]) for c in cols]
    n, bad = df.agg(F.count("*"), F.count_if(reduce(Column.__or__, tests))).first()
    if bad:
        raise ValueError(f"{what}: NULL or NaN among {list(cols)} in {bad} rows")
    return n


def _bin(key: Column, least: Any, most: Any) -> Column:
    """Number of the bin between the least and the largest key; it never falls as the key grows."""
    low, high = float(least), float(most)
    if math.isinf(low) or math.isinf(high):  # the infinite ones stand apart, and the others have a span of their own next time
        key = key.cast("double")
        return F.when(key == F.lit(-math.inf), 0).when(key == F.lit(math.inf), 2).otherwise(1)
    width = high / _BINS - low / _BINS
    if width > 0:
        share = (key.cast("double") / _BINS - F.lit(low / _BINS)) / F.lit(width)
        return F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).cast("int")
    # too close for bins of doubles: whole numbers are halved, others lose their least
    middle = (least + most) // 2 if isinstance(least, int) else least
    return (key > F.lit(middle)).cast("int")


@dataclass
class _Search:
    """Rows that may still be the one looked for, and its position among them."""

    stratum: Any
    position: int
    fixed: list[Any] = field(default_factory=list)  # values of the leading keys, already known
    bins: list[tuple[Any, Any, int]] = field(default_factory=list)  # the open key lies in this bin of that span, and so on
    size: int | None = None  # of the candidates, with the least and largest open key, once counted
    least: Any = None
    most: Any = None

    def place(self) -> tuple:
        """Searches with equal places have the same candidates."""
        return (self.stratum, tuple(self.fixed), tuple(self.bins))

    def candidates(self, keys: Sequence[str], stratum: str | None) -> Column:
        tests = [F.col(key) == F.lit(value) for key, value in zip(keys, self.fixed)]
        if len(self.fixed) < len(keys):
            key = F.col(keys[len(self.fixed)])
            tests += [_bin(key, least, most) == F.lit(which) for least, most, which in self.bins]
        if stratum is not None:
            tests.append(F.col(stratum) == F.lit(self.stratum))
        return reduce(Column.__and__, tests, F.lit(True))

    def found(self, size: int, least: Any, most: Any) -> None:
        self.size, self.least, self.most = size, least, most
        if least == most:  # the open key is known; go on with the next one among its equals
            self.fixed.append(least)
            self.bins, self.least, self.most, self.size = [], None, None, None if size > 1 else 1


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    positions: Callable[[dict[Any, int]], Sequence[tuple[Any, int]]],
    stratum: str | None = None,
    fetch_limit: int = 2000,
) -> list[tuple]:
    """Key values of the rows at given 1-based positions, in ascending order of ``keys``.

    ``keys`` are numeric, never NULL or NaN, and unique together; infinities are the least and the greatest numbers. ``positions`` gets the row count of each
    stratum (of ``None`` without one) and returns ``(stratum, position)`` pairs. ``df`` is read several
    times, a few columns each time: pass a written table (see ``Scratch``), not a long plan.

    Every round counts the candidates of all searches in bins between their least and largest key. Map
    tasks send one row per bin at most and the bins are spread over tasks, so what any one task gets depends on
    the number of bins, not on that of map tasks. The bin that holds the position has the next round's
    candidates; ties on one key are resolved by the next, so a value shared by a third of all rows is no special case.
    The last ``fetch_limit`` candidates at most are fetched.
    """
    rows = df.select(*keys) if stratum is None else df.select(*keys, stratum)
    group = F.lit(None).cast("string") if stratum is None else F.col(stratum)
    kinds = dict(rows.dtypes)
    bad = reduce(Column.__or__, [blank(F.col(key), kinds[key]) for key in keys])
    first = F.col(keys[0])
    counted = (
        rows.groupBy(group.alias("g"))
        .agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.min(first).alias("least"), F.max(first).alias("most"))
        .collect()
    )
    if any(row.bad for row in counted):
        raise ValueError(f"NULL or NaN among {list(keys)}")
    sizes = {row.g: row.n for row in counted} or {None: 0}
    searches = [_Search(s, p) for s, p in positions(sizes)]
    spans = {row.g: (row.n, row.least, row.most) for row in counted}
    for search in searches:
        if not 1 <= search.position <= sizes.get(search.stratum, 0):
            raise ValueError(f"no position {search.position} among {sizes.get(search.stratum, 0)} rows")
        search.found(*spans[search.stratum])
    while True:
        open_ = [s for s in searches if len(s.fixed) < len(keys)]
        if unknown := [s for s in open_ if s.size is None]:
            _measure(rows, keys, stratum, unknown)
        elif wide := [s for s in open_ if s.size > fetch_limit]:
            _round(rows, keys, stratum, wide)
        else:
            break
    _fetch(rows, keys, stratum, open_)
    return [tuple(s.fixed) for s in searches]


def _by_place(searches: Sequence[_Search]) -> list[list[_Search]]:
    places: dict[tuple, list[_Search]] = {}
    for s in searches:
        places.setdefault(s.place(), []).append(s)
    return list(places.values())


def _measure(rows: DataFrame, keys: Sequence[str], stratum: str | None, searches: Sequence[_Search]) -> None:
    """Size and span of the open key for searches that have just settled a key."""
    groups = _by_place(searches)
    aggregates = []
    for group in groups:
        key = F.when(group[0].candidates(keys, stratum), F.col(keys[len(group[0].fixed)]))
        aggregates += [F.count(key), F.min(key), F.max(key)]
    found = rows.agg(*aggregates).first()
    for i, group in enumerate(groups):
        for s in group:
            s.found(*found[3 * i : 3 * i + 3])


def _round(rows: DataFrame, keys: Sequence[str], stratum: str | None, searches: Sequence[_Search]) -> None:
    """One histogram a place; every search goes on in the bin that holds its position."""
    groups = _by_place(searches)
    hits = []
    for i, group in enumerate(groups):
        s = group[0]
        key = F.col(keys[len(s.fixed)])
        hit = F.struct(F.lit(i).alias("place"), _bin(key, s.least, s.most).alias("bin"), key.alias("key"))
        hits.append(F.when(s.candidates(keys, stratum), hit))
    # places settle different keys, whose types may differ: one histogram for each key
    counts: dict[int, list] = {i: [] for i in range(len(groups))}
    for depth in sorted({len(g[0].fixed) for g in groups}):
        own = [h for h, g in zip(hits, groups) if len(g[0].fixed) == depth]
        binned = rows.select(F.inline(F.array_compact(F.array(*own))))
        table = binned.groupBy("place", "bin").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        for row in table.collect():
            counts[row.place].append((row.bin, row.n, row.least, row.most))
    for i, group in enumerate(groups):
        for s in group:
            for which, n, least, most in sorted(counts[i]):
                if s.position <= n:
                    s.bins = [*s.bins, (s.least, s.most, which)]
                    s.found(n, least, most)
                    break
                s.position -= n


def _fetch(rows: DataFrame, keys: Sequence[str], stratum: str | None, searches: Sequence[_Search]) -> None:
    if not searches:
        return
    groups = _by_place(searches)
    hits = F.array(*[F.when(g[0].candidates(keys, stratum), F.lit(i)) for i, g in enumerate(groups)])
    found = rows.select(F.explode(F.array_compact(hits)).alias("_search"), *keys).collect()
    values: dict[int, list[tuple]] = {i: [] for i in range(len(groups))}
    for row in found:
        values[row[0]].append(tuple(row[1:]))
    for i, group in enumerate(groups):
        for s in group:
            s.fixed = list(sorted(values[i])[s.position - 1])


def running_totals(
    df: DataFrame,
    key: str,
    values: Mapping[str, str],
    scratch: Scratch,
    by: str | None = None,
    following: Mapping[str, str] | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Append running totals over ascending ``key``, itself included, named by the dict keys.

    ``key`` is numeric and distinct in ``df`` (within ``by``, if given, which starts the totals anew). ``following`` names
    columns for values of the next row, NULL after the last. NULL and NaN keys are refused.

    At every size the rows are cut into ranges of about ``range_rows``, 100,000 unless given; a range is summed by itself and raised by the total
    of the ranges before it. One row per range meets in one task.
    """
    rows = scratch.table(df, "totals")
    n = refuse_blank(rows, [key], "running totals")
    following = following or {}
    order = [key] if by is None else [by, key]
    ranged = rows.repartitionByRange(max(1, math.ceil(n / (range_rows or _RANGE))), *order)
    ranged = scratch.table(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    group = ["_range"] if by is None else [by, "_range"]
    inside = Window.partitionBy(*group).orderBy(key)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = Window.orderBy("_range") if by is None else Window.partitionBy(by).orderBy("_range")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(*group).agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in values.items()],
        *[F.min_by(value, key).alias(f"_first_{name}") for name, value in following.items()],
    )
    base = base.select(
        *[F.col(c).alias(f"_on_{c}") for c in group],
        *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}") for name in values],
        *[F.lead(f"_first_{name}").over(ranges).alias(f"_next_{name}") for name in following],
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in group])
    totals = {name: F.sum(value).over(upto) + F.col(f"_base_{name}") for name, value in values.items()}
    # values are not NULL, so a NULL says that the next row is in the next range
    totals |= {name: F.coalesce(F.lead(value).over(inside), F.col(f"_next_{name}")) for name, value in following.items()}
    return ranged.join(base, same).withColumns(totals).select(*rows.columns, *totals)


def global_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    scratch: Scratch,
    name: str = "rank",
    sums: Mapping[str, str] | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Append each row's place in ``order``, from 1 without gaps, and ``sums``: running totals of columns, the row included.

    Order columns have any type and may say how they sort. Infinities are the least and the greatest numbers, NaN comes after them,
    and NULL first unless a column says otherwise. Rows equal in all of them take places in any order; sums of NULL count as 0.

    Rows are dealt out by ranges of the order of about ``range_rows`` rows, 100,000 unless given, and written before any
    place is taken, so a lost executor finds the same ranges again. A range is numbered by itself and raised by what the ranges before it hold:
    no task gets more than a range, equal rows are dealt to several, and one row a range meets in one window.
    """
    rows = scratch.table(df, "ranking")
    sums = sums or {}
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = max(1, math.ceil(rows.count() / (range_rows or _RANGE)))
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys, "_tie")
    ranged = scratch.table(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*keys, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_range").agg(
        F.count("*").alias("_size"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{total}") for total, c in sums.items()]
    )
    base = base.select(
        F.col("_range").alias("_on"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"),
        *[F.coalesce(F.sum(f"_sum_{total}").over(before), F.lit(0)).alias(f"_base_{total}") for total in sums],
    )
    places = {name: (F.count("*").over(inside) + F.col("_base")).cast("bigint")}
    places |= {total: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_base_{total}") for total, c in sums.items()}
    return ranged.join(base, F.col("_range") == F.col("_on")).withColumns(places).select(*rows.columns, *places)
