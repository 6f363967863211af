"""Logistic regressions of several designs over the same rows, by Newton's method.

Every pass adds up, for all designs at once, what a step needs: the gradient, the information matrix and the likelihood. Tasks send one number
an entry of the matrices, however many rows they have; Spark adds them up and the driver solves systems as large as the designs are wide.
The number of passes does not depend on the number of designs. Rows travel as their numeric values and the number of each factor's
level, so a factor of many levels is one number a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a design, the intercept included, whose matrix a driver solves.
WIDEST = 2500
#: Tasks whose sums the driver adds up itself; those of more are added up by a shuffle first.
FEW = 8
#: Rows that a task makes dense at a time.
_ROWS = 2048


@dataclass
class Design:
    """What a fit is about: the rows that take part, numeric columns, and factors with the levels that have a dummy each.

    A level not listed has all dummies zero, as the reference has.
    """

    numeric: Mapping[str, Column]
    factors: Mapping[str, tuple[Column, Sequence[str]]] = field(default_factory=dict)
    rows: Column | None = None
    joint: str = "="

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"{name}{self.joint}{level}" for name, (_, levels) in self.factors.items() for level in levels)]

    def packed(self) -> Column:
        """Numeric values and level numbers, 0 for a level without a dummy; NULL where a row takes no part."""
        values = [c.cast("double") for c in self.numeric.values()]
        values += [level_number(c, levels).cast("double") for c, levels in self.factors.values()]
        packed = F.array(*values) if values else F.array().cast("array<double>")
        return packed if self.rows is None else F.when(self.rows, packed)

    def widths(self) -> tuple[int, list[int]]:
        return len(self.numeric), [len(levels) for _, levels in self.factors.values()]


def level_number(text: Column, levels: Sequence[str]) -> Column:
    """Place of a text among the levels, from 1; 0 for any other and for NULL."""
    if not levels:
        return F.lit(0)
    return F.coalesce(F.array_position(F.array(*map(F.lit, levels)), text), F.lit(0)) if len(levels) < 16 else F.coalesce(
        F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, levels)), F.array(*[F.lit(k + 1) for k in range(len(levels))])), text), F.lit(0)
    )


def dense(packed: np.ndarray, widths: tuple[int, list[int]]) -> np.ndarray:
    """The design matrix of packed rows: an intercept, the numeric columns, the dummies."""
    numeric, levels = widths
    x = np.zeros((len(packed), 1 + numeric + sum(levels)))
    x[:, 0] = 1
    x[:, 1 : 1 + numeric] = packed[:, :numeric]
    at = numeric
    for k, n in enumerate(levels):
        number = packed[:, numeric + k].astype(int)
        some = np.flatnonzero(number)
        x[some, at + number[some]] = 1
        at += n
    return x


def _sums(x: np.ndarray, events: np.ndarray, size: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper triangle of the information matrix, the gradient and the log-likelihood, end to end."""
    line = x @ b
    chance = np.where(line >= 0, 1 / (1 + np.exp(-np.abs(line))), 1 - 1 / (1 + np.exp(-np.abs(line))))
    information = x.T @ (x * (size * chance * (1 - chance))[:, None])
    likelihood = events @ line - size @ np.logaddexp(0, line)
    return np.concatenate([information[np.triu_indices(len(b))], x.T @ (events - size * chance), [likelihood]])


def _pass(at: dict[int, np.ndarray], widths: dict[int, tuple[int, list[int]]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            events, size = (batch.column(c).to_numpy() for c in ("events", "size"))
            for k, b in at.items():
                column = batch.column(f"_x{k}")
                took = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                width = widths[k][0] + len(widths[k][1])
                packed = column.flatten().to_numpy().reshape(-1, width) if width else np.zeros((len(took), 0))
                for low in range(0, len(took), _ROWS):
                    rows = slice(low, low + _ROWS)
                    more = _sums(dense(packed[rows], widths[k]), events[took[rows]], size[took[rows]], b)
                    total[k] = total[k] + more if k in total else more
        for k, sums in total.items():
            entries = np.arange(len(sums))
            columns = [pa.array(np.full(len(sums), k), pa.int32()), pa.array(entries, pa.int32()), pa.array(sums, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["design", "entry", "value"])

    return scan


def sized_for_solver(rows: DataFrame, n: int, width: int) -> DataFrame:
    """At most one partition per 4 million numbers (32 MB).

    A solver runs a job per iteration; with partitions much smaller than that it would mostly start tasks. Rows are dealt
    anew, so what makes them (a scan, a filter) keeps its own tasks. Larger data keeps its partitions.
    """
    wanted = max(1, math.ceil(n * width / 4_000_000))
    return rows.repartition(wanted) if wanted < rows.rdd.getNumPartitions() else rows


@dataclass
class Solution:
    """Estimates by name, the intercept first as ``""``, their covariance, and whether the rows determine them."""

    names: list[str]
    estimates: np.ndarray
    covariance: np.ndarray | None
    determined: bool
    passes: int = 0

    def estimate(self, name: str) -> float:
        return float(self.estimates[self.names.index(name)])

    def error(self, name: str) -> float:
        k = self.names.index(name)
        return math.nan if self.covariance is None else math.sqrt(max(0.0, self.covariance[k, k]))


def packed_rows(rows: DataFrame, designs: Sequence[Design], events: Column, size: Column) -> DataFrame:
    """What ``solve`` reads of the rows: a packed column for each design, events and size."""
    return rows.select(*[d.packed().alias(f"_x{k}") for k, d in enumerate(designs)], events.cast("double").alias("events"), size.cast("double").alias("size"))


def solve(packed: DataFrame, designs: Sequence[Design], penalty: float = 0.0, most: int = 50, tolerance: float = 1e-9) -> list[Solution]:
    """Logistic fits of ``packed_rows``: ``events`` of ``size`` trials a row. ``penalty`` / 2 times the squared estimates but the intercept is added.

    A fit ends when no estimate moves by more than ``tolerance`` of itself, or the last step but one left the likelihood as it was, to eleven
    places; steps gain so fast then that the estimates are as good. A step that lowers the likelihood is halved. Estimates without
    a finite limit (separated ones) grow by about one a step until the likelihood no longer tells. A design whose columns determine
    each other, or that no row takes part in, is not determined unless there is a penalty.
    """
    widths = {k: d.widths() for k, d in enumerate(designs)}
    if wide := [len(d.names) for d in designs if len(d.names) >= WIDEST]:
        raise ValueError(f"a design of {max(wide)} columns; at most {WIDEST - 1}")
    zero = {k: np.zeros(1 + len(d.names)) for k, d in enumerate(designs)}
    found = {k: Solution(["", *d.names], zero[k], None, False) for k, d in enumerate(designs)}
    now, step, best = dict(zero), {}, {}
    passes = 0
    few = packed.rdd.getNumPartitions() <= FEW
    while now and passes < most:
        passes += 1
        sums = packed.mapInArrow(_pass(now, widths), "design int, entry int, value double")
        if not few:
            sums = sums.groupBy("design", "entry").agg(F.sum("value").alias("value"))
        total: dict[int, np.ndarray] = {}
        for design, entry, value in sums.collect():
            p = len(now[design])
            total.setdefault(design, np.zeros(p * (p + 1) // 2 + p + 1))[entry] += value
        for k in list(now):
            p = len(now[k])
            if k not in total:  # no row takes part
                del now[k]
                continue
            values = total[k]
            information = np.zeros((p, p))
            information[np.triu_indices(p)] = values[: p * (p + 1) // 2]
            information += np.triu(information, 1).T
            shrink = np.append(0.0, np.full(p - 1, penalty))
            gradient = values[-p - 1 : -1] - shrink * now[k]
            likelihood = values[-1] - (shrink * now[k] ** 2).sum() / 2
            if passes == 1 and not penalty and not _determined(information):
                del now[k]
                continue
            if k in best and likelihood < best[k] - 1e-9 * abs(best[k]) and np.abs(step[k]).max() > 1e-12:
                step[k] = step[k] / 2
                now[k] = now[k] - step[k]
                continue
            flat = k in best and likelihood - best[k] <= 1e-11 * abs(likelihood)
            best[k] = likelihood
            try:
                covariance = np.linalg.inv(information + np.diag(shrink))
            except np.linalg.LinAlgError:
                found[k] = Solution(found[k].names, now[k], None, True, passes)
                del now[k]
                continue
            step[k] = covariance @ gradient
            at = now[k] + step[k]
            found[k] = Solution(found[k].names, at, covariance, True, passes)
            if flat or not np.isfinite(at).all() or (np.abs(step[k]) <= tolerance * (1 + np.abs(at))).all():
                del now[k]
            else:
                now[k] = at
    return [found[k] for k in range(len(designs))]


def _determined(information: np.ndarray) -> bool:
    """Whether no column but the intercept is constant or follows from the others, by the correlations of the rows."""
    n = information[0, 0]
    if n <= 0 or len(information) < 2:
        return n > 0
    mean = information[0, 1:] / n
    spread = information[1:, 1:] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(spread), 0))
    if (deviation <= 1e-12 * (1 + np.abs(mean))).any():
        return False
    return bool(np.linalg.eigvalsh(spread / np.outer(deviation, deviation)).min() >= 1e-9)
