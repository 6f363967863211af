"""Risk model: encoding learned on train rows, L2 logistic regression, odds ratios."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import small_table
from .levels import distinct_levels
from .newton import Design, level_number, packed_rows, sized_for_solver, solve

#: Inverse of the penalty on the coefficients.
INVERSE_PENALTY = 0.5
#: Features up to which a model is fitted by Newton steps: a task sends half the square of it each time.
NEWTON = 512


def level_texts(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Categories as text; booleans as 'True' and 'False'."""
    types = dict(df.dtypes)
    return {c: F.initcap(F.col(c).cast("string")) if types[c] == "boolean" else F.col(c) for c in cols}


@dataclass(frozen=True)
class Encoding:
    """Means and population deviations of the numeric columns, levels of the categorical ones."""

    means: dict[str, float]
    deviations: dict[str, float]
    levels: dict[str, list[str]]

    def numeric(self) -> dict[str, Column]:
        """A constant column is only centred."""
        return {
            c: (F.col(c).cast("double") - F.lit(mean)) / F.lit(self.deviations[c] or 1.0)
            for c, mean in self.means.items()
        }

    def factors(self, df: DataFrame) -> dict[str, tuple[Column, list[str]]]:
        """Texts of each categorical column, and the levels that have a dummy."""
        texts = level_texts(df, list(self.levels))
        return {c: (texts[c], levels[1:]) for c, levels in self.levels.items()}

    def dummies(self, df: DataFrame) -> dict[str, Column]:
        """0/1 per level but the first by name; a level not seen in training is all zeros."""
        texts = level_texts(df, list(self.levels))
        return {
            f"{c}_{level}": F.when(texts[c] == F.lit(level), 1.0).otherwise(0.0)
            for c, levels in self.levels.items()
            for level in levels[1:]
        }

    def features(self, df: DataFrame) -> dict[str, Column]:
        return {**self.numeric(), **self.dummies(df)}


def learn_encoding(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_levels: int = 2000
) -> Encoding:
    """Two small aggregates over the train rows; a column of more than ``max_levels`` levels is refused."""
    stats = train.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"sd_{c}") for c in numeric]
    ).first()
    texts = train.select(*[col.alias(c) for c, col in level_texts(train, categorical).items()])
    return Encoding(
        {c: stats[f"avg_{c}"] for c in numeric},
        {c: stats[f"sd_{c}"] for c in numeric},
        distinct_levels(texts, categorical, max_levels),
    )


def balanced_weights(train: DataFrame, label: str) -> tuple[Column, int]:
    """Weight column ``n / (2 n_k)`` from one count per class, and n."""
    counts = {row[0]: row[1] for row in train.groupBy(F.col(label).cast("boolean")).count().collect()}
    if None in counts:
        raise ValueError(f"NULL {label} in {counts[None]} rows")
    n = sum(counts.values())
    if len(counts) != 2:
        raise ValueError(f"{label} has one class only")
    event, other = n / (2 * counts[True]), n / (2 * counts[False])
    return F.when(F.col(label).cast("boolean"), F.lit(event)).otherwise(F.lit(other)), n


@dataclass(frozen=True)
class RiskModel:
    """An encoding with a coefficient for each of its features, by name, and an intercept."""

    encoding: Encoding
    names: list[str]
    coefficients: list[float]
    intercept: float

    def probability(self, df: DataFrame) -> Column:
        """Of an event, as an expression: a factor adds the coefficient of its level, looked up by the level's number."""
        own = dict(zip(self.names, self.coefficients))
        parts = [F.lit(self.intercept), *[col * F.lit(own[c]) for c, col in self.encoding.numeric().items()]]
        for c, (text, levels) in self.encoding.factors(df).items():
            weights = F.array(F.lit(0.0), *[F.lit(own[f"{c}_{level}"]) for level in levels])
            parts.append(F.element_at(weights, (level_number(text, levels) + 1).cast("int")))
        return 1 / (1 + F.exp(-reduce(Column.__add__, parts)))

    def score(self, df: DataFrame, name: str = "model_risk") -> DataFrame:
        """Append the predicted probability of an event."""
        return df.select("*", self.probability(df).alias(name))

    def odds_table(self, df: DataFrame) -> DataFrame:
        """``feature, odds_ratio``, highest first; per standard deviation for numeric features."""
        rows = [(name, math.exp(b)) for name, b in zip(self.names, self.coefficients)]
        table = small_table(df.sparkSession, rows, "feature string, odds_ratio double")
        return table.orderBy(F.desc("odds_ratio"), "feature")


def _assembled(df: DataFrame, encoding: Encoding) -> DataFrame:
    """Append ``features``: sparse vectors, so a factor of thousands of levels is one number a row until it is a vector's entry."""
    factors = encoding.factors(df)
    numbers = {}
    for k, (text, levels) in enumerate(factors.values()):
        number = level_number(text, levels)  # 0 where no dummy is 1: the category that the encoder leaves out, the last one
        numbers[f"_n{k}"] = F.when(number == 0, len(levels)).otherwise(number - 1).cast("double")
    wide = df.select("*", *[c.alias(f"_f{k}") for k, c in enumerate(encoding.numeric().values())], *[c.alias(n) for n, c in numbers.items()])
    hot = [f"_h{k}" for k in range(len(numbers))]
    if hot:
        last = small_table(df.sparkSession, [tuple(float(len(levels)) for _, levels in factors.values())], ", ".join(f"{n} double" for n in numbers))
        wide = OneHotEncoder(inputCols=list(numbers), outputCols=hot, dropLast=True).fit(last).transform(wide)
    inputs = [*[f"_f{k}" for k in range(len(encoding.means))], *hot]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(wide).drop(*inputs, *numbers)


def fit_risk_model(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, c: float = INVERSE_PENALTY, newton: int = NEWTON
) -> RiskModel:
    """Class-balanced logistic regression with penalty ``1 / c`` on all coefficients but the intercept.

    ``train`` is read several times: pass a written table. Up to ``newton`` features take Newton steps, one pass over the rows
    each and few of them; a wider model is left to Spark's quasi-Newton solver, on sparse vectors. Spark divides the loss by the sum of weights, which
    balanced weights keep at n. The numeric columns are scaled already, so the solver must not scale again.
    """
    encoding = learn_encoding(train, numeric, categorical)
    weight, n = balanced_weights(train, label)
    event = F.col(label).cast("double")
    design = Design(encoding.numeric(), encoding.factors(train), joint="_")
    names = list(encoding.numeric()) + [f"{f}_{level}" for f, (_, levels) in design.factors.items() for level in levels]
    if len(names) <= newton:
        packed = packed_rows(train, [design], event * weight, weight)
        packed = sized_for_solver(packed, n, sum(map(len, (design.numeric, design.factors)))).persist()
        try:
            (found,) = solve(packed, [design], penalty=1 / c)
        finally:
            packed.unpersist()
        return RiskModel(encoding, names, [float(b) for b in found.estimates[1:]], float(found.estimates[0]))
    rows = _assembled(train, encoding).select("features", event.alias("label"), weight.alias("weight"))
    solver = LogisticRegression(
        weightCol="weight", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8
    )
    model = solver.fit(sized_for_solver(rows, n, len(numeric) + len(categorical)))
    return RiskModel(encoding, names, model.coefficients.toArray().tolist(), float(model.intercept))
