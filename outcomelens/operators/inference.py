"""Unpenalised logistic regression with Wald inference: odds ratios, intervals, p-values.

Covariates of these models take few values, so rows are first summed to distinct covariate patterns
with counts. The likelihood depends on nothing else: fitting the counts as weights gives the same
estimates and standard errors, and every iteration reads the patterns instead of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import small_table
from .newton import Design, packed_rows, sized_for_solver, solve

_Z95 = NormalDist().inv_cdf(0.975)
#: Levels of one factor that a fit accepts unless told otherwise.
MAX_LEVELS = 2000


def covariate_patterns(df: DataFrame, label: str, covariates: Sequence[str]) -> DataFrame:
    """Distinct covariate values, NULL being one, with ``n`` rows and ``events``; rows without an outcome are left out."""
    known = df.select(*covariates, F.col(label).cast("int").alias("_event")).dropna(subset=["_event"])
    return known.groupBy(*covariates).agg(F.count("*").alias("n"), F.sum("_event").alias("events"))


def _complete(patterns: DataFrame) -> DataFrame:
    """Patterns without a NULL: the rows that a fit can use."""
    return patterns.dropna(subset=[c for c in patterns.columns if c not in ("n", "events")])


class NotEstimable(ValueError):
    """The rows do not determine the estimates asked for; ``gone`` tells which levels had left the fit."""

    def __init__(self, why: str, gone: Fit | None = None):
        super().__init__(why)
        self.gone = gone if gone is not None else Fit()


def _exp(x: float) -> float:
    try:
        return math.exp(x)
    except OverflowError:
        return math.inf


@dataclass(frozen=True)
class Term:
    """An estimate and what it is worth: ``estimated``, ``separated``, ``no rows`` or ``not estimable``."""

    name: str
    estimate: float
    se: float
    told: str = ""

    @property
    def z(self) -> float:
        return self.estimate / self.se

    @property
    def p_value(self) -> float:
        return math.erfc(abs(self.z) / math.sqrt(2))

    @property
    def odds_ratio(self) -> float:
        return _exp(self.estimate)

    @property
    def ci95(self) -> tuple[float, float]:
        return _exp(self.estimate - _Z95 * self.se), _exp(self.estimate + _Z95 * self.se)

    @property
    def separated(self) -> bool:
        """Taken to have no finite estimate: beyond 15 an odds ratio is in the millions. A guess by size, not a test."""
        return abs(self.estimate) > 15

    @property
    def status(self) -> str:
        return self.told or ("separated" if self.separated else "estimated")

    def numbers(self) -> tuple[float | None, ...]:
        """Odds ratio, its limits and the p-value; nothing unless estimated."""
        return (self.odds_ratio, *self.ci95, self.p_value) if self.status == "estimated" else (None,) * 4


class Fit(list):
    """The terms of a fit, the ``factor=level`` names that left it and how many rows they took along."""

    def __init__(self, terms: Sequence[Term] = (), dropped: Sequence[str] = (), dropped_rows: int = 0):
        super().__init__(terms)
        self.dropped, self.dropped_rows = list(dropped), dropped_rows


def term_table(spark: SparkSession, terms: Sequence[Term]) -> DataFrame:
    """``term, estimate, se, z, p_value, odds_ratio, ci95_low, ci95_high, separated``."""
    rows = [(t.name, t.estimate, t.se, t.z, t.p_value, t.odds_ratio, *t.ci95, t.separated) for t in terms]
    schema = "term string, estimate double, se double, z double, p_value double, odds_ratio double, "
    return small_table(spark, rows, schema + "ci95_low double, ci95_high double, separated boolean")


@dataclass(frozen=True)
class Model:
    """What one fit is about: the patterns it uses, numeric terms by name, factors with their reference level (``None``: the first by name)."""

    numeric: Mapping[str, Column]
    categorical: Mapping[str, str | None] = field(default_factory=dict)
    rows: Column | None = None


def _usable(
    patterns: DataFrame, models: Mapping[str, Model], max_levels: int
) -> tuple[dict[str, Column], dict[str, dict[str, list[str]]], dict[str, Fit], dict[str, NotEstimable]]:
    """For each model the patterns that inform its fit, levels per factor, reference first, and what was dropped; or why there is no fit.

    A level with only events or only non-events has an infinite estimate. In that limit its rows say nothing
    about the other terms, so they leave the fit, repeatedly until no such level is left. A round counts the levels of all models at once.
    """
    rows = {name: F.lit(True) if m.rows is None else F.coalesce(m.rows, F.lit(False)) for name, m in models.items()}
    gone = {name: Fit() for name in models}
    levels: dict[str, dict[str, list[str]]] = {name: {} for name, m in models.items() if not m.categorical}
    failed: dict[str, NotEstimable] = {}
    before: dict[str, int] = {}
    while open_ := [name for name in models if name not in levels and name not in failed]:
        pairs = [
            F.when(rows[name], F.struct(F.lit(name).alias("model"), F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")))
            for name in open_
            for c in models[name].categorical
        ]
        table = (
            patterns.select(F.inline(F.array_compact(F.array(*pairs))), "n", "events")
            .groupBy("model", "factor", "level")
            .agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
        )
        found = table.limit(max_levels * len(pairs) + 1).collect()
        for name in open_:
            factors = models[name].categorical
            own = [row for row in found if row.model == name]
            counted = {c: sorted(row.level for row in own if row.factor == c) for c in factors}
            if crowded := [c for c, names in counted.items() if len(names) > max_levels]:
                raise ValueError(f"more than {max_levels} levels in {crowded}")
            size = sum(row.n for row in own if row.factor == next(iter(factors)))
            gone[name].dropped_rows += before.get(name, size) - size
            before[name] = size
            flat = sorted((row for row in own if row.events in (0, row.n)), key=lambda r: (list(factors).index(r.factor), r.level))
            if not own:
                failed[name] = NotEstimable("no level is left whose outcome varies", gone[name])
            elif fixed := next((row for row in flat if row.level == factors[row.factor]), None):
                failed[name] = NotEstimable(f"{fixed.factor}: the outcome does not vary at the reference {fixed.level!r}", gone[name])
            elif flat:
                for row in flat:
                    gone[name].dropped.append(f"{row.factor}={row.level}")
                    rows[name] = rows[name] & (F.col(row.factor) != row.level)
            else:
                first = lambda c: lambda level: (level != factors[c], level)  # noqa: E731, B023
                levels[name] = {c: sorted(names, key=first(c)) for c, names in counted.items()}
    return rows, levels, gone, failed


def fit_models(patterns: DataFrame, models: Mapping[str, Model], max_levels: int = MAX_LEVELS) -> dict[str, Fit | NotEstimable]:
    """Fits of several models to the same patterns, by name; a model that its rows do not determine has the reason in place of a fit.

    The terms of a fit are without the intercept: numeric ones by name, factors as ``factor=level``. A factor of more than
    ``max_levels`` levels is refused. Patterns with a NULL are not used. Constant columns are left out, and levels whose
    outcome does not vary, which the result names. However many models there are, the levels, the spread of the columns and each
    step of the fits are counted in one pass for all of them.
    """
    patterns = _complete(patterns)
    rows, levels, gone, failed = _usable(patterns, models, max_levels)
    out: dict[str, Fit | NotEstimable] = dict(failed)
    open_ = [name for name in models if name not in failed]
    if not open_:
        return out
    spans = patterns.agg(
        *[
            F.struct(F.count_if(rows[name]), *[F.min(F.when(rows[name], x)) for c in models[name].numeric.values() for x in (c.cast("double"),)],
                     *[F.max(F.when(rows[name], x)) for c in models[name].numeric.values() for x in (c.cast("double"),)])
            for name in open_
        ]
    ).first()
    designs: dict[str, Design] = {}
    for name, (size, *ends) in zip(open_, spans, strict=True):
        model = models[name]
        half = len(ends) // 2
        varying = {c: col for (c, col), least, most in zip(model.numeric.items(), ends[:half], ends[half:], strict=True) if least != most}
        factors = {c: (F.col(c).cast("string"), found[1:]) for c, found in levels[name].items()}
        design = Design(varying, factors, rows[name])
        if size < 2 or not design.names:
            out[name] = NotEstimable("all rows share one covariate pattern", gone[name])
        else:
            designs[name] = design
    if not designs:
        return out
    fits = list(designs.values())
    packed = packed_rows(patterns, fits, F.col("events"), F.col("n"))
    packed = sized_for_solver(packed, patterns.count(), sum(sum(d.widths()[1], len(d.numeric)) for d in fits)).persist()
    try:
        for (name, design), found in zip(designs.items(), solve(packed, fits), strict=True):
            if not found.determined:
                out[name] = NotEstimable("no unique estimates: the design columns determine each other", gone[name])
            else:
                terms = [Term(t, found.estimate(t), found.error(t)) for t in design.names]
                out[name] = Fit(terms, gone[name].dropped, gone[name].dropped_rows)
    finally:
        packed.unpersist()
    return out


def fit_logit(
    patterns: DataFrame,
    numeric: Mapping[str, Column],
    categorical: Mapping[str, str | None],
    max_levels: int = MAX_LEVELS,
) -> Fit:
    """The fit of one model, as in ``fit_models``. Raises if the rows do not determine it."""
    fit = fit_models(patterns, {"": Model(numeric, categorical)}, max_levels)[""]
    if isinstance(fit, NotEstimable):
        raise fit
    return fit


def named_terms(
    patterns: DataFrame, models: Mapping[str, Model], names: Mapping[str, Sequence[str]], max_levels: int = MAX_LEVELS
) -> dict[str, Fit]:
    """For each model the terms asked for, in that order, whether the rows determine them or not.

    A level that only events or only non-events have is ``separated``, one that no row has is ``no rows``, and what the rows
    leave open otherwise, as in a stratum without exposed rows, is ``not estimable``; those have NaN.
    """
    fits = fit_models(patterns, models, max_levels)
    fits = {name: fit.gone if isinstance(fit, NotEstimable) else fit for name, fit in fits.items()}
    found = {name: {t.name: t for t in fit} for name, fit in fits.items()}
    missing = [
        (name, term, *term.partition("=")[::2])
        for name in models
        for term in names[name]
        if term not in found[name] and term not in fits[name].dropped and term.partition("=")[0] in models[name].categorical
    ]
    if missing:  # one pass tells which of those levels have rows at all
        held = [F.lit(True) if models[name].rows is None else models[name].rows for name, *_ in missing]
        seen = _complete(patterns).agg(*[F.count_if(rows & (F.col(factor) == level)) for rows, (_, _, factor, level) in zip(held, missing, strict=True)]).first()
        missing = [(name, term) for (name, term, *_), n in zip(missing, seen, strict=True) if not n]
    out = {}
    for name in models:
        terms = []
        for term in names[name]:
            told = "separated" if term in fits[name].dropped else "no rows" if (name, term) in missing else "not estimable"
            terms.append(found[name].get(term) or Term(term, math.nan, math.nan, told))
        out[name] = Fit(terms, fits[name].dropped, fits[name].dropped_rows)
    return out


def fit_terms(
    patterns: DataFrame,
    names: Sequence[str],
    numeric: Mapping[str, Column],
    categorical: Mapping[str, str | None],
    max_levels: int = MAX_LEVELS,
) -> Fit:
    """Every term of ``names`` of one model, as in ``named_terms``."""
    return named_terms(patterns, {"": Model(numeric, categorical)}, {"": names}, max_levels)[""]


def stratified_logit(
    patterns: DataFrame,
    stratum: str,
    strata: Sequence[str],
    exposure: str,
    exposed: Column,
    numeric: Mapping[str, Column],
    categorical: Mapping[str, str | None],
    also: Mapping[str, tuple[Model, Sequence[str]]] | None = None,
) -> list[tuple[str, int, float | None, float | None, Fit]]:
    """Adjusted effect of ``exposed`` within each named stratum: name, rows, both crude rates, fit of that one term.

    Rows and rates are over all rows of the stratum, those with a NULL covariate included, which the fit cannot use. Levels
    are taken anew in each stratum. ``also`` names more models and the terms asked of each; they are fitted in the same passes, and come after the
    strata, with no rows and rates. The number of passes does not depend on the number of strata.
    """
    also = also or {}
    size, events = F.col("n"), F.col("events")
    crude = patterns.where(F.col(stratum).isin(list(strata))).groupBy(stratum).agg(
        F.sum(size),
        F.sum(F.when(~exposed, events)) / F.sum(F.when(~exposed, size)),
        F.sum(F.when(exposed, events)) / F.sum(F.when(exposed, size)),
    )
    crude = {name: numbers for name, *numbers in crude.collect()}
    models = {f"stratum {name}": Model({exposure: exposed, **numeric}, categorical, F.col(stratum) == name) for name in strata}
    models |= {name: model for name, (model, _) in also.items()}
    names = {name: [exposure] for name in models} | {name: terms for name, (_, terms) in also.items()}
    fits = named_terms(patterns, models, names)
    out = [(name, *crude.get(name, (0, None, None)), fits[f"stratum {name}"]) for name in strata]
    return out + [(name, 0, None, None, fits[name]) for name in also]
