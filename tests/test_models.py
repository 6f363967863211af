"""Fits against Newton's method in numpy on the same rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcomelens.operators import newton as newton_steps
from outcomelens.operators.inference import (
    Model,
    NotEstimable,
    Term,
    covariate_patterns,
    fit_logit,
    fit_models,
    fit_terms,
    stratified_logit,
    term_table,
)
from outcomelens.operators.newton import Design, packed_rows, sized_for_solver, solve
from outcomelens.operators.risk_model import _assembled, fit_risk_model, learn_encoding


def newton(x, y, w=None, penalty=0.0):
    """Weighted logistic fit with intercept first; the intercept is not penalised."""
    x = np.column_stack([np.ones(len(y)), x])
    w = np.ones(len(y)) if w is None else w
    ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (w * p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(info, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-12:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


@pytest.fixture(scope="module")
def sample():
    rnd = np.random.default_rng(11)
    n = 4000
    age, stays = rnd.integers(0, 9, n) * 10 + 5, rnd.poisson(0.6, n)
    group = rnd.choice(["none", "normal", "high"], n, p=[0.7, 0.2, 0.1])
    place = rnd.choice(["home", "care", "ward"], n)
    eta = -2.4 + 0.01 * age + 0.3 * stays - 0.4 * (group == "normal") + 0.5 * (place == "care")
    y = (rnd.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return [
        (int(i), int(a), int(s), str(g), str(p), int(t))
        for i, (a, s, g, p, t) in enumerate(zip(age, stays, group, place, y))
    ]


@pytest.fixture(scope="module")
def df(spark, sample):
    schema = "id bigint, age int, stays int, grp string, place string, y int"
    return spark.createDataFrame(sample, schema).cache()


def _design(rows, levels):
    cols = [[r[1] for r in rows], [r[2] for r in rows]]
    cols += [[float(r[3] == g) for r in rows] for g in levels["grp"]]
    cols += [[float(r[4] == p) for r in rows] for p in levels["place"]]
    return np.array(cols, float).T


def test_adjusted_logit(df, sample):
    patterns = covariate_patterns(df, "y", ["age", "stays", "grp", "place"])
    assert patterns.agg(F.sum("n")).first()[0] == len(sample) > patterns.count()
    terms = fit_logit(patterns, {"age": F.col("age"), "stays": F.col("stays")}, {"grp": "none", "place": None})
    assert [t.name for t in terms] == ["age", "stays", "grp=high", "grp=normal", "place=home", "place=ward"]
    x = _design(sample, {"grp": ["high", "normal"], "place": ["home", "ward"]})
    beta, se = newton(x, np.array([r[5] for r in sample], float))
    assert np.allclose([t.estimate for t in terms], beta[1:], atol=1e-8)
    assert np.allclose([t.se for t in terms], se[1:], atol=1e-8)


def test_stratified_logit(df, sample):
    patterns = covariate_patterns(df, "y", ["age", "stays", "grp", "place"])
    exposed = F.col("grp") != "none"
    out = stratified_logit(
        patterns, "place", ["care", "home"], "tested", exposed, {"age": F.col("age"), "stays": F.col("stays")}, {}
    )
    for name, n, rate0, rate1, (term,) in out:
        rows = [r for r in sample if r[4] == name]
        y = np.array([r[5] for r in rows], float)
        t = np.array([r[3] != "none" for r in rows])
        x = np.column_stack([t, [r[1] for r in rows], [r[2] for r in rows]]).astype(float)
        beta, se = newton(x, y)
        assert n == len(rows)
        assert (rate0, rate1) == pytest.approx((y[~t].mean(), y[t].mean()))
        assert (term.estimate, term.se) == pytest.approx((beta[1], se[1]), abs=1e-8)


def test_separated_level_leaves_the_fit(spark, df, sample):
    """A level without events would have an infinite estimate; the others stay as in that limit."""
    rows = spark.createDataFrame([(10_000 + i, 45, 1, "none", "gone", 0) for i in range(30)], df.schema)
    patterns = covariate_patterns(df.union(rows), "y", ["age", "stays", "grp", "place"])
    numeric = {"age": F.col("age"), "stays": F.col("stays")}
    with_level = fit_logit(patterns, numeric, {"grp": "none", "place": None})
    without = fit_logit(patterns.where("place <> 'gone'"), numeric, {"grp": "none", "place": None})
    assert [t.name for t in with_level] == [t.name for t in without]
    assert np.allclose([t.estimate for t in with_level], [t.estimate for t in without], atol=1e-10)


def test_stratum_that_determines_nothing(spark, df):
    patterns = covariate_patterns(df.where("grp = 'none' or place <> 'care'"), "y", ["stays", "grp", "place"])
    exposed = F.col("grp") != "none"
    (name, n, rate0, rate1, (term,)), (_, n2, *none, (term2,)) = stratified_logit(
        patterns, "place", ["care", "nowhere"], "tested", exposed, {"stays": F.col("stays")}, {}
    )
    assert n > 0 and 0 < rate0 < 1 and rate1 is None and math.isnan(term.estimate)
    assert (n2, none) == (0, [None, None]) and math.isnan(term2.p_value)
    assert term.status == term2.status == "not estimable" and term.numbers() == (None,) * 4


def test_stratum_counts_rows_with_a_blank_covariate(spark, df):
    blank = spark.createDataFrame([(20_000 + i, None, 1, "none", "care", i % 2) for i in range(10)], df.schema)
    exposed, numeric = F.col("grp") != "none", {"age": F.col("age")}
    covariates = ["age", "grp", "place"]
    plain = stratified_logit(covariate_patterns(df, "y", covariates), "place", ["care"], "t", exposed, numeric, {})[0]
    more = stratified_logit(covariate_patterns(df.union(blank), "y", covariates), "place", ["care"], "t", exposed, numeric, {})[0]
    assert more[1] == plain[1] + 10 and more[2] != plain[2] and more[3] == plain[3]
    assert more[4][0].estimate == pytest.approx(plain[4][0].estimate, abs=1e-9)


@pytest.mark.parametrize(("group", "outcome"), [("high", 0), ("high", 1)])
def test_groups_without_variation_keep_their_row(df, group, outcome):
    rows = df.withColumn("y", F.when(F.col("grp") == group, outcome).otherwise(F.col("y")))
    patterns = covariate_patterns(rows, "y", ["age", "grp", "place"])
    names = ["grp=high", "grp=normal", "grp=other"]
    fit = fit_terms(patterns, names, {"age": F.col("age")}, {"grp": "none", "place": None})
    assert [(t.name, t.status) for t in fit] == list(zip(names, ["separated", "estimated", "no rows"], strict=True))
    assert fit.dropped == ["grp=high"] and fit.dropped_rows == rows.where("grp = 'high'").count()


def test_reference_without_variation_keeps_all_rows(df):
    rows = df.withColumn("y", F.when(F.col("grp") == "none", 0).otherwise(F.col("y")))
    patterns = covariate_patterns(rows, "y", ["age", "grp"])
    fit = fit_terms(patterns, ["grp=high", "grp=normal"], {"age": F.col("age")}, {"grp": "none"})
    assert [t.status for t in fit] == ["not estimable"] * 2


def test_separated_exposure_has_no_numbers(df):
    rows = df.withColumn("y", F.when(F.col("grp") == "high", 0).otherwise(F.col("y")))
    patterns = covariate_patterns(rows, "y", ["age", "grp"])
    (term,) = fit_terms(patterns, ["t"], {"t": F.col("grp") == "high", "age": F.col("age")}, {})
    assert term.status == "separated" and term.numbers() == (None,) * 4


def test_level_cap_is_per_factor(df):
    patterns = covariate_patterns(df, "y", ["grp", "place"])
    assert len(fit_logit(patterns, {}, {"grp": None, "place": None}, max_levels=3)) == 4
    with pytest.raises(ValueError, match="more than 2 levels"):
        fit_logit(patterns, {}, {"grp": None, "place": None}, max_levels=2)
    with pytest.raises(ValueError, match="more than 2 levels"):
        learn_encoding(df, ["age"], ["grp"], max_levels=2)


def test_solver_partitions_leave_the_scan_alone(spark, df, scratch):
    table = scratch.table(df.repartition(12), "wide").where("place = 'care'")
    sized = sized_for_solver(table, 100, 5)
    assert sized.rdd.getNumPartitions() == 1
    assert "Exchange" in sized._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in sized._jdf.queryExecution().executedPlan().toString()


def test_huge_estimates_stay_numbers():
    assert Term("x", 20.0, 1e6).ci95 == (0.0, math.inf)


def test_constant_column_is_left_out(df):
    patterns = covariate_patterns(df, "y", ["stays"])
    terms = fit_logit(patterns, {"stays": F.col("stays"), "same": F.lit(3)}, {})
    assert [t.name for t in terms] == ["stays"]


def test_dependent_columns_are_refused(df):
    patterns = covariate_patterns(df, "y", ["stays"])
    with pytest.raises(ValueError, match="determine each other"):
        fit_logit(patterns, {"stays": F.col("stays"), "twice": F.col("stays") * 2}, {})


def test_wald_numbers(spark):
    term = Term("tested", -0.2, 0.1)
    row = term_table(spark, [term]).first()
    assert row.z == -2.0 and row.p_value == pytest.approx(0.04550026389635842)
    assert row.odds_ratio == math.exp(-0.2)
    assert row.ci95_low == pytest.approx(math.exp(-0.2 - 0.1959963984540054))
    assert Term("x", 40.0, 1.0).p_value < 1e-300 and Term("x", 40.0, 1.0).separated


def test_risk_model(df, sample):
    model = fit_risk_model(df, ["age", "stays"], ["grp", "place"], "y")
    assert model.names == ["age", "stays", "grp_none", "grp_normal", "place_home", "place_ward"]
    x = _design(sample, {"grp": ["none", "normal"], "place": ["home", "ward"]})
    x[:, :2] = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0)
    y = np.array([r[5] for r in sample], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, _ = newton(x, y, w, penalty=1 / 0.5)
    assert np.allclose([model.intercept, *model.coefficients], beta, atol=1e-9)
    risk = {r.id: r.model_risk for r in model.score(df).select("id", "model_risk").collect()}
    want = 1 / (1 + np.exp(-np.column_stack([np.ones(len(y)), x]) @ beta))
    assert np.allclose([risk[i] for i in range(len(y))], want, atol=1e-9)
    odds = model.odds_table(df).collect()
    assert [r.odds_ratio for r in odds] == sorted((r.odds_ratio for r in odds), reverse=True)


def test_unseen_level_has_no_dummy(spark, df):
    encoding = learn_encoding(df.where("place <> 'ward'"), ["age"], ["place"])
    new = spark.createDataFrame([(50, "ward"), (50, "home")], "age int, place string")
    dummies = encoding.dummies(new)
    assert list(dummies) == ["place_home"]
    assert [r[0] for r in new.select(dummies["place_home"]).collect()] == [0.0, 1.0]


def test_boolean_levels_and_constant_numbers(spark):
    train = spark.createDataFrame([(True, 2, 1), (False, 2, 0)], "flag boolean, same int, y int")
    encoding = learn_encoding(train, ["same"], ["flag"])
    assert list(encoding.dummies(train)) == ["flag_True"]
    assert [r[0] for r in train.select(encoding.numeric()["same"]).collect()] == [0.0, 0.0]


def test_wide_models_take_sparse_vectors_to_the_quasi_newton_solver(df):
    """The same model either way; the scores' plan has no Python and no vectors."""
    one = fit_risk_model(df, ["age", "stays"], ["grp", "place"], "y")
    other = fit_risk_model(df, ["age", "stays"], ["grp", "place"], "y", newton=0)
    assert one.names == other.names and np.allclose(one.coefficients, other.coefficients, atol=1e-5)
    vector = _assembled(df, other.encoding).select("features").first()[0]
    assert type(vector).__name__ == "SparseVector" or vector.size == len(other.names)
    plan = one.score(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan


def test_thousands_of_levels(spark):
    rows = [(k, f"l{k % 2000}", k % 7, int(k % 3 == 0)) for k in range(6000)]
    df = spark.createDataFrame(rows, "id int, level string, x int, y int")
    model = fit_risk_model(df, ["x"], ["level"], "y")
    assert len(model.names) == 2000 and model.score(df).agg(F.avg("model_risk")).first()[0] == pytest.approx(0.5, abs=0.02)


def test_many_models_in_the_same_passes(df, sample):
    """One stratum or all: the slowest fit tells how many jobs there are, and the fits are those of each alone."""
    patterns = covariate_patterns(df, "y", ["age", "stays", "grp", "place"]).cache()
    exposed, numeric = F.col("grp") != "none", {"age": F.col("age"), "stays": F.col("stays")}
    context = df.sparkSession.sparkContext
    jobs, found = [], []
    for strata in (["care"], ["care", "home", "ward"]):
        context.setJobGroup(f"strata {len(strata)}", "")
        out = stratified_logit(patterns, "place", strata, "t", exposed, numeric, {})
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"strata {len(strata)}")))
        found.append({name: fit[0] for name, *_, fit in out})
    context.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 4
    assert found[0]["care"].estimate == pytest.approx(found[1]["care"].estimate, abs=1e-10)


def test_models_of_other_rows_and_factors(df):
    patterns = covariate_patterns(df, "y", ["age", "stays", "grp", "place"])
    models = {
        "all": Model({"age": F.col("age")}, {"grp": "none"}),
        "care": Model({"stays": F.col("stays"), "age": F.col("age")}, {}, F.col("place") == "care"),
        "nowhere": Model({"age": F.col("age")}, {"grp": None}, F.col("place") == "nowhere"),
        "constant": Model({"x": F.lit(1)}, {}),
    }
    fits = fit_models(patterns, models)
    alone = fit_logit(patterns, {"age": F.col("age")}, {"grp": "none"})
    assert [(t.name, round(t.estimate, 9)) for t in fits["all"]] == [(t.name, round(t.estimate, 9)) for t in alone]
    care = fit_logit(patterns.where("place = 'care'"), {"stays": F.col("stays"), "age": F.col("age")}, {})
    assert [t.se for t in fits["care"]] == pytest.approx([t.se for t in care], abs=1e-9)
    assert isinstance(fits["nowhere"], NotEstimable) and isinstance(fits["constant"], NotEstimable)


def test_steps_that_overshoot_are_halved(spark):
    """Newton's first step from 0 is too long here; the likelihood still ends at its maximum."""
    rows = [(1.0, 1000, 1000), (-30.0, 5, 0), (2.0, 4000, 3990), (-1.0, 1, 1)]
    df = spark.createDataFrame(rows, "x double, n long, events long")
    design = Design({"x": F.col("x")})
    (found,) = solve(packed_rows(df, [design], F.col("events"), F.col("n")), [design])
    x = np.array([[1, r[0]] for r in rows])
    n, e = (np.array([r[k] for r in rows], float) for k in (1, 2))
    chance = 1 / (1 + np.exp(-x @ found.estimates))
    assert np.abs(x.T @ (e - n * chance)).max() < 1e-4 * n.sum()
    assert found.determined


def test_designs_too_wide_and_rows_that_take_no_part(spark):
    df = spark.createDataFrame([(1.0, 2, 1)], "x double, n long, events long")
    none = Design({"x": F.col("x")}, rows=F.lit(False))
    (found,) = solve(packed_rows(df, [none], F.col("events"), F.col("n")), [none])
    assert not found.determined
    with pytest.raises(ValueError, match="columns"):
        solve(df, [Design({}, {"f": (F.col("x"), [str(k) for k in range(3000)])})])


def test_sums_of_many_tasks_are_added_up_by_a_shuffle(df, monkeypatch):
    patterns = covariate_patterns(df, "y", ["age", "grp"])
    one = fit_logit(patterns, {"age": F.col("age")}, {"grp": "none"})
    monkeypatch.setattr(newton_steps, "FEW", 0)
    other = fit_logit(patterns, {"age": F.col("age")}, {"grp": "none"})
    assert [(t.name, t.estimate, t.se) for t in one] == [(t.name, pytest.approx(t.estimate), pytest.approx(t.se)) for t in other]
