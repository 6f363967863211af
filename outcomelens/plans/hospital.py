"""The hospital pipeline: raw text encounters and three lookups in, result tables out.

Every function returns a lazy DataFrame. The model and the inference fit eagerly, as every Spark ML estimator
does; they read tables written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    as_int,
    band_midpoint,
    classify_code,
    flag_label,
    keep_levels,
    label_missing,
    map_codes,
    null_if,
    parse_number,
    round_half_even,
    step,
    top_coded,
)
from ..operators.cohort import cohort_funnel, first_per_entity, index_cohort
from ..operators.evaluate import compare_scores, decile_table, with_quantile
from ..operators.exposure import exposure_by_stratum, exposure_groups, exposure_summary
from ..operators.inference import Fit, Model, Term, covariate_patterns, named_terms, stratified_logit
from ..operators.levels import top_level_names
from ..operators.lookups import Lookup, attach_labels
from ..operators.profile import kpi_row, rate_profile
from ..operators.quality import (
    CountWhere,
    DuplicateKeys,
    OrphanCodes,
    RepeatedLabels,
    Rule,
    run_suite,
)
from ..operators.risk_model import RiskModel, fit_risk_model
from ..operators.score import band_validation, points_score
from ..operators.split import stratified_split
from ..sources import Scratch, small_table
from . import fixed_values as V

OUTCOME = "readmitted_30d"


@dataclass(frozen=True)
class RawTables:
    """All-text encounters and typed lookups with an id and a ``description`` column each."""

    encounters: DataFrame
    admission_type: DataFrame
    admission_source: DataFrame
    discharge_disposition: DataFrame

    def lookups(self) -> dict[str, Lookup]:
        tables = {
            "admission_type": self.admission_type,
            "admission_source": self.admission_source,
            "discharge_disposition": self.discharge_disposition,
        }
        return {
            name: Lookup(table, f"{name}_id", F.col(f"{name}_id").cast("int"))
            for name, table in tables.items()
        }


# ---------------------------------------------------------------- cleaning


def code_groups() -> dict[str, Column]:
    """The three coded columns as groups, from strictly cast codes."""
    return {
        "admission_type_group": map_codes(
            F.col("admission_type_id").cast("int"), V.ADMISSION_TYPE_GROUPS, V.ADMISSION_TYPE_DEFAULT
        ),
        "admission_source_group": map_codes(
            F.col("admission_source_id").cast("int"), V.ADMISSION_SOURCE_GROUPS, V.ADMISSION_SOURCE_DEFAULT
        ),
        "discharge_group": map_codes(
            F.col("discharge_disposition_id").cast("int"), V.DISCHARGE_GROUPS, V.DISCHARGE_DEFAULT
        ),
    }


def diagnosis_group(df: DataFrame, code: str, name: str = "primary_diagnosis_group") -> DataFrame:
    """Append the ICD-9 chapter of ``code``. The number is parsed once, not once per rule."""
    chapter = classify_code(F.col(code), F.col("_number"), V.DIAGNOSIS_RULES, V.DIAGNOSIS_DEFAULT)
    return df.withColumn("_number", parse_number(F.col(code))).withColumn(name, chapter).drop("_number")


def stage(raw: RawTables) -> DataFrame:
    """Typed encounters: sentinels resolved, codes labelled and grouped, outcome and flags derived."""
    labelled = diagnosis_group(attach_labels(raw.encounters, raw.lookups()), "diag_1")
    groups = code_groups()
    return labelled.select(
        *_strict("bigint", encounter_id="encounter_id", patient_nbr="patient_nbr"),
        null_if(F.col("race"), "?").alias("race"),
        null_if(F.col("gender"), "Unknown/Invalid").alias("gender"),
        F.col("age").alias("age_band"),
        band_midpoint(F.col("age")).alias("age_mid"),
        *_strict("int", admission_type_id="admission_type_id"),
        "admission_type",
        groups["admission_type_group"].alias("admission_type_group"),
        *_strict("int", admission_source_id="admission_source_id"),
        "admission_source",
        groups["admission_source_group"].alias("admission_source_group"),
        *_strict("int", discharge_disposition_id="discharge_disposition_id"),
        "discharge_disposition",
        groups["discharge_group"].alias("discharge_group"),
        *_strict("int", los_days="time_in_hospital"),
        label_missing(F.col("medical_specialty"), "?", "Unknown").alias("medical_specialty"),
        *_strict(
            "int",
            num_lab_procedures="num_lab_procedures",
            num_procedures="num_procedures",
            num_medications="num_medications",
            number_diagnoses="number_diagnoses",
            prior_outpatient="number_outpatient",
            prior_emergency="number_emergency",
            prior_inpatient="number_inpatient",
        ),
        "diag_1",
        "primary_diagnosis_group",
        F.col("A1Cresult").alias("hba1c_result"),
        (F.col("A1Cresult") != "None").alias("hba1c_tested"),
        (F.col("change") == "Ch").alias("medication_changed"),
        (F.col("diabetesMed") == "Yes").alias("on_diabetes_medication"),
        "insulin",
        F.col("readmitted").alias("readmitted_raw"),
        (F.col("readmitted") == "<30").alias(OUTCOME),
    )


def _strict(kind: str, **sources: str) -> list[Column]:
    """Casts that fail on bad text: new name = raw column."""
    return [F.expr(f"cast({source} as {kind}) as {name}") for name, source in sources.items()]


# ---------------------------------------------------------------- quality


def quality_rules(raw: RawTables) -> list[Rule]:
    def unknown(column: str, codes: Sequence[int]) -> CountWhere:
        return CountWhere(F.col(column).cast("int").isin(*codes))

    tests = {
        1: DuplicateKeys("encounter_id"),
        2: CountWhere(F.col("race") == "?"),
        3: CountWhere(F.col("weight") == "?"),
        4: CountWhere(F.col("payer_code") == "?"),
        5: CountWhere(F.col("medical_specialty") == "?"),
        6: CountWhere(F.col("diag_1") == "?"),
        7: CountWhere(F.col("gender") == "Unknown/Invalid"),
        8: DuplicateKeys("patient_nbr"),
        9: unknown("discharge_disposition_id", V.DISCHARGE_GROUPS[V.NOT_READMITTABLE]),
        10: unknown("admission_type_id", V.UNKNOWN_ADMISSION_TYPES),
        11: unknown("admission_source_id", V.UNKNOWN_ADMISSION_SOURCES),
        12: unknown("discharge_disposition_id", V.UNKNOWN_DISCHARGES),
        13: OrphanCodes(list(raw.lookups().values())),
        14: RepeatedLabels(raw.admission_source),
        15: CountWhere(F.col("A1Cresult") == "None"),
    }
    return [Rule(check_id, V.CHECKS[check_id][0], test, V.CHECKS[check_id][1]) for check_id, test in tests.items()]


def data_quality(raw: RawTables) -> DataFrame:
    return run_suite(raw.encounters, quality_rules(raw))


# ---------------------------------------------------------------- cohort


def _readmittable() -> Column:
    return (F.col("discharge_group") != V.NOT_READMITTABLE) & F.col("gender").isNotNull()


def cohort(staged: DataFrame) -> DataFrame:
    """First encounter per patient, without those who died, went to hospice, or have no valid gender."""
    return index_cohort(staged, "patient_nbr", "encounter_id", _readmittable())


def cohort_from_raw(raw: RawTables) -> DataFrame:
    """The same cohort straight from the raw table: only first encounters are cleaned and coded.

    Everything staging computes, and the wider rows it makes, is spent on one row per patient.
    """
    keyed = raw.encounters.withColumns(
        {c: F.col(c).cast("bigint") for c in ("encounter_id", "patient_nbr")}
    )
    first = first_per_entity(keyed, "patient_nbr", "encounter_id")
    return stage(replace(raw, encounters=first)).where(_readmittable())


def funnel(staged: DataFrame) -> DataFrame:
    return cohort_funnel(staged, "patient_nbr", "encounter_id", _readmittable(), V.FUNNEL_STEPS)


# ---------------------------------------------------------------- rates


def overall(members: DataFrame) -> DataFrame:
    return kpi_row(members, OUTCOME, {"avg_los_days": "los_days"}, {"hba1c_tested_pct": "hba1c_tested"})


def dimensions() -> dict[str, Column]:
    return {
        V.AGE: F.col("age_band"),
        V.DIAGNOSIS: F.col("primary_diagnosis_group"),
        V.SOURCE: F.col("admission_source_group"),
        V.DISCHARGE: F.col("discharge_group"),
        V.INPATIENT: top_coded(F.col("prior_inpatient"), 3),
        V.EMERGENCY: top_coded(F.col("prior_emergency"), 2),
        V.STAY: step(F.col("los_days"), *V.STAY_RANGES),
        V.HBA1C: flag_label(F.col("hba1c_tested"), "Tested", "Not tested"),
    }


def profile(members: DataFrame, min_rows: int = V.MIN_GROUP) -> DataFrame:
    return rate_profile(members, OUTCOME, dimensions(), min_rows).orderBy("dimension", "category")


# ---------------------------------------------------------------- score


def with_score(members: DataFrame) -> DataFrame:
    """The cohort with its points, score and band."""
    acute = (F.col("admission_type_group") == "Emergency / trauma") | (
        F.col("admission_source_group") == "Emergency room"
    )
    points = {
        "l_points": step(F.col("los_days"), *V.LENGTH_OF_STAY_POINTS),
        "a_points": F.when(acute, V.ACUTE_POINTS).otherwise(0),
        "c_points": step(F.col("number_diagnoses"), *V.DIAGNOSES_POINTS),
        "e_points": F.least(F.col("prior_emergency"), F.lit(V.MAX_EMERGENCY_POINTS)),
    }
    return points_score(members, points, "lace_score", V.SCORE_BANDS, V.LOWEST_BAND)


def risk_scores(members: DataFrame) -> DataFrame:
    points = ["l_points", "a_points", "c_points", "e_points"]
    return with_score(members).select(
        "encounter_id", "patient_nbr", OUTCOME, *points, "lace_score", "risk_band"
    )


def score_bands(members: DataFrame) -> DataFrame:
    return band_validation(with_score(members), "lace_score", OUTCOME)


# ---------------------------------------------------------------- exposure


def _exposure(labels: tuple[str, str, str, str]) -> Column:
    return exposure_groups(
        F.col("hba1c_tested"), F.col("hba1c_result") == "Norm", F.col("medication_changed"), labels
    )


def hba1c_groups(members: DataFrame) -> DataFrame:
    group = _exposure(V.EXPOSURE_LABELS).alias("hba1c_group")
    return members.select("encounter_id", group, "primary_diagnosis_group", OUTCOME)


def hba1c_summary(members: DataFrame) -> DataFrame:
    return exposure_summary(hba1c_groups(members), "hba1c_group", OUTCOME)


def hba1c_by_diagnosis(members: DataFrame) -> DataFrame:
    unexposed = F.col("hba1c_group") == V.EXPOSURE_LABELS[0]
    return exposure_by_stratum(
        hba1c_groups(members), "primary_diagnosis_group", V.EXPOSURE_STRATA, unexposed, OUTCOME
    )


# ---------------------------------------------------------------- model


def analysis_rows(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The cohort with score, outcome, filled race, grouped specialty, exposure and test mark, all written: fits read it many times.

    The specialties to keep are chosen over all rows, before the split.
    """
    wanted = ["encounter_id", "lace_score", "y", *V.NUMERIC_FEATURES, *V.CATEGORICAL_FEATURES]
    scored = scratch.table(
        with_score(members)
        .withColumn("y", as_int(F.col(OUTCOME)))
        .withColumn("race", label_missing(F.col("race"), None, "Unknown"))
        .withColumn("hba1c_group", _exposure(V.MODEL_EXPOSURE_LABELS))
        .select(*[c for c in wanted if c != "specialty_grp"], "medical_specialty"),
        "cohort",
    )
    top = top_level_names(scored, "medical_specialty", V.TOP_SPECIALTIES)
    grouped = scored.withColumn("specialty_grp", keep_levels(F.col("medical_specialty"), top))
    return scratch.table(stratified_split(grouped.select(*wanted), "encounter_id", "y", V.TEST_SHARE, V.SEED), "analysis")


def fit_model(rows: DataFrame) -> RiskModel:
    train = rows.where(~F.col("is_test"))
    return fit_risk_model(train, V.NUMERIC_FEATURES, V.CATEGORICAL_FEATURES, "y")


def scored_test_rows(rows: DataFrame, model: RiskModel, scratch: Scratch) -> DataFrame:
    """Test rows with ``model_risk`` and the two simpler scores, written once."""
    test = model.score(rows.where(F.col("is_test")))
    return scratch.table(test.select("encounter_id", "y", *V.METHODS.values()), "scored")


def model_comparison(test: DataFrame, scratch: Scratch) -> DataFrame:
    return compare_scores(test, V.METHODS, "y", "encounter_id", scratch, V.FOLLOW_UP_SHARE)


def risk_deciles(test: DataFrame, score: str = "model_risk") -> DataFrame:
    return decile_table(with_quantile(test, score, "encounter_id"), "decile", "y")


# ---------------------------------------------------------------- inference

_ADJUST_FACTORS = {"admission_source_group": None, "discharge_group": None}


def inference_patterns(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Covariate patterns that all exposure models below are fitted to, written once."""
    rows = members.withColumn("hba1c_group", _exposure(V.MODEL_EXPOSURE_LABELS))
    factors = ["hba1c_group", "primary_diagnosis_group", *_ADJUST_FACTORS]
    return scratch.table(covariate_patterns(rows, OUTCOME, [*V.ADJUST_NUMERIC, *factors]), "patterns")


def _tested() -> Column:
    return F.col("hba1c_group") != V.MODEL_EXPOSURE_LABELS[0]


def _adjust() -> dict[str, Column]:
    return {name: F.col(name) for name in V.ADJUST_NUMERIC}


def _groups_model() -> tuple[Model, list[str]]:
    """Each exposure group against 'Not tested', adjusted; every group has a term."""
    factors = {"hba1c_group": V.MODEL_EXPOSURE_LABELS[0], "primary_diagnosis_group": None, **_ADJUST_FACTORS}
    return Model(_adjust(), factors), [f"hba1c_group={label}" for label in sorted(V.MODEL_EXPOSURE_LABELS[1:])]


def _tested_model() -> tuple[Model, list[str]]:
    """Any test against none, adjusted."""
    return Model({"tested": _tested(), **_adjust()}, {"primary_diagnosis_group": None, **_ADJUST_FACTORS}), ["tested"]


def _interaction_model(one: str = "Diabetes", other: str = "Circulatory") -> tuple[Model, list[str]]:
    """Does the effect of testing differ between two diagnoses? The product term."""
    is_one = F.col("primary_diagnosis_group") == one
    product = {"tested": _tested(), "subgroup": is_one, "tested:subgroup": _tested() & is_one}
    return Model({**product, **_adjust()}, _ADJUST_FACTORS, F.col("primary_diagnosis_group").isin(one, other)), ["tested:subgroup"]


def _fit_of(patterns: DataFrame, asked: tuple[Model, list[str]]) -> Fit:
    model, names = asked
    return named_terms(patterns, {"": model}, {"": names})[""]


def adjusted_groups(patterns: DataFrame) -> Fit:
    return _fit_of(patterns, _groups_model())


def adjusted_tested(patterns: DataFrame) -> Fit:
    return _fit_of(patterns, _tested_model())


def interaction(patterns: DataFrame) -> Term:
    return _fit_of(patterns, _interaction_model())[0]


def _by_stratum(patterns: DataFrame, also: dict[str, tuple[Model, list[str]]]) -> tuple[list[tuple], dict[str, Fit]]:
    """The strata's rows, rates and fits, and the fits of ``also``, made in the same passes."""
    fits = stratified_logit(
        patterns, "primary_diagnosis_group", V.MODEL_STRATA, "tested", _tested(), _adjust(), _ADJUST_FACTORS, also
    )
    return fits[: len(V.MODEL_STRATA)], {name: fit for name, *_, fit in fits[len(V.MODEL_STRATA) :]}


_ODDS_SCHEMA = "odds_ratio double, ci95_low double, ci95_high double, p_value double"
_FIT_SCHEMA = "status string, dropped_levels string, dropped_rows bigint"


def _fit_notes(term: Term, fit: Fit) -> tuple[str, str, int]:
    return term.status, ", ".join(fit.dropped), fit.dropped_rows


def _rounded(table: DataFrame) -> DataFrame:
    """Odds ratios and limits to 3 places, p-values to 4, rates to 2."""
    places = {"p_value": 4, "interaction_p_diabetes_vs_circulatory": 4}
    places |= {"rate_not_tested_pct": 2, "rate_tested_pct": 2}
    return table.select(
        *[
            round_half_even(F.col(c), places.get(c, 3)).alias(c) if kind == "double" else F.col(c)
            for c, kind in table.dtypes
        ]
    )


def _groups_table(spark: SparkSession, fit: Fit) -> DataFrame:
    rows = [(t.name.partition("=")[2], *t.numbers(), *_fit_notes(t, fit)) for t in fit]
    return _rounded(small_table(spark, rows, f"group_vs_not_tested string, {_ODDS_SCHEMA}, {_FIT_SCHEMA}"))


def _tested_table(spark: SparkSession, fit: Fit) -> DataFrame:
    return _rounded(small_table(spark, [(*fit[0].numbers(), *_fit_notes(fit[0], fit))], f"{_ODDS_SCHEMA}, {_FIT_SCHEMA}"))


def _strata_table(spark: SparkSession, fits: list[tuple], product: Term) -> DataFrame:
    rows = [
        (
            name,
            n,
            *[r if r is None else 100 * r for r in rates],
            *fit[0].numbers(),
            product.numbers()[-1],
            *_fit_notes(fit[0], fit),
        )
        for name, n, *rates, fit in fits
    ]
    schema = (
        "primary_diagnosis string, patients bigint, rate_not_tested_pct double, rate_tested_pct double, "
        "adjusted_odds_ratio double, ci95_low double, ci95_high double, p_value double, "
        f"interaction_p_diabetes_vs_circulatory double, {_FIT_SCHEMA}"
    )
    return _rounded(small_table(spark, rows, schema))


def hba1c_adjusted(patterns: DataFrame) -> DataFrame:
    """A row for every exposure group; numbers only where ``status`` is ``estimated``."""
    return _groups_table(patterns.sparkSession, adjusted_groups(patterns))


def hba1c_tested_adjusted(patterns: DataFrame) -> DataFrame:
    return _tested_table(patterns.sparkSession, adjusted_tested(patterns))


def hba1c_by_diagnosis_adjusted(patterns: DataFrame) -> DataFrame:
    """A row for every diagnosis of the study, in its order."""
    fits, more = _by_stratum(patterns, {"interaction": _interaction_model()})
    return _strata_table(patterns.sparkSession, fits, more["interaction"][0])


def adjusted_tables(patterns: DataFrame) -> dict[str, DataFrame]:
    """The three tables above, all their models fitted in the same passes."""
    asked = {"groups": _groups_model(), "tested": _tested_model(), "interaction": _interaction_model()}
    fits, more = _by_stratum(patterns, asked)
    spark = patterns.sparkSession
    return {
        "hba1c_adjusted": _groups_table(spark, more["groups"]),
        "hba1c_tested_adjusted": _tested_table(spark, more["tested"]),
        "hba1c_by_diagnosis_adjusted": _strata_table(spark, fits, more["interaction"][0]),
    }
