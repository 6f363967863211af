"""Every operator as a query over the whole test tables: ``name -> callable(spark, folder)``."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import job
from .functions import round_half_even
from .operators import evaluate, inference, levels, lookups, ordering, profile, quality, risk_model
from .plans import fixed_values as V
from .plans import hospital, testbed
from .sources import (
    Scratch,
    export_csv,
    load_counts,
    load_tables,
    read_lookup,
    read_stacked,
    read_text_table,
    small_table,
    split_stacked,
)

Query = Callable[[SparkSession, str], DataFrame]


def _staged(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.stage(testbed.raw_tables(spark, folder))


def _cohort(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.cohort_from_raw(testbed.raw_tables(spark, folder))


def _loaded(spark: SparkSession, folder: str, columns: list[str]) -> hospital.RawTables:
    """Raw tables with some encounter columns written once, for queries that read them several times; the rest is NULL."""
    raw = testbed.raw_tables(spark, folder)
    written = Scratch(spark).table(raw.encounters.select(*columns), "raw")
    absent = {c: F.lit(None).cast("string") for c in testbed.RAW_COLUMNS if c not in columns}
    return replace(raw, encounters=written.withColumns(absent))


_CHECKED_COLUMNS = [
    "encounter_id", "patient_nbr", "race", "weight", "payer_code", "medical_specialty", "diag_1", "gender",
    "discharge_disposition_id", "admission_type_id", "admission_source_id", "A1Cresult",
]


_PROFILE_COLUMNS = [
    "age_band", "primary_diagnosis_group", "admission_source_group", "discharge_group", "prior_inpatient",
    "prior_emergency", "los_days", "hba1c_tested", hospital.OUTCOME,
]


def _cohort_table(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """The cohort's profile columns written once, for queries that read them several times."""
    return Scratch(spark).table(_cohort(spark, folder).select(*_PROFILE_COLUMNS, *more), "cohort")


def _baseline(members: DataFrame):
    return hospital.overall(members).select("readmission_rate_pct").scalar()


# ---------------------------------------------------------------- loading


def q_load_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts, with a claim about three tables, one of them wrong on purpose."""
    tables = {name: testbed.table(spark, folder, name) for name in testbed.SCHEMAS}
    counts = load_counts(tables, {"region": 5, "nation": 25, "supplier": 0})
    check = F.when(F.col("as_expected"), "as expected").when(~F.col("as_expected"), "differs")
    return counts.select("table_name", "n_rows", check.otherwise("nothing expected").alias("check"))


def q_read_text(spark: SparkSession, folder: str) -> DataFrame:
    """The raw encounters as header CSV files in the shared folder, read back as text."""
    out = Scratch(spark).folder("csv")
    export_csv({"encounters": testbed.encounters(spark, folder).select(*testbed.RAW_COLUMNS)}, out)
    return read_text_table(spark, f"{out}/encounters")


def q_read_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup as a sorted CSV file, read back with its types."""
    out = Scratch(spark).folder("csv")
    table = testbed.raw_tables(spark, folder).admission_source
    export_csv({"lookup": table}, out, order={"lookup": table.columns})
    return read_lookup(spark, f"{out}/lookup", "admission_source_id int, description string")


def q_stacked_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a stacked file of three small tables, split and parsed again."""

    def section(header: str, *rows):
        return F.concat(F.lit(header + "\r\n"), F.concat_ws("\n", *rows), F.lit("\n"))

    def row(number, text):
        return F.concat(number.cast("string"), F.lit(',"'), text, F.lit('"'))

    size, key = F.col("p_size"), F.col("p_partkey")
    text = F.concat_ws(
        ",\n",
        section("size,brand", row(size, F.concat("p_brand", F.lit(", new"))), row(size + 1, F.col("p_brand"))),
        section("key,type", row(key, F.col("p_type"))),
        section("size,name", row(size, F.concat(F.lit('the ""'), "p_name", F.lit('""'))), F.lit("")),
    )
    files = testbed.table(spark, folder, "part").select("p_partkey", text.alias("text"))
    return split_stacked(
        files, "text", ["brand", "type", "name"], "id bigint, description string", keep=["p_partkey"]
    )


def q_stacked_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stacked file per part size, written line by line and read back over its splits."""
    parts = testbed.table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    quoted = lambda text: F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    texts = [F.concat("p_brand", F.lit(", new")), F.col("p_type"), F.concat(F.lit('the "'), "p_name", F.lit('"'))]
    rows = [F.struct(F.lit(k).alias("part"), F.lit(1).alias("kind"), F.concat_ws(",", key, quoted(text)).alias("line")) for k, text in enumerate(texts)]
    lines = parts.select(F.col("p_size").alias("file"), "p_partkey", F.inline(F.array(*rows)))
    heads = [(k, 0, "key,text") for k in range(3)] + [(k, 2, ",") for k in range(2)]
    edges = [F.struct(F.lit(k).alias("part"), F.lit(kind).alias("kind"), F.lit(text).alias("line")) for k, kind, text in heads]
    edges = parts.select(F.col("p_size").alias("file")).distinct().select("file", F.lit(0).cast("bigint").alias("p_partkey"), F.inline(F.array(*edges)))
    out = Scratch(spark).folder("stacked")
    placed = lines.unionByName(edges).repartition("file").sortWithinPartitions("file", "part", "kind", "p_partkey")
    placed.select("file", "line").write.partitionBy("file").text(out)
    read = read_stacked(spark, f"{out}/*/*.txt", ["brand", "type", "name"], "p_partkey bigint, description string", Scratch(spark), keep_file=True)
    size = F.regexp_extract("file", r"/file=(\d+)/", 1).cast("int")
    return read.select(size.alias("p_size"), "section", "p_partkey", "description")


def q_load_written(spark: SparkSession, folder: str) -> DataFrame:
    """Tables written once and counted on the way, with the same claims as above."""
    tables = {name: testbed.table(spark, folder, name) for name in ("region", "nation", "supplier", "part", "customer", "orders")}
    _, counts = load_tables(tables, Scratch(spark), {"region": 5, "nation": 25, "supplier": 0})
    check = F.when(F.col("as_expected"), "as expected").when(~F.col("as_expected"), "differs")
    return counts.select("table_name", "n_rows", check.otherwise("nothing expected").alias("check"))


# ---------------------------------------------------------------- staging


def q_staging(spark: SparkSession, folder: str) -> DataFrame:
    return _staged(spark, folder)


def q_band_midpoint(spark: SparkSession, folder: str) -> DataFrame:
    return _staged(spark, folder).groupBy("age_band", "age_mid").agg(F.count("*").alias("n_rows"))


def q_code_groups(spark: SparkSession, folder: str) -> DataFrame:
    raw = testbed.encounters(spark, folder)
    return raw.select(
        F.col("encounter_id").cast("bigint").alias("encounter_id"),
        *[group.alias(name) for name, group in hospital.code_groups().items()],
    )


def q_code_groups_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same groups by mapping tables: one broadcast, the others joined as mappings too large for it are."""
    scratch = Scratch(spark)
    columns = ["encounter_id", "admission_type_id", "admission_source_id", "discharge_disposition_id"]
    out = scratch.table(testbed.encounters(spark, folder).select(*columns), "codes")
    groups = {
        "admission_type_group": ("admission_type_id", V.ADMISSION_TYPE_GROUPS, V.ADMISSION_TYPE_DEFAULT, lookups.MAPPING_BYTES),
        "admission_source_group": ("admission_source_id", V.ADMISSION_SOURCE_GROUPS, V.ADMISSION_SOURCE_DEFAULT, 0),
        "discharge_group": ("discharge_disposition_id", V.DISCHARGE_GROUPS, V.DISCHARGE_DEFAULT, 0),
    }
    for name, (code, labels, default, most) in groups.items():
        mapping = small_table(spark, [(c, label) for label, codes in labels.items() for c in codes], "code int, label string")
        out = lookups.attach_groups(out, F.col(code).cast("int"), mapping, default, name, scratch, most)
    return out.select(F.col("encounter_id").cast("bigint").alias("encounter_id"), *groups)


def q_code_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Awkward codes made from events: letters, decimals, blanks, suffixes, padding, NULL."""
    events = testbed.table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    code = (
        F.when((F.col("event_type") == "view") & (k % 10 == 0), F.lit("?"))
        .when((F.col("event_type") == "view") & (k % 10 == 1), F.lit(None))
        .when(F.col("event_type") == "view", F.concat(F.lit("V"), k.cast("string")))
        .when((F.col("event_type") == "click") & (k % 2 == 0), F.concat(F.lit("E9"), k.cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.lit("250."), k.cast("string")))
        .when(F.col("event_type") == "purchase", F.concat((k * 10 + 5).cast("string"), F.lit(".5")))
        .when((F.col("event_type") == "signup") & (k % 3 == 0), F.concat((k + 700).cast("string"), F.lit("d")))
        .when((F.col("event_type") == "signup") & (k % 3 == 1), F.concat(F.lit(" "), (k + 440).cast("string")))
        .when(F.col("event_type") == "signup", F.concat((k + 440).cast("string"), F.lit(".99")))
        .otherwise(((F.col("event_id") * 7 + k) % 1000).cast("string"))
    )
    coded = events.select("event_id", code.alias("code"))
    return hospital.diagnosis_group(coded, "code", "chapter")


# ---------------------------------------------------------------- quality


def q_dq_suite(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.data_quality(_loaded(spark, folder, _CHECKED_COLUMNS))


def q_orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    raw = testbed.raw_tables(spark, folder)
    return lookups.orphan_keys(raw.encounters, list(raw.lookups().values()))


def q_dup_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.repeated_labels(testbed.raw_tables(spark, folder).admission_source)


def q_dq_display(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_table(hospital.data_quality(_loaded(spark, folder, _CHECKED_COLUMNS)))


def q_missing_share(spark: SparkSession, folder: str) -> DataFrame:
    raw = _loaded(spark, folder, _CHECKED_COLUMNS)
    total = raw.encounters.agg(F.count("*").alias("n")).select("n").scalar()
    return quality.missing_share(
        hospital.data_quality(raw), total, V.MISSING_SHARE_CHECKS, V.MISSING_LABEL, V.LABEL_NOTE
    )


# ---------------------------------------------------------------- cohort, rates


def q_cohort(spark: SparkSession, folder: str) -> DataFrame:
    return _cohort(spark, folder)


def q_cohort_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.funnel(_staged(spark, folder))


def q_kpi(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.overall(_cohort(spark, folder))


def q_rate_profile(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.profile(_cohort(spark, folder))


def q_driver_flags(spark: SparkSession, folder: str) -> DataFrame:
    members = _cohort_table(spark, folder)
    return profile.flag_drivers(hospital.profile(members), _baseline(members), V.ORDINAL_DIMENSIONS)


def q_profile_slice(spark: SparkSession, folder: str) -> DataFrame:
    members = _cohort_table(spark, folder)
    return profile.profile_slice(hospital.profile(members), V.DISCHARGE, _baseline(members))


def q_top_category(spark: SparkSession, folder: str) -> DataFrame:
    members = _cohort_table(spark, folder)
    return profile.top_category(hospital.profile(members), _baseline(members))


def q_headlines(spark: SparkSession, folder: str) -> DataFrame:
    wanted = {
        "rate_3_or_more_stays": (V.INPATIENT, "3+"),
        "rate_no_stay": (V.INPATIENT, "0"),
        "rate_tested": (V.HBA1C, "Tested"),
        "rate_not_tested": (V.HBA1C, "Not tested"),
    }
    members = _cohort_table(spark, folder, "encounter_id", "hba1c_result", "medication_changed")
    diabetes = hospital.hba1c_by_diagnosis(members).where(F.col("primary_diagnosis_group") == "Diabetes")
    return profile.category_rates(hospital.profile(members), wanted).withColumns(
        {
            "diabetes_rate_tested": diabetes.select("tested_pct").scalar(),
            "diabetes_rate_not_tested": diabetes.select("not_tested_pct").scalar(),
        }
    )


# ---------------------------------------------------------------- score, exposure


def q_points_score(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.risk_scores(_cohort(spark, folder))


def q_band_validation(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.score_bands(_cohort(spark, folder))


def q_exposure_groups(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.hba1c_groups(_cohort(spark, folder))


def q_exposure_summary(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.hba1c_summary(_cohort(spark, folder))


def q_exposure_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.hba1c_by_diagnosis(_cohort(spark, folder))


def q_top_levels(spark: SparkSession, folder: str) -> DataFrame:
    return levels.top_levels(_cohort(spark, folder), "medical_specialty", V.TOP_SPECIALTIES)


def q_kept_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = hospital.analysis_rows(_cohort(spark, folder), Scratch(spark))
    return rows.groupBy("specialty_grp", "race").agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- split, features, evaluation of the points score


def _analysis(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    return hospital.analysis_rows(_cohort(spark, folder), scratch)


def q_split(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder, Scratch(spark)).select("encounter_id", "y", "is_test")


def q_features(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled numeric features, the dummies that are 1 and the class weight, for all rows."""
    rows = _analysis(spark, folder, Scratch(spark))
    train = rows.where(~F.col("is_test"))
    encoding = risk_model.learn_encoding(train, V.NUMERIC_FEATURES, V.CATEGORICAL_FEATURES)
    weight, _ = risk_model.balanced_weights(train, "y")
    ones = F.array_compact(F.array(*[F.when(col == 1.0, name) for name, col in encoding.dummies(rows).items()]))
    return rows.select(
        "encounter_id",
        *[F.round(col, 6).alias(name) for name, col in encoding.numeric().items()],
        F.concat_ws("|", F.array_sort(ones)).alias("dummies"),
        F.round(weight, 6).alias("weight"),
    )


def _scored_cohort(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    scored = hospital.with_score(_cohort(spark, folder))
    return scratch.table(scored.select("encounter_id", hospital.OUTCOME, "lace_score"), "scored")


def q_auc(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    return evaluate.auc(_scored_cohort(spark, folder, scratch), "lace_score", hospital.OUTCOME, scratch).select(
        F.round("auc", 9).alias("auc"), "positives", "negatives"
    )


def q_auc_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """AUC of a ratio: hundreds of distinct scores, summed in several ranges of a few scores."""
    scratch = Scratch(spark)
    ratio = F.col("num_medications") / F.col("los_days")
    rows = scratch.table(_cohort(spark, folder).select(hospital.OUTCOME, ratio.alias("per_day")), "ratio")
    return evaluate.auc(rows, "per_day", hospital.OUTCOME, scratch, range_rows=16).select(
        F.round("auc", 9).alias("auc"), "positives", "negatives"
    )


def q_roc_points(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    return evaluate.roc_points(_scored_cohort(spark, folder, scratch), "lace_score", hospital.OUTCOME, scratch)


def q_roc_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """The curve of a price over all lines, which turns at nearly every row, in 25 steps a side."""
    scratch = Scratch(spark)
    lines = testbed.table(spark, folder, "lineitem")
    rows = scratch.table(lines.select("l_extendedprice", (F.col("l_quantity") > 25).alias("large")), "prices")
    return evaluate.roc_points(rows, "l_extendedprice", "large", scratch, steps=25)


def q_capture_top_frac(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored_cohort(spark, folder, Scratch(spark))
    return evaluate.capture_at(rows, "lace_score", hospital.OUTCOME, "encounter_id", V.FOLLOW_UP_SHARE)


def q_deciles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored_cohort(spark, folder, Scratch(spark)).withColumn("y", F.col(hospital.OUTCOME).cast("int"))
    return hospital.risk_deciles(rows, "lace_score").withColumn(
        "weighted_rate_pct", F.round("weighted_rate_pct", 6)
    )


def q_global_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Every line's place by price per discount, infinite without one: many equal infinities, in several ranges."""
    lines = testbed.table(spark, folder, "lineitem")
    per = F.when(F.col("l_discount") == 0, F.lit(math.inf)).otherwise(F.col("l_extendedprice") / F.nullif("l_discount", F.lit(0.0)))
    rows = lines.select("l_orderkey", "l_linenumber", per.alias("per_discount"))
    order = ["per_discount", "l_orderkey", "l_linenumber"]
    ranked = ordering.global_rank(rows, order, Scratch(spark), "place", {"lines_upto": "l_linenumber"}, range_rows=10_000)
    return ranked.select("l_orderkey", "l_linenumber", "place", "lines_upto")


def q_score_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison table for scores that need no model: whole numbers with many ties, and a ratio."""
    scratch = Scratch(spark)
    scored = hospital.with_score(_cohort(spark, folder)).select(
        "encounter_id",
        F.col(hospital.OUTCOME).cast("int").alias("y"),
        "lace_score",
        "prior_inpatient",
        (F.col("num_medications") / F.col("los_days")).alias("per_day"),
    )
    methods = {"Points": "lace_score", "Prior stays": "prior_inpatient", "Medications per day": "per_day"}
    return evaluate.compare_scores(
        scratch.table(scored, "scored"), methods, "y", "encounter_id", scratch, V.FOLLOW_UP_SHARE
    )


# ---------------------------------------------------------------- risk model


def _model_scores(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    rows = _analysis(spark, folder, scratch)
    return hospital.scored_test_rows(rows, hospital.fit_model(rows), scratch)


def q_risk_model(spark: SparkSession, folder: str) -> DataFrame:
    return _model_scores(spark, folder).withColumn("model_risk", F.round("model_risk", 6))


def q_odds_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _analysis(spark, folder, Scratch(spark))
    return hospital.fit_model(rows).odds_table(rows).withColumn("odds_ratio", F.round("odds_ratio", 6))


def q_score_equations(spark: SparkSession, folder: str) -> DataFrame:
    """At the fit, weighted residuals times each feature add up to the penalty's pull; to the intercept's, nothing pulls."""
    rows = _analysis(spark, folder, Scratch(spark))
    train = rows.where(~F.col("is_test"))
    model = hospital.fit_model(rows)
    weight, _ = risk_model.balanced_weights(train, "y")
    rest = weight * (F.col("y") - model.probability(train))
    sums = {"intercept": F.sum(rest)} | {
        name: F.sum(rest * x) - F.lit(b / risk_model.INVERSE_PENALTY)
        for (name, x), b in zip(model.encoding.features(train).items(), model.coefficients, strict=True)
    }
    off = F.array(*[F.struct(F.lit(name).alias("feature"), (F.round(total, 4) + 0.0).alias("off")) for name, total in sums.items()])
    return train.agg(off.alias("off")).select(F.inline("off"))


def q_model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.model_comparison(_model_scores(spark, folder), Scratch(spark))


def q_model_deciles(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.risk_deciles(_model_scores(spark, folder)).withColumn("weighted_rate_pct", F.round("weighted_rate_pct", 6))


def q_model_roc(spark: SparkSession, folder: str) -> DataFrame:
    points = evaluate.roc_points(_model_scores(spark, folder), "model_risk", "y", Scratch(spark))
    return points.withColumn("threshold", F.round("threshold", 6))


# ---------------------------------------------------------------- inference


def _patterns(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.inference_patterns(_cohort(spark, folder), Scratch(spark))


def _estimates(spark: SparkSession, terms: list[inference.Term]) -> DataFrame:
    table = inference.term_table(spark, terms)
    numbers = ["estimate", "se", "z", "odds_ratio", "ci95_low", "ci95_high"]
    rounded = [round_half_even(F.col(c), 6).alias(c) for c in numbers]
    return table.select("term", *rounded, round_half_even(F.col("p_value"), 4).alias("p_value"))


def q_logit_2x2(spark: SparkSession, folder: str) -> DataFrame:
    members = _cohort(spark, folder)
    patterns = inference.covariate_patterns(members, hospital.OUTCOME, ["hba1c_tested"])
    patterns = Scratch(spark).table(patterns, "patterns")
    return _estimates(spark, inference.fit_logit(patterns, {"tested": F.col("hba1c_tested")}, {}))


def q_logit_interaction(spark: SparkSession, folder: str) -> DataFrame:
    """Saturated: testing, diabetes against all other diagnoses, and their product."""
    members = _cohort(spark, folder).withColumn("diabetes", F.col("primary_diagnosis_group") == "Diabetes")
    patterns = inference.covariate_patterns(members, hospital.OUTCOME, ["hba1c_tested", "diabetes"])
    patterns = Scratch(spark).table(patterns, "patterns")
    tested, diabetes = F.col("hba1c_tested"), F.col("diabetes")
    numeric = {"tested": tested, "diabetes": diabetes, "tested:diabetes": tested & diabetes}
    return _estimates(spark, inference.fit_logit(patterns, numeric, {}))


def _exposure_patterns(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    patterns = _patterns(spark, folder)
    return patterns.groupBy("hba1c_group", *more).agg(F.sum("n").alias("n"), F.sum("events").alias("events"))


def q_logit_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The four exposure groups without covariates."""
    patterns = Scratch(spark).table(_exposure_patterns(spark, folder), "groups")
    names = [f"hba1c_group={label}" for label in V.MODEL_EXPOSURE_LABELS[1:]]
    return _estimates(spark, inference.fit_terms(patterns, names, {}, {"hba1c_group": V.MODEL_EXPOSURE_LABELS[0]}))


def q_logit_strata_crude(spark: SparkSession, folder: str) -> DataFrame:
    """Testing per diagnosis without covariates, with rows and crude rates."""
    patterns = Scratch(spark).table(_exposure_patterns(spark, folder, "primary_diagnosis_group"), "strata")
    tested = F.col("hba1c_group") != V.MODEL_EXPOSURE_LABELS[0]
    fits = inference.stratified_logit(patterns, "primary_diagnosis_group", V.MODEL_STRATA, "tested", tested, {}, {})
    crude = small_table(
        spark, [(name, n, *rates) for name, n, *rates, _ in fits], "term string, n_rows bigint, rate_0 double, rate_1 double"
    )
    terms = [inference.Term(name, fit[0].estimate, fit[0].se, fit[0].told) for name, *_, fit in fits]
    crude = crude.withColumns({c: F.round(c, 9) for c in ("rate_0", "rate_1")})
    return crude.join(_estimates(spark, terms), "term")


def q_covariate_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return _patterns(spark, folder)


def q_logit_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.hba1c_adjusted(_patterns(spark, folder))


def q_logit_tested(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.hba1c_tested_adjusted(_patterns(spark, folder))


def q_logit_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return hospital.hba1c_by_diagnosis_adjusted(_patterns(spark, folder))


# ---------------------------------------------------------------- report


def _result_tables(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The result tables without the models', and the cohort."""
    raw = _loaded(spark, folder, V.RAW_COLUMNS)
    scratch = Scratch(spark)
    members = scratch.table(hospital.cohort_from_raw(raw), "cohort")
    return {
        "kpi_overall": hospital.overall(members),
        "readmission_profile": scratch.table(hospital.profile(members), "profile"),
        "cohort_funnel": scratch.table(hospital.funnel(hospital.stage(raw)), "funnel"),
        "dq_results": scratch.table(hospital.data_quality(raw), "dq"),
        "risk_band_validation": hospital.score_bands(members),
        "hba1c_summary": hospital.hba1c_summary(members),
    }, members


def q_report_payload(spark: SparkSession, folder: str) -> DataFrame:
    """All parts of the payload, read back and flattened to one row per record and number: its part's place among the others, too."""
    tables, members = _result_tables(spark, folder)
    payload = job.payload_of(spark, tables | job.model_tables(members, Scratch(spark)))
    schema = (
        "kpi struct<patients: bigint, readmitted_30d: bigint, readmission_rate_pct: double>, "
        "profile array<struct<dimension: string, category: string, patients: bigint, readmission_rate_pct: double>>, "
        "models array<struct<method: string, auc: double, readmissions_caught_top20_pct: double>>, "
        "deciles array<struct<decile: int, patients: bigint, readmission_rate_pct: double>>, "
        "hba array<struct<primary_diagnosis: string, patients: bigint, adjusted_odds_ratio: double, p_value: double>>, "
        "hbaAll struct<odds_ratio: double, ci95_low: double, ci95_high: double, p_value: double>, "
        "funnel array<struct<description: string, encounters: bigint>>, "
        "dq array<struct<check_name: string, affected_rows: bigint>>"
    )
    record = payload.select(F.from_json("payload", schema).alias("r"), F.json_object_keys("payload").alias("parts")).select("r.*", "parts")

    def flat(part: str, name, count=None, rate=None):
        return F.struct(
            F.array_position("parts", F.lit(part)).cast("int").alias("part"),
            F.lit(part).alias("section"),
            name.alias("name"),
            (F.lit(None).cast("bigint") if count is None else count).alias("n_rows"),
            (F.lit(None).cast("double") if rate is None else rate).alias("value"),
        )

    kpi = F.array(flat("kpi", F.lit("all"), F.col("kpi.patients"), F.col("kpi.readmission_rate_pct")))
    rates = F.transform(
        "profile",
        lambda p: flat("profile", F.concat_ws(": ", p["dimension"], p["category"]), p["patients"], p["readmission_rate_pct"]),
    )

    def numbers(part: str, name: str, column: str, count: str | None = None):
        return F.transform(part, lambda r: flat(part, F.concat(r[name], F.lit(f": {column}")), r[count] if count else None, r[column]))

    models = [numbers("models", "method", c) for c in ("auc", "readmissions_caught_top20_pct")]
    deciles = F.transform("deciles", lambda d: flat("deciles", d["decile"].cast("string"), d["patients"], d["readmission_rate_pct"]))
    strata = [numbers("hba", "primary_diagnosis", c, "patients") for c in ("adjusted_odds_ratio", "p_value")]
    tested = F.array(*[flat("hbaAll", F.lit(c), None, F.col(f"hbaAll.{c}")) for c in ("odds_ratio", "ci95_low", "ci95_high", "p_value")])
    steps = F.transform("funnel", lambda f: flat("funnel", f["description"], f["encounters"]))
    checks = F.transform("dq", lambda d: flat("dq", d["check_name"], d["affected_rows"]))
    return record.select(F.inline(F.concat(kpi, rates, *models, deciles, *strata, tested, steps, checks)))


def q_export_preview(spark: SparkSession, folder: str) -> DataFrame:
    """Small result tables exported in the study's order and read back as they stand in their files."""
    tables, _ = _result_tables(spark, folder)
    out = Scratch(spark).folder("export")
    names = [name for name in job.PREVIEWED if name in tables]
    export_csv({name: tables[name] for name in names}, out, order=job.sort_orders())
    return job.preview_lines(spark, out, names, hidden=("handling", "share_pct"))


def q_export_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """The cohort exported row by row and read again with the few columns that the models' comparison needs."""
    out = Scratch(spark).folder("export")
    export_csv({"cohort": _cohort(spark, folder)}, out, row_level=["cohort"])
    return spark.read.parquet(f"{out}/cohort").select("encounter_id", "age_mid", "los_days", "prior_inpatient", hospital.OUTCOME)


def q_export_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of adjusted odds ratios exported and read again, typed."""
    tables = hospital.adjusted_tables(_patterns(spark, folder))
    del tables["hba1c_tested_adjusted"]
    out = Scratch(spark).folder("export")
    export_csv(tables, out, order=job.sort_orders())
    found = []
    for name, df in tables.items():
        read = read_lookup(spark, f"{out}/{name}", ", ".join(f"{c} {kind}" for c, kind in df.dtypes))
        numbers = [F.col(c).alias(c.removeprefix("adjusted_")) for c in df.columns if c in ("odds_ratio", "adjusted_odds_ratio", "p_value")]
        found.append(read.select(F.lit(name).alias("table_name"), F.col(df.columns[0]).alias("name"), *numbers))
    return found[0].unionByName(found[1])


QUERIES: dict[str, Query] = {name: fn for name, fn in list(globals().items()) if name.startswith("q_")}
