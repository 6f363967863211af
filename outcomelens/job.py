"""The whole study as one Spark job: raw CSV files in, result tables out.

    python -m outcomelens.job --encounters raw/encounters.csv --stacked raw/mapping.csv --out results
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.evaluate import roc_points
from .operators.lookups import orphan_keys
from .operators.profile import category_rates, flag_drivers, top_category
from .operators.quality import missing_share, quality_table
from .plans import fixed_values as V
from .plans import hospital
from .sources import (
    Scratch,
    export_csv,
    in_order,
    load_tables,
    read_lookup,
    read_stacked,
    read_text_table,
    report_payload,
)

ROW_LEVEL = ["cohort", "risk_scores"]
#: The curve of a score that turns at nearly every row is cut down to twice as many points.
CURVE_STEPS = 1000


def sort_orders() -> dict[str, list]:
    """How the rows of small result tables are sorted in their files: as the study publishes them."""
    bands = [V.LOWEST_BAND, *[label for _, label in reversed(V.SCORE_BANDS)]]
    return {
        "dq_results": ["check_id"],
        "quality_table": [in_order("check_name", [name for name, _ in V.CHECKS.values()])],
        "missing_share": ["share_pct", "check_id"],
        "cohort_funnel": ["step"],
        "readmission_profile": ["dimension", "category"],
        "risk_band_validation": [in_order("risk_band", bands)],
        "hba1c_summary": ["hba1c_group"],
        "hba1c_by_diagnosis": [F.desc("patients"), "primary_diagnosis_group"],
        "model_comparison": [in_order("method", list(V.METHODS))],
        "model_odds_ratios": [F.desc("odds_ratio"), "feature"],
        "risk_deciles": ["decile"],
        "hba1c_adjusted": ["group_vs_not_tested"],
        "hba1c_by_diagnosis_adjusted": [in_order("primary_diagnosis", V.MODEL_STRATA)],
    }


def load(spark: SparkSession, encounters: str, lookups: Mapping[str, str] | str) -> hospital.RawTables:
    """``lookups`` is one CSV path per lookup name, or the path of the file that stacks all three."""
    if isinstance(lookups, str):
        stacked = read_stacked(spark, lookups, V.STACKED_LOOKUPS, "id int, description string", Scratch(spark))
        tables = {
            name: stacked.where(F.col("section") == name).select(F.col("id").alias(f"{name}_id"), "description")
            for name in V.STACKED_LOOKUPS
        }
    else:
        tables = {
            name: read_lookup(spark, path, f"{name}_id int, description string") for name, path in lookups.items()
        }
    return hospital.RawTables(read_text_table(spark, encounters), **tables)


def loaded(raw: hospital.RawTables, scratch: Scratch) -> tuple[hospital.RawTables, DataFrame]:
    """The raw tables written, with the columns that are used, and how many rows that were, counted on the way."""
    used = [c for c in V.RAW_COLUMNS if c in raw.encounters.columns]
    tables = {"encounters": raw.encounters.select(*used), **{name: lookup.table for name, lookup in raw.lookups().items()}}
    written, counts = load_tables(tables, scratch, {"encounters": V.EXPECTED_ENCOUNTERS})
    return replace(raw, **written), counts


def sql_tables(raw: hospital.RawTables, scratch: Scratch) -> dict[str, DataFrame]:
    """Everything up to the exposure comparison. The cohort is written once and read by the rest."""
    staged = hospital.stage(raw)
    members = scratch.table(hospital.cohort_from_raw(raw), "cohort")
    return {
        "dq_results": scratch.table(hospital.data_quality(raw), "dq"),
        "orphan_keys": orphan_keys(raw.encounters, list(raw.lookups().values())),
        "cohort": members,
        "cohort_funnel": scratch.table(hospital.funnel(staged), "funnel"),
        "kpi_overall": scratch.table(hospital.overall(members), "kpi"),
        "readmission_profile": scratch.table(hospital.profile(members), "profile"),
        "risk_scores": hospital.risk_scores(members),
        "risk_band_validation": hospital.score_bands(members),
        "hba1c_summary": hospital.hba1c_summary(members),
        "hba1c_by_diagnosis": hospital.hba1c_by_diagnosis(members),
    }


def model_tables(members: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """Risk model with its evaluation, and the adjusted odds ratios."""
    rows = hospital.analysis_rows(members, scratch)
    model = hospital.fit_model(rows)
    test = hospital.scored_test_rows(rows, model, scratch)
    patterns = hospital.inference_patterns(members, scratch)
    return {
        "model_comparison": scratch.table(hospital.model_comparison(test, scratch), "comparison"),
        "model_odds_ratios": model.odds_table(rows),
        "risk_deciles": scratch.table(hospital.risk_deciles(test), "deciles"),
        "roc_points": roc_points(test, "model_risk", "y", scratch, CURVE_STEPS),
    } | hospital.adjusted_tables(patterns)


def report_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What the report shows, from the small result tables."""
    profile, kpi = tables["readmission_profile"], tables["kpi_overall"]
    baseline = kpi.select("readmission_rate_pct").scalar()
    total = tables["cohort_funnel"].where("step = 1").select("encounters").scalar()
    wanted = {
        "rate_3_or_more_stays": (V.INPATIENT, "3+"),
        "rate_no_stay": (V.INPATIENT, "0"),
    }
    diabetes = tables["hba1c_by_diagnosis"].where(F.col("primary_diagnosis_group") == "Diabetes")
    return {
        "quality_table": quality_table(tables["dq_results"]),
        "missing_share": missing_share(
            tables["dq_results"], total, V.MISSING_SHARE_CHECKS, V.MISSING_LABEL, V.LABEL_NOTE
        ),
        "driver_flags": flag_drivers(profile, baseline, V.ORDINAL_DIMENSIONS),
        "top_category": top_category(profile, baseline),
        "headlines": category_rates(profile, wanted).withColumns(
            {
                "diabetes_rate_tested": diabetes.select("tested_pct").scalar(),
                "diabetes_rate_not_tested": diabetes.select("not_tested_pct").scalar(),
            }
        ),
        "payload": payload_of(spark, tables),
    }


def payload_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The eight parts of the report as one record, in the study's order."""
    single = {"kpi": tables["kpi_overall"], "hbaAll": tables["hba1c_tested_adjusted"]}
    listed = {
        "profile": (tables["readmission_profile"], ["dimension", "category"]),
        "models": (tables["model_comparison"], [in_order("method", list(V.METHODS))]),
        "deciles": (tables["risk_deciles"].select("decile", "patients", "readmission_rate_pct"), ["decile"]),
        "hba": (tables["hba1c_by_diagnosis_adjusted"], [in_order("primary_diagnosis", V.MODEL_STRATA)]),
        "funnel": (tables["cohort_funnel"].drop("share_pct"), ["step"]),
        "dq": (tables["dq_results"], ["check_id"]),
    }
    return report_payload(spark, single, listed, V.PAYLOAD_PARTS)


def run(spark: SparkSession, raw: hospital.RawTables, out: str) -> None:
    """The encounters' text is parsed once; everything else reads a written copy of the columns it needs."""
    if spark.conf.get("spark.sql.ansi.enabled").lower() != "true":
        raise ValueError("strict casts need spark.sql.ansi.enabled: without it bad text would silently become NULL")
    with Scratch(spark) as scratch:
        raw, counts = loaded(raw, scratch)
        tables = {"load_counts": counts} | sql_tables(raw, scratch)
        tables |= model_tables(tables["cohort"], scratch)
        tables |= report_tables(spark, tables)
        payload = tables.pop("payload")
        export_csv(tables, out, ROW_LEVEL, sort_orders())
        payload.write.mode("overwrite").text(f"{out}/payload")


PREVIEWED = ["dq_results", "cohort_funnel", "kpi_overall", "risk_band_validation", "hba1c_summary", "model_comparison"]


def preview_lines(spark: SparkSession, out: str, names: Sequence[str], hidden: Sequence[str] = ("handling",)) -> DataFrame:
    """The rows of small exported tables as they stand in their files: table_name, place, line."""
    lines = []
    for name in names:
        table = spark.read.csv(f"{out}/{name}", header=True, escape='"').drop(*hidden)
        # a table with an order is one sorted file, read by one task
        place = (F.monotonically_increasing_id() + 1).alias("place")
        lines.append(table.select(F.lit(name).alias("table_name"), place, F.concat_ws(" | ", *table.columns).alias("line")))
    return reduce(DataFrame.unionByName, lines)


def preview(spark: SparkSession, out: str) -> None:
    """Print the small tables a reader wants to see first."""
    for name in PREVIEWED:
        print(name)
        table = spark.read.csv(f"{out}/{name}", header=True, escape='"')
        (table.drop("handling") if name == "dq_results" else table).show(truncate=False)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--encounters", required=True)
    parser.add_argument("--stacked", help="one file with all three lookups")
    for name in V.STACKED_LOOKUPS:
        parser.add_argument(f"--{name}")
    parser.add_argument("--out", required=True)
    args = parser.parse_args()
    lookups = args.stacked or {name: getattr(args, name) for name in V.STACKED_LOOKUPS}
    spark = SparkSession.builder.appName("outcome study").getOrCreate()
    run(spark, load(spark, args.encounters, lookups), args.out)
    preview(spark, args.out)


if __name__ == "__main__":
    main()
