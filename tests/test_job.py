"""The whole job on CSV files made from the test tables."""

from __future__ import annotations

import csv
import json
from pathlib import Path

import pytest

from outcomelens import job
from outcomelens.plans import fixed_values as V
from outcomelens.plans import testbed
from outcomelens.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("job")
    raw = testbed.raw_tables(spark, FOLDER)
    # columns that the study does not read are not copied
    raw.encounters.withColumn("unused", raw.encounters[0]).write.csv(f"{d}/encounters", header=True, escape='"')
    blocks = []
    for name in V.STACKED_LOOKUPS:
        rows = raw.lookups()[name].table.collect()
        blocks.append("\n".join([f"{name}_id,description", *[f"{r[0]},{r[1]}" for r in rows]]))
    (d / "mapping.csv").write_text("\r\n,\r\n".join(blocks) + "\r\n")
    job.run(spark, job.load(spark, f"{d}/encounters", f"{d}/mapping.csv"), f"{d}/out")
    return f"{d}/out"


def _csv(spark, out, name):
    df = spark.read.csv(f"{out}/{name}", header=True, escape='"', inferSchema=True)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _query(spark, name, drop=()):
    return sorted((tuple(r) for r in QUERIES[name](spark, FOLDER).drop(*drop).collect()), key=repr)


@pytest.mark.parametrize(
    "table, query",
    [
        ("cohort_funnel", "q_cohort_funnel"),
        ("kpi_overall", "q_kpi"),
        ("risk_band_validation", "q_band_validation"),
        ("hba1c_summary", "q_exposure_summary"),
        ("hba1c_by_diagnosis", "q_exposure_by_group"),
        ("readmission_profile", "q_rate_profile"),
        ("missing_share", "q_missing_share"),
        ("driver_flags", "q_driver_flags"),
        ("hba1c_adjusted", "q_logit_adjusted"),
        ("hba1c_tested_adjusted", "q_logit_tested"),
        ("hba1c_by_diagnosis_adjusted", "q_logit_stratified"),
        ("quality_table", "q_dq_display"),
        ("model_comparison", "q_model_comparison"),
        ("orphan_keys", "q_orphan_keys"),
    ],
)
def test_same_as_the_query(spark, out, table, query):
    assert [tuple(map(str, r)) for r in _csv(spark, out, table)] == [
        tuple(map(str, r)) for r in _query(spark, query)
    ]


def test_row_level_tables(spark, out):
    assert spark.read.parquet(f"{out}/cohort").count() == spark.read.parquet(f"{out}/risk_scores").count() > 0


def test_model_tables(spark, out):
    assert [r[0] for r in spark.read.csv(f"{out}/model_comparison", header=True).collect()] == list(V.METHODS)
    deciles = _csv(spark, out, "risk_deciles")
    assert len(deciles) == 10 and sum(r[1] for r in deciles) == deciles[0][3]
    assert len(_csv(spark, out, "hba1c_by_diagnosis_adjusted")) == len(V.MODEL_STRATA)


def test_payload(spark, out):
    payload = json.loads(spark.read.text(f"{out}/payload").first()[0])
    assert set(payload) == {"kpi", "hbaAll", "profile", "models", "deciles", "hba", "funnel", "dq"}
    assert [row["check_id"] for row in payload["dq"]] == list(range(1, 16))
    assert [row["method"] for row in payload["models"]] == list(V.METHODS)
    assert [row["primary_diagnosis"] for row in payload["hba"]] == V.MODEL_STRATA
    assert payload["kpi"]["patients"] == payload["funnel"][2]["encounters"]


def test_preview(spark, out, capsys):
    job.preview(spark, out)
    shown = capsys.readouterr().out
    assert "Moderate (5-9)" in shown and V.CHECKS[1][0] in shown and V.CHECKS[1][1] not in shown


@pytest.mark.parametrize(("table", "column"), [("cohort_funnel", "step"), ("readmission_profile", "dimension"), ("risk_deciles", "decile")])
def test_small_tables_are_one_sorted_file(out, table, column):
    (path,) = Path(f"{out}/{table}").glob("*.csv")
    rows = list(csv.DictReader(path.open()))
    values = [int(r[column]) if r[column].isdigit() else r[column] for r in rows]
    assert len(values) > 2 and values == sorted(values)


def test_sessions_without_strict_casts_are_refused(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            job.run(spark, testbed.raw_tables(spark, FOLDER), "/nowhere")
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
