"""The pipeline on a small hand-made raw table with the awkward rows."""

from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F

from outcomelens.functions import parse_number
from outcomelens.plans import fixed_values as V
from outcomelens.plans import hospital
from outcomelens.sources import export_csv, read_lookup, read_text_table

BASE = {
    "encounter_id": "1", "patient_nbr": "1", "race": "Caucasian", "gender": "Female", "age": "[70-80)",
    "weight": "?", "admission_type_id": "1", "discharge_disposition_id": "1", "admission_source_id": "7",
    "time_in_hospital": "3", "payer_code": "?", "medical_specialty": "?", "num_lab_procedures": "40",
    "num_procedures": "1", "num_medications": "12", "number_outpatient": "0", "number_emergency": "0",
    "number_inpatient": "0", "diag_1": "428", "number_diagnoses": "9", "A1Cresult": "None", "insulin": "No",
    "change": "No", "diabetesMed": "Yes", "readmitted": "NO",
}

ROWS = [
    dict(encounter_id="10", patient_nbr="1", discharge_disposition_id="13"),  # hospice first: patient is gone
    dict(encounter_id="11", patient_nbr="1"),
    dict(encounter_id="21", patient_nbr="2", readmitted="<30"),  # only the second stay is readmitted
    dict(encounter_id="20", patient_nbr="2", time_in_hospital="1", number_diagnoses="3", number_emergency="6"),
    dict(encounter_id="30", patient_nbr="3", gender="Unknown/Invalid"),
    dict(encounter_id="40", patient_nbr="4", race="?", diag_1="250.83", A1Cresult="Norm", readmitted="<30"),
    dict(encounter_id="50", patient_nbr="5", diag_1="V57", A1Cresult=">8", change="Ch", age="[0-10)"),
    dict(encounter_id="60", patient_nbr="6", diag_1="?", A1Cresult=">8", admission_type_id="4"),
    dict(encounter_id="70", patient_nbr="7", diag_1="459.81", admission_type_id="5", admission_source_id="99"),
    dict(
        encounter_id="80", patient_nbr="8", admission_type_id="7", admission_source_id="17",
        discharge_disposition_id="18", time_in_hospital="14", number_diagnoses="8", medical_specialty="Cardiology",
        readmitted=">30", number_inpatient="5",
    ),
]


def _csv(path, header, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    columns = list(BASE)
    path = _csv(d / "encounters.csv", columns, [[{**BASE, **row}[c] for c in columns] for row in ROWS])

    def lookup(name, rows):
        file = _csv(d / f"{name}.csv", [f"{name}_id", "description"], rows)
        return read_lookup(spark, file, f"{name}_id int, description string")

    return hospital.RawTables(
        read_text_table(spark, path, columns),
        lookup("admission_type", [(i, f"type {i}") for i in range(1, 9)]),
        lookup("admission_source", [(7, "ER"), (9, "Not Available"), (15, "Not Available"), (17, 'say "no", please')]),
        lookup("discharge_disposition", [(1, "home"), (13, "hospice"), (18, None)]),
    )


@pytest.fixture(scope="module")
def staged(raw):
    return hospital.stage(raw)


@pytest.fixture(scope="module")
def members(staged):
    return hospital.cohort(staged)


def test_staging(staged):
    rows = {r.encounter_id: r for r in staged.collect()}
    assert len(rows) == len(ROWS) and len(staged.columns) == 33
    assert rows[40].race is None and rows[30].gender is None
    assert (rows[50].age_mid, rows[20].age_mid) == (5, 75)
    assert rows[20].medical_specialty == "Unknown" and rows[80].medical_specialty == "Cardiology"
    assert [rows[i].admission_type_group for i in (20, 60, 70, 80)] == [
        "Emergency / trauma", "Unknown", "Unknown", "Emergency / trauma",
    ]
    assert rows[70].admission_source is None and rows[70].admission_source_group == "Other / unknown"
    assert rows[80].admission_source == 'say "no", please'
    assert rows[80].discharge_disposition is None and rows[80].discharge_group == "Other / unknown"
    assert (rows[21].readmitted_30d, rows[80].readmitted_30d) == (True, False)
    assert (rows[20].hba1c_tested, rows[40].hba1c_tested) == (False, True)


def test_bad_number_fails(raw):
    bad = raw.encounters.withColumn("time_in_hospital", F.lit("x"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        hospital.stage(hospital.RawTables(bad, *list(vars(raw).values())[1:])).select("los_days").collect()


def test_cohort_takes_first_stay_then_excludes(members):
    assert sorted(r.encounter_id for r in members.collect()) == [20, 40, 50, 60, 70, 80]


def test_cohort_straight_from_raw_rows(raw, members):
    direct = hospital.cohort_from_raw(raw)
    assert direct.schema == members.schema
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, members.collect()))


def test_funnel(staged):
    rows = hospital.funnel(staged).orderBy("step").collect()
    assert [(r.step, r.description, r.encounters) for r in rows] == list(zip((1, 2, 3), V.FUNNEL_STEPS, (10, 8, 6)))
    assert [r.share_pct for r in rows] == [100.0, 80.0, 60.0]


def test_quality(raw):
    counts = {r.check_id: r.affected_rows for r in hospital.data_quality(raw).collect()}
    assert counts == {
        1: 0, 2: 1, 3: 10, 4: 10, 5: 9, 6: 1, 7: 1, 8: 2, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1, 15: 7,
    }
    names = {r.check_id: (r.check_name, r.handling) for r in hospital.data_quality(raw).collect()}
    assert names == V.CHECKS


def test_kpi(members):
    assert tuple(hospital.overall(members).first()) == (6, 1, 16.67, 4.5, 50.0)


def test_profile_hides_small_groups(members):
    assert hospital.profile(members, 7).count() == 0
    rows = {(r.dimension, r.category): tuple(r)[2:] for r in hospital.profile(members, 1).collect()}
    assert rows["HbA1c test", "Tested"] == (3, 1, 33.33)
    assert rows["Inpatient stays in prior year", "3+"] == (1, 0, 0.0)
    assert rows["Emergency visits in prior year", "2+"] == (1, 0, 0.0)
    assert rows["Length of stay", "8-14 days"] == (1, 0, 0.0)
    assert len({d for d, _ in rows}) == 8
    for dimension in hospital.dimensions():
        assert sum(v[0] for (d, _), v in rows.items() if d == dimension) == 6


def test_group_of_99_hidden_and_of_100_shown(spark, staged):
    one = staged.where("encounter_id = 20")
    many = one.crossJoin(spark.range(199).select((F.col("id") < 99).alias("few"))).withColumn(
        "age_band", F.when(F.col("few"), "[0-10)").otherwise("[10-20)")
    )
    ages = [r.category for r in hospital.profile(many).collect() if r.dimension == V.AGE]
    assert ages == ["[10-20)"]


def test_points(members):
    rows = {r.encounter_id: tuple(r)[3:] for r in hospital.risk_scores(members).collect()}
    assert rows[20] == (1, 3, 0, 4, 8, "Moderate (5-9)")
    assert rows[80] == (7, 3, 3, 0, 13, "High (10+)")
    assert rows[60] == (3, 3, 5, 0, 11, "High (10+)")
    assert rows[70] == (3, 0, 5, 0, 8, "Moderate (5-9)")


@pytest.mark.parametrize(
    "column, raw_value, point, wanted",
    [("los_days", v, "l_points", p) for v, p in [(0, 0), (1, 1), (3, 3), (6, 4), (7, 5), (13, 5), (14, 7), (None, 7)]]
    + [("number_diagnoses", v, "c_points", p) for v, p in [(3, 0), (5, 1), (7, 2), (8, 3), (9, 5), (None, 5)]]
    + [("prior_emergency", v, "e_points", p) for v, p in [(0, 0), (4, 4), (6, 4), (None, 4)]],
)
def test_point_steps(members, column, raw_value, point, wanted):
    row = members.where("encounter_id = 20").withColumn(column, F.lit(raw_value).cast("int"))
    assert hospital.with_score(row).first()[point] == wanted


def test_bands(members):
    assert [tuple(r) for r in hospital.score_bands(members).collect()] == [
        ("Moderate (5-9)", 2, 33.3, 0, 0.0),
        ("High (10+)", 4, 66.7, 1, 25.0),
    ]


def test_exposure(members):
    groups = {r.encounter_id: r.hba1c_group[0] for r in hospital.hba1c_groups(members).collect()}
    assert groups == {20: "1", 40: "2", 50: "4", 60: "3", 70: "1", 80: "1"}
    assert [tuple(r)[1:] for r in hospital.hba1c_summary(members).collect()] == [
        (3, 0.0), (1, 100.0), (1, 0.0), (1, 0.0),
    ]
    by = [tuple(r) for r in hospital.hba1c_by_diagnosis(members).collect()]
    assert by == [("Circulatory", 0.0, None, 0, 2), ("Other", 0.0, 0.0, 1, 2), ("Diabetes", None, 100.0, 1, 1)]


CHAPTERS = {
    "459": "Circulatory", "459.81": "Other", "785.5": "Circulatory", "250.83": "Diabetes", "250": "Diabetes",
    "V57": "Other", "E909": "Other", "?": "Missing", "785d": "Other", "785F ": "Other", None: "Other", "": "Other",
    "v57": "Other", "519": "Respiratory", "519.5": "Other", "786.2": "Respiratory", "579": "Digestive",
    "787.99": "Digestive", "788": "Genitourinary", "629.99": "Genitourinary", "239.9": "Neoplasms",
    "240": "Other", "739.99": "Musculoskeletal", "999.99": "Injury", "1000": "Other", " 410 ": "Circulatory",
    "4.1e2": "Circulatory", "inf": "Other", "nan": "Other", "789": "Other",
}


def test_chapters(spark):
    df = spark.createDataFrame([(c,) for c in CHAPTERS], "code string")
    got = {r.code: r.chapter for r in hospital.diagnosis_group(df, "code", "chapter").collect()}
    assert got == CHAPTERS


def test_number_with_suffix_is_no_number(spark):
    df = spark.createDataFrame([("785d",), ("785f",), ("785",), ("x",)], "code string")
    assert [r[0] for r in df.select(parse_number(F.col("code"))).collect()] == [None, None, 785.0, None]


def test_export(spark, members, tmp_path):
    export_csv({"kpi": hospital.overall(members), "cohort": members}, str(tmp_path), row_level=["cohort"])
    assert spark.read.parquet(str(tmp_path / "cohort")).count() == 6
    back = spark.read.csv(str(tmp_path / "kpi"), header=True).first()
    assert (back.patients, back.readmission_rate_pct) == ("6", "16.67")
