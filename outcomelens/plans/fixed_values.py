"""Fixed values of the hospital study: codes, labels, point steps and texts that results must equal."""

from __future__ import annotations

from ..functions import CodeRule

# Rows of the published raw table, reported against the rows loaded.
EXPECTED_ENCOUNTERS = 101766

# Columns of the raw table that the study reads.
RAW_COLUMNS = [
    "encounter_id", "patient_nbr", "race", "gender", "age", "weight", "admission_type_id", "discharge_disposition_id",
    "admission_source_id", "time_in_hospital", "payer_code", "medical_specialty", "num_lab_procedures", "num_procedures",
    "num_medications", "number_outpatient", "number_emergency", "number_inpatient", "diag_1", "number_diagnoses", "A1Cresult",
    "insulin", "change", "diabetesMed", "readmitted",
]

# Order of the lookups in the stacked file.
STACKED_LOOKUPS = ["admission_type", "discharge_disposition", "admission_source"]

# Code groups.
ADMISSION_TYPE_GROUPS = {"Emergency / trauma": [1, 7], "Urgent": [2], "Elective": [3]}
ADMISSION_TYPE_DEFAULT = "Unknown"
ADMISSION_SOURCE_GROUPS = {
    "Emergency room": [7],
    "Referral": [1, 2, 3],
    "Transfer": [4, 5, 6, 10, 18, 22, 25, 26],
}
ADMISSION_SOURCE_DEFAULT = "Other / unknown"
DISCHARGE_GROUPS = {
    "Home": [1],
    "Home with health service": [6, 8],
    "Care facility (SNF / rehab / other)": [3, 4, 5, 15, 22, 23, 24, 27, 28, 29, 30],
    "Other hospital": [2],
    "Left against medical advice": [7],
    "Died / hospice": [11, 13, 14, 19, 20, 21],
}
DISCHARGE_DEFAULT = "Other / unknown"
NOT_READMITTABLE = "Died / hospice"

# Codes the quality checks call unknown; these lists differ from the groups above.
UNKNOWN_ADMISSION_TYPES = [5, 6, 8]
UNKNOWN_ADMISSION_SOURCES = [9, 15, 17, 20, 21]
UNKNOWN_DISCHARGES = [18, 25, 26]

# ICD-9 chapters; the first rule that matches wins.
DIAGNOSIS_RULES = [
    CodeRule("Missing", equals=["?"]),
    CodeRule("Other", prefixes=["V", "E"]),
    CodeRule("Diabetes", prefixes=["250"]),
    CodeRule("Circulatory", ranges=[(390, 459), (785, 785.99)]),
    CodeRule("Respiratory", ranges=[(460, 519), (786, 786.99)]),
    CodeRule("Digestive", ranges=[(520, 579), (787, 787.99)]),
    CodeRule("Injury", ranges=[(800, 999.99)]),
    CodeRule("Musculoskeletal", ranges=[(710, 739.99)]),
    CodeRule("Genitourinary", ranges=[(580, 629.99), (788, 788.99)]),
    CodeRule("Neoplasms", ranges=[(140, 239.99)]),
]
DIAGNOSIS_DEFAULT = "Other"

# Points: value up to and including a bound, and beyond the last.
LENGTH_OF_STAY_POINTS = ([(0, 0), (1, 1), (2, 2), (3, 3), (6, 4), (13, 5)], 7)
DIAGNOSES_POINTS = ([(3, 0), (5, 1), (7, 2), (8, 3)], 5)
ACUTE_POINTS = 3
MAX_EMERGENCY_POINTS = 4
SCORE_BANDS = [(10, "High (10+)"), (5, "Moderate (5-9)")]
LOWEST_BAND = "Low (0-4)"

# Profile dimensions and categories.
AGE, DIAGNOSIS, SOURCE, DISCHARGE = "Age group", "Primary diagnosis", "Admission source", "Discharged to"
INPATIENT, EMERGENCY = "Inpatient stays in prior year", "Emergency visits in prior year"
STAY, HBA1C = "Length of stay", "HbA1c test"
STAY_RANGES = ([(2, "1-2 days"), (4, "3-4 days"), (7, "5-7 days")], "8-14 days")
ORDINAL_DIMENSIONS = [AGE, INPATIENT, EMERGENCY, STAY]
MIN_GROUP = 100

# Exposure groups: in the tables, and in the models.
EXPOSURE_LABELS = (
    "1. Not tested",
    "2. Tested - normal",
    "3. Tested - high, no medication change",
    "4. Tested - high, medication changed",
)
MODEL_EXPOSURE_LABELS = (
    "Not tested",
    "Tested - normal",
    "Tested - high, no change",
    "Tested - high, med changed",
)
EXPOSURE_STRATA = ["Diabetes", "Circulatory", "Respiratory", "Digestive", "Injury", "Other"]
MODEL_STRATA = ["Diabetes", "Circulatory", "Respiratory"]

# Funnel steps.
FUNNEL_STEPS = (
    "All hospital encounters",
    "First encounter per patient",
    "Excluding died / hospice and invalid gender",
)

# Quality checks: id, name, handling.
CHECKS = {
    1: ("Duplicate encounter_id", "None found - encounter_id is a valid primary key"),
    2: ("Race recorded as '?'", "Set to NULL, reported as Unknown"),
    3: ("Weight recorded as '?'", "Column dropped - 97% missing, not usable"),
    4: (
        "Payer code recorded as '?'",
        "Column dropped - 40% missing and not needed for the question",
    ),
    5: ("Medical specialty recorded as '?'", "Kept as 'Unknown' category (49% missing)"),
    6: ("Primary diagnosis (diag_1) recorded as '?'", "Grouped as 'Missing'"),
    7: ("Gender 'Unknown/Invalid'", "Excluded from the analysis cohort"),
    8: (
        "Repeat encounters of the same patient",
        "Keep first encounter per patient so observations are independent",
    ),
    9: (
        "Discharged as died or to hospice (cannot be readmitted)",
        "Excluded from the analysis cohort",
    ),
    10: ("Admission type unknown (NULL / Not Available / Not Mapped)", "Grouped as 'Unknown'"),
    11: (
        "Admission source unknown (NULL / Not Available / Not Mapped / Invalid)",
        "Grouped as 'Unknown'",
    ),
    12: ("Discharge disposition unknown (NULL / Not Mapped / Invalid)", "Grouped as 'Unknown'"),
    13: ("Codes with no match in lookup tables (orphan keys)", "Checked with LEFT JOINs"),
    14: (
        "Lookup: same description used for two admission_source codes",
        "Harmless (both mean Not Available) - mapped to the same group",
    ),
    15: (
        "HbA1c test not performed (not an error - a care-quality signal)",
        "Kept - analysed as the exposure",
    ),
}
MISSING_SHARE_CHECKS = [2, 3, 4, 5, 10, 11, 12]
MISSING_LABEL = (" recorded as '?'", " missing")
LABEL_NOTE = r" \(.*\)"

# Risk model.
NUMERIC_FEATURES = [
    "age_mid", "los_days", "num_lab_procedures", "num_procedures", "num_medications",
    "number_diagnoses", "prior_outpatient", "prior_emergency", "prior_inpatient",
]
CATEGORICAL_FEATURES = [
    "gender", "race", "admission_type_group", "admission_source_group", "discharge_group",
    "primary_diagnosis_group", "specialty_grp", "hba1c_group", "insulin",
    "medication_changed", "on_diabetes_medication",
]
SEED = 42
TEST_SHARE = 0.25
FOLLOW_UP_SHARE = 0.20
TOP_SPECIALTIES = 10
METHODS = {
    "Logistic regression (all features)": "model_risk",
    "LACE-style score (SQL)": "lace_score",
    "Prior inpatient stays only": "prior_inpatient",
}
ADJUST_NUMERIC = ["age_mid", "los_days", "prior_inpatient", "prior_emergency", "number_diagnoses"]

# Parts of the report payload, in order.
PAYLOAD_PARTS = ["kpi", "profile", "models", "deciles", "hba", "hbaAll", "funnel", "dq"]
