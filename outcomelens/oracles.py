"""The registered queries as DuckDB SQL, written apart from the Spark code.

Codes and ranges are joined from small value lists instead of nested conditions; fixed numbers and texts are
the same by necessity.
"""

from __future__ import annotations

from .plans import fixed_values as V
from .plans.testbed import RAW_COLUMNS

RAW = """
raw_orders AS (
  SELECT *, date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) AS dayno,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders
),
gaps AS (
  SELECT o_orderkey AS g_key,
         count(*) OVER (PARTITION BY o_custkey ORDER BY dayno RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS prior,
         lead(dayno) OVER (PARTITION BY o_custkey ORDER BY dayno, o_orderkey) - dayno AS gap
  FROM raw_orders
),
order_lines AS (
  SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(sum(l_linenumber) AS BIGINT) AS nos,
         count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) FILTER (l_returnflag = 'A') AS n_a,
         count(*) FILTER (l_linestatus = 'O') AS n_o, count(*) FILTER (l_tax > 0.04) AS n_t
  FROM lineitem GROUP BY l_orderkey
),
raw_people AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, n_name, r_name,
         CAST(greatest(0, least(9, floor((c_acctbal + 1000) / 1100))) AS BIGINT) AS decade
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
),
priced AS (
  SELECT *, (cents // 100) % 1000 AS q, cents % 100 AS c2 FROM raw_orders
),
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id, CAST(o_custkey AS VARCHAR) AS patient_nbr,
    if(c_mktsegment = 'FURNITURE', '?', c_mktsegment) AS race,
    CASE WHEN c_nationkey = 0 THEN 'Unknown/Invalid' WHEN c_nationkey % 2 = 1 THEN 'Female' ELSE 'Male' END AS gender,
    '[' || (decade * 10) || '-' || (decade * 10 + 10) || ')' AS age,
    if(c_acctbal < -700, '[75-100)', '?') AS weight,
    o_orderpriority[1] AS admission_type_id,
    CAST(day(o_orderdate) AS VARCHAR) AS discharge_disposition_id,
    CAST(c_nationkey + 1 AS VARCHAR) AS admission_source_id,
    CAST(least(coalesce(n, 0) + 1, 14) AS VARCHAR) AS time_in_hospital,
    if(r_name IN ('AFRICA', 'ASIA'), '?', n_name) AS payer_code,
    if(r_name IN ('AMERICA', 'EUROPE'), '?', n_name) AS medical_specialty,
    CAST(coalesce(qty, 0) AS VARCHAR) AS num_lab_procedures, CAST(coalesce(n_a, 0) AS VARCHAR) AS num_procedures,
    CAST(coalesce(nos, 0) AS VARCHAR) AS num_medications, CAST(coalesce(n_t, 0) AS VARCHAR) AS number_outpatient,
    CAST(coalesce(n_r, 0) AS VARCHAR) AS number_emergency, CAST(prior AS VARCHAR) AS number_inpatient,
    CASE WHEN q < 10 THEN '?' WHEN q < 30 THEN 'V' || q WHEN q < 50 THEN 'E' || (900 + q)
         WHEN q < 300 THEN '250.' || lpad(CAST(q % 100 AS VARCHAR), 2, '0')
         WHEN q < 550 THEN CAST(390 + q % 70 AS VARCHAR) WHEN q < 750 THEN CAST(460 + q % 60 AS VARCHAR)
         WHEN q < 760 THEN '459.' || lpad(CAST(q % 100 AS VARCHAR), 2, '0')
         WHEN q < 770 THEN '785.' || lpad(CAST(q % 100 AS VARCHAR), 2, '0')
         WHEN q < 780 THEN q || 'd' ELSE CAST(140 + (q - 780) * 4 AS VARCHAR) END AS diag_1,
    CAST(coalesce(n_o, 0) + 1 AS VARCHAR) AS number_diagnoses,
    CASE WHEN c2 < 80 THEN 'None' WHEN c2 < 87 THEN 'Norm' WHEN c2 < 93 THEN '>7' ELSE '>8' END AS A1Cresult,
    (['No', 'Steady', 'Up', 'Down'])[quarter(o_orderdate)] AS insulin,
    if(o_orderstatus = 'F', 'Ch', 'No') AS change, if(o_orderstatus <> 'P', 'Yes', 'No') AS diabetesMed,
    CASE WHEN gap IS NULL THEN 'NO' WHEN gap < 30 THEN '<30' ELSE '>30' END AS readmitted
  FROM priced JOIN gaps ON g_key = o_orderkey LEFT JOIN raw_people ON c_custkey = o_custkey
  LEFT JOIN order_lines ON l_orderkey = o_orderkey
),
look_type AS (SELECT r_regionkey + 1 AS t_id, r_name AS t_text FROM region),
look_source AS (SELECT n_nationkey + 1 AS s_id, r_name AS s_text FROM nation JOIN region ON n_regionkey = r_regionkey),
look_exit AS (SELECT n_nationkey + 1 AS d_id, n_name AS d_text FROM nation)
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strings(codes: list[int]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


def _code_table(groups: dict[str, list[int]]) -> str:
    return "VALUES " + ", ".join(f"({code}, {_quoted(name)})" for name, codes in groups.items() for code in codes)


CODED = f"""
type_groups(tg_code, tg) AS ({_code_table(V.ADMISSION_TYPE_GROUPS)}),
source_groups(sg_code, sg) AS ({_code_table(V.ADMISSION_SOURCE_GROUPS)}),
exit_groups(xg_code, xg) AS ({_code_table(V.DISCHARGE_GROUPS)})
"""

_RANGES = ", ".join(
    f"({low}, {high}, {_quoted(rule.label)})" for rule in V.DIAGNOSIS_RULES for low, high in rule.ranges
)
CHAPTERS = f"""
chapter_ranges(lo, hi, chapter_name) AS (SELECT lo::DOUBLE, hi::DOUBLE, name FROM (VALUES {_RANGES}) t(lo, hi, name))"""


def _chapter(code: str) -> str:
    """Chapter of a code whose row is left joined to chapter_ranges (the ranges do not overlap)."""
    cases = ""
    for rule in V.DIAGNOSIS_RULES:
        cases += "".join(f" WHEN {code} = {_quoted(text)} THEN {_quoted(rule.label)}" for text in rule.equals)
        cases += "".join(f" WHEN starts_with({code}, {_quoted(text)}) THEN {_quoted(rule.label)}" for text in rule.prefixes)
    return f"CASE{cases} ELSE coalesce(chapter_name, {_quoted(V.DIAGNOSIS_DEFAULT)}) END"


def _steps(col: str, steps: tuple) -> str:
    """Value up to and including a bound; beyond the last, and for NULL, the value that remains."""
    bounds, rest = steps
    shown = (lambda v: _quoted(v)) if isinstance(rest, str) else str
    return "CASE" + "".join(f" WHEN {col} <= {bound} THEN {shown(value)}" for bound, value in bounds) + f" ELSE {shown(rest)} END"


STAGED = (
    RAW
    + ","
    + CODED
    + ","
    + CHAPTERS
    + f""",
staged AS (
  SELECT CAST(encounter_id AS BIGINT) AS encounter_id, CAST(patient_nbr AS BIGINT) AS patient_nbr,
    nullif(race, '?') AS race, nullif(gender, 'Unknown/Invalid') AS gender, age AS age_band,
    5 + CAST(regexp_extract(age, '\\[(\\d+)-', 1) AS INT) AS age_mid,
    CAST(admission_type_id AS INT) AS admission_type_id, t_text AS admission_type,
    coalesce(tg, 'Unknown') AS admission_type_group,
    CAST(admission_source_id AS INT) AS admission_source_id, s_text AS admission_source,
    coalesce(sg, 'Other / unknown') AS admission_source_group,
    CAST(discharge_disposition_id AS INT) AS discharge_disposition_id, d_text AS discharge_disposition,
    coalesce(xg, 'Other / unknown') AS discharge_group,
    CAST(time_in_hospital AS INT) AS los_days, if(medical_specialty = '?', 'Unknown', medical_specialty)
      AS medical_specialty,
    CAST(num_lab_procedures AS INT) AS num_lab_procedures, CAST(num_procedures AS INT) AS num_procedures,
    CAST(num_medications AS INT) AS num_medications, CAST(number_diagnoses AS INT) AS number_diagnoses,
    CAST(number_outpatient AS INT) AS prior_outpatient, CAST(number_emergency AS INT) AS prior_emergency,
    CAST(number_inpatient AS INT) AS prior_inpatient, diag_1,
    {_chapter("diag_1")} AS primary_diagnosis_group,
    A1Cresult AS hba1c_result, A1Cresult <> 'None' AS hba1c_tested, change = 'Ch' AS medication_changed,
    diabetesMed = 'Yes' AS on_diabetes_medication, insulin, readmitted AS readmitted_raw,
    readmitted = '<30' AS readmitted_30d
  FROM raw
  LEFT JOIN look_type ON t_id = CAST(admission_type_id AS INT)
  LEFT JOIN look_source ON s_id = CAST(admission_source_id AS INT)
  LEFT JOIN look_exit ON d_id = CAST(discharge_disposition_id AS INT)
  LEFT JOIN type_groups ON tg_code = CAST(admission_type_id AS INT)
  LEFT JOIN source_groups ON sg_code = CAST(admission_source_id AS INT)
  LEFT JOIN exit_groups ON xg_code = CAST(discharge_disposition_id AS INT)
  LEFT JOIN chapter_ranges ON TRY_CAST(diag_1 AS DOUBLE) BETWEEN lo AND hi
)"""
)

COHORT = (
    STAGED
    + """,
cohort AS (
  SELECT s.* FROM staged s
  WHERE encounter_id = (SELECT min(f.encounter_id) FROM staged f WHERE f.patient_nbr = s.patient_nbr)
    AND discharge_group <> 'Died / hospice' AND gender IS NOT NULL
)"""
)

KPI = """SELECT count(*) AS patients, CAST(sum(readmitted_30d::INT) AS BIGINT) AS readmitted_30d,
  round(100.0 * avg(readmitted_30d::INT), 2) AS readmission_rate_pct, round(avg(los_days), 2) AS avg_los_days,
  round(100.0 * avg(hba1c_tested::INT), 1) AS hba1c_tested_pct FROM cohort"""

PROFILE = (
    COHORT
    + """,
facets AS (
  SELECT readmitted_30d::INT AS y, unnest([
    {'dimension': 'Age group', 'category': age_band},
    {'dimension': 'Primary diagnosis', 'category': primary_diagnosis_group},
    {'dimension': 'Admission source', 'category': admission_source_group},
    {'dimension': 'Discharged to', 'category': discharge_group},
    {'dimension': 'Inpatient stays in prior year',
     'category': if(prior_inpatient IN (0, 1, 2), prior_inpatient::VARCHAR, '3+')},
    {'dimension': 'Emergency visits in prior year',
     'category': if(prior_emergency IN (0, 1), prior_emergency::VARCHAR, '2+')},
    {'dimension': 'Length of stay', 'category': @STAY@},
    {'dimension': 'HbA1c test', 'category': if(hba1c_tested, 'Tested', 'Not tested')}
  ], recursive := true)
  FROM cohort
),
profile AS (
  SELECT dimension, category, count(*) AS patients, CAST(sum(y) AS BIGINT) AS readmitted,
         round(100.0 * avg(y), 2) AS readmission_rate_pct
  FROM facets GROUP BY ALL HAVING count(*) >= 100
)"""
).replace("@STAY@", _steps("los_days", V.STAY_RANGES))

SCORED = (
    COHORT
    + f""",
pointed AS (
  SELECT *,
    {_steps("los_days", V.LENGTH_OF_STAY_POINTS)} AS l_points,
    3 * (admission_type_group = 'Emergency / trauma' OR admission_source_group = 'Emergency room')::INT AS a_points,
    {_steps("number_diagnoses", V.DIAGNOSES_POINTS)} AS c_points,
    least(prior_emergency, {V.MAX_EMERGENCY_POINTS}) AS e_points
  FROM cohort
),
scored AS (
  SELECT *, l_points + a_points + c_points + e_points AS lace_score,
    CASE WHEN lace_score < 5 THEN 'Low (0-4)' WHEN lace_score < 10 THEN 'Moderate (5-9)' ELSE 'High (10+)' END
      AS risk_band
  FROM pointed
)"""
)

EXPOSED = (
    COHORT
    + """,
exposed AS (
  SELECT *, CASE WHEN hba1c_result = 'None' THEN '1. Not tested' WHEN hba1c_result = 'Norm' THEN '2. Tested - normal'
    WHEN medication_changed THEN '4. Tested - high, medication changed'
    ELSE '3. Tested - high, no medication change' END AS hba1c_group
  FROM cohort
)"""
)

CHECKS = f"""
check_texts(check_id, check_name, handling) AS (
  VALUES {", ".join(f"({i}, {_quoted(name)}, {_quoted(handling)})" for i, (name, handling) in V.CHECKS.items())}
),
orphans AS (
  SELECT count(*) AS n FROM raw WHERE NOT (admission_type_id IN (SELECT t_id::VARCHAR FROM look_type)
    AND admission_source_id IN (SELECT s_id::VARCHAR FROM look_source)
    AND discharge_disposition_id IN (SELECT d_id::VARCHAR FROM look_exit))
),
repeats AS (SELECT s_text FROM look_source GROUP BY s_text HAVING count(*) > 1),
hits AS (
  SELECT [count(*) - count(DISTINCT encounter_id), count_if(race = '?'), count_if(weight = '?'),
    count_if(payer_code = '?'), count_if(medical_specialty = '?'), count_if(diag_1 = '?'),
    count_if(gender = 'Unknown/Invalid'), count(*) - count(DISTINCT patient_nbr),
    count_if(discharge_disposition_id IN ({_strings(V.DISCHARGE_GROUPS[V.NOT_READMITTABLE])})),
    count_if(admission_type_id IN ({_strings(V.UNKNOWN_ADMISSION_TYPES)})),
    count_if(admission_source_id IN ({_strings(V.UNKNOWN_ADMISSION_SOURCES)})),
    count_if(discharge_disposition_id IN ({_strings(V.UNKNOWN_DISCHARGES)})),
    (SELECT n FROM orphans), (SELECT count(*) FROM repeats), count_if(A1Cresult = 'None')] AS n
  FROM raw
),
checks AS (
  SELECT check_id, check_name, CAST(n[check_id] AS BIGINT) AS affected_rows, handling FROM check_texts, hits
)"""
DQ = RAW + "," + CHECKS

ANALYSIS = (
    SCORED
    + """,
hashed AS (
  SELECT *, readmitted_30d::INT AS y,
    CAST('0x' || substr(md5('42|' || encounter_id), 1, 13) AS BIGINT) AS hash
  FROM scored
),
class_sizes AS (
  SELECT y AS class_y, count(*) AS n_y, sum(count(*)) OVER () AS n_all FROM hashed GROUP BY y
),
class_shares AS (
  SELECT *, ceil(0.25 * n_all) * n_y / n_all AS exact FROM class_sizes
),
class_tests AS (
  SELECT class_y, floor(exact) + if(row_number() OVER (ORDER BY exact - floor(exact) DESC, class_y)
    <= ceil(0.25 * n_all) - sum(floor(exact)) OVER (), 1, 0) AS n_test
  FROM class_shares
),
split AS (
  SELECT h.*, row_number() OVER (PARTITION BY y ORDER BY hash, encounter_id) <= n_test AS is_test
  FROM hashed h JOIN class_tests ON class_y = y
),
specialties AS (
  SELECT medical_specialty AS kept FROM cohort GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10
),
analysis AS (
  SELECT * REPLACE (coalesce(race, 'Unknown') AS race), coalesce(kept, 'Other') AS specialty_grp,
    CASE WHEN hba1c_result = 'None' THEN 'Not tested' WHEN hba1c_result = 'Norm' THEN 'Tested - normal'
      WHEN medication_changed THEN 'Tested - high, med changed' ELSE 'Tested - high, no change' END AS hba1c_group
  FROM split LEFT JOIN specialties ON kept = medical_specialty
)"""
)

_NUMERIC, _CATEGORICAL = V.NUMERIC_FEATURES, V.CATEGORICAL_FEATURES
_BOOLEAN = {"medication_changed", "on_diabetes_medication"}


def _newton(penalty: float = 0.0, steps: int = 15) -> str:
    """Fits of every group of ``design(g, x, e, n)``: e events of n trials at x, 1 for the intercept first. ``fit(g, b, v)``: estimates, variances.

    Each step adds the matrix and the gradient up entry by entry and eliminates column after column of both and the unit matrix.
    """
    return f"""newton AS (
  SELECT g, 0 AS k, list_transform(range(any_value(len(x))), lambda i: 0.0::DOUBLE) AS b, NULL::DOUBLE[][] AS a FROM design GROUP BY g
  UNION ALL
  SELECT g, k + 1, list_transform(range(len(b)), lambda i: b[i + 1] + solved[i + 1][len(b) + 1]),
    list_transform(solved, lambda r: r[len(b) + 2:])
  FROM (
    SELECT g, any_value(k) AS k, any_value(b) AS b, list_reduce(range(1, any_value(len(b)) + 1), lambda m, c:
        list_transform(m, lambda r, i: CASE WHEN i = c THEN list_transform(r, lambda z: z / m[c][c])
          ELSE list_transform(r, lambda z, j: z - r[c] * m[c][j] / m[c][c]) END), list(line ORDER BY i)) AS solved
    FROM (
      SELECT g, i, any_value(k) AS k, any_value(b) AS b,
        list_concat(list(z ORDER BY j), list_transform(range(1, any_value(len(b)) + 1), lambda c: if(c = i, 1.0, 0.0)::DOUBLE)) AS line
      FROM (
        SELECT g, i, j, any_value(k) AS k, any_value(b) AS b,
          sum(if(j > len(b), x[i] * (e - n * chance), x[i] * x[j] * n * chance * (1 - chance)))
            + {penalty} * any_value(if(i = 1, 0, if(j > len(b), -b[i], if(i = j, 1, 0)))) AS z
        FROM (
          SELECT g, k, b, x, e, n, 1 / (1 + exp(-list_dot_product(x, b))) AS chance FROM newton JOIN design USING (g) WHERE k < {steps}
        ), (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM design))) AS i), (SELECT unnest(range(1, (SELECT max(len(x)) + 2 FROM design))) AS j)
        WHERE i <= len(b) AND j <= len(b) + 1 GROUP BY g, i, j
      ) GROUP BY g, i
    ) GROUP BY g
  )
),
fit AS (SELECT g, b, list_transform(range(1, len(b) + 1), lambda i: a[i][i]) AS v FROM newton WHERE k = {steps})"""


def _models(models: dict[str, tuple[str, dict[str, str], dict[str, str | None]]]) -> str:
    """Unpenalised fits of ``analysis``: by name the rows, numeric columns by term, factors with their reference.

    Levels whose outcome does not vary go with their rows, four times over; constant columns are left out. ``terms(g, term, b, v)``,
    ``lost(g, dropped, dropped_rows)``.
    """
    given = " UNION ALL ".join(
        f"SELECT {_quoted(g)} AS g, y, [{', '.join(f'({x})::DOUBLE' for x in numeric.values())}] AS xs, "
        f"[{', '.join(factors)}]::VARCHAR[] AS fs FROM analysis WHERE {rows}"
        for g, (rows, numeric, factors) in models.items()
    )
    names = ", ".join(
        f"({_quoted(g)}, {k}, {_quoted(f)}, {_quoted(ref) if ref else 'NULL'})" for g, (_, _, factors) in models.items() for k, (f, ref) in enumerate(factors.items(), 1)
    )
    terms = ", ".join(f"({_quoted(g)}, {k}, {_quoted(t)})" for g, (_, numeric, _) in models.items() for k, t in enumerate(numeric, 1))
    rounds = ""
    for r in range(4):
        rounds += f""",
flat{r} AS (
  SELECT g, k, level FROM (SELECT g, y, unnest(fs) AS level, unnest(range(1, len(fs) + 1)) AS k FROM used{r})
  GROUP BY g, k, level HAVING sum(y) IN (0, count(*))
),
used{r + 1} AS (
  SELECT * FROM used{r} u WHERE NOT EXISTS (FROM flat{r} t WHERE t.g = u.g AND u.fs[t.k] = t.level)
)"""
    return f"""used0 AS ({given}),
factor_names(g, k, factor, reference) AS (VALUES {names}),
numeric_names(g, k, term) AS (VALUES {terms}){rounds},
lost AS (
  SELECT g, coalesce(string_agg(factor || '=' || level, ', ' ORDER BY r, k, level), '') AS dropped,
    (SELECT count(*) FROM used0 u WHERE u.g = m.g) - (SELECT count(*) FROM used4 u WHERE u.g = m.g) AS dropped_rows
  FROM (SELECT DISTINCT g FROM factor_names) m
  LEFT JOIN ({" UNION ALL ".join(f"SELECT {r} AS r, * FROM flat{r}" for r in range(4))}) USING (g) LEFT JOIN factor_names USING (g, k) GROUP BY g
),
levels AS (
  SELECT g, k, factor, level, row_number() OVER (PARTITION BY g, k ORDER BY level IS DISTINCT FROM reference, level) AS place
  FROM (SELECT DISTINCT g, unnest(fs) AS level, unnest(range(1, len(fs) + 1)) AS k FROM used4) JOIN factor_names USING (g, k)
),
columns AS (
  SELECT g, list({{'k': k, 'level': level, 'term': term}} ORDER BY kind, k, level) AS cs FROM (
    SELECT g, 0 AS kind, k, NULL AS level, term FROM numeric_names
    WHERE (SELECT min(xs[k]) < max(xs[k]) FROM used4 u WHERE u.g = numeric_names.g)
    UNION ALL SELECT g, 1, k, level, factor || '=' || level FROM levels WHERE place > 1
  ) GROUP BY g
),
design AS (
  SELECT g, list_concat([1.0::DOUBLE], list_transform(cs, lambda c: if(c.level IS NULL, xs[c.k], (fs[c.k] = c.level)::INT::DOUBLE))) AS x,
    sum(y)::DOUBLE AS e, count(*)::DOUBLE AS n
  FROM used4 JOIN columns USING (g) GROUP BY 1, 2
),
{_newton()},
terms AS (
  SELECT g, unnest(list_transform(cs, lambda c: c.term)) AS term, unnest(b[2:]) AS b, unnest(v[2:]) AS v FROM fit JOIN columns USING (g)
)"""


_ADJUSTED = {c: c for c in V.ADJUST_NUMERIC}
_PLACES: dict[str, str | None] = {"admission_source_group": None, "discharge_group": None}
_TESTED = {"tested": "hba1c_group <> 'Not tested'"}


def _ratios(places: int = 3) -> str:
    q = 1.959963984540054
    told = "if(b IS NOT NULL AND abs(b) <= 15, @, NULL)"
    return ", ".join(
        told.replace("@", f"round_even({sql}, {places})") + f" AS {name}"
        for name, sql in (("odds_ratio", "exp(b)"), ("ci95_low", f"exp(b - {q} * sqrt(v))"), ("ci95_high", f"exp(b + {q} * sqrt(v))"))
    ) + f", {told.replace('@', _P_VALUE)} AS p_value"


def _status(term: str) -> str:
    return f"""CASE WHEN b IS NOT NULL AND abs(b) > 15 THEN 'separated' WHEN b IS NOT NULL THEN 'estimated'
    WHEN list_contains(string_split(dropped, ', '), {term}) THEN 'separated' ELSE 'not estimable' END AS status, dropped AS dropped_levels, dropped_rows"""


def _adjusted_groups() -> str:
    factors = {"hba1c_group": "Not tested", "primary_diagnosis_group": None, **_PLACES}
    groups = ", ".join(f"({_quoted(label)})" for label in V.MODEL_EXPOSURE_LABELS[1:])
    return f"""WITH RECURSIVE {ANALYSIS},
{_models({"all": ("TRUE", _ADJUSTED, factors)})}
SELECT label AS group_vs_not_tested, {_ratios()}, {_status("'hba1c_group=' || label")}
FROM (VALUES {groups}) groups(label) CROSS JOIN lost LEFT JOIN terms ON term = 'hba1c_group=' || label"""


def _adjusted_tested() -> str:
    return f"""WITH RECURSIVE {ANALYSIS},
{_models({"all": ("TRUE", _TESTED | _ADJUSTED, {"primary_diagnosis_group": None, **_PLACES})})}
SELECT {_ratios()}, {_status("'tested'")} FROM lost LEFT JOIN terms ON term = 'tested'"""


def _adjusted_strata() -> str:
    models = {g: (f"primary_diagnosis_group = {_quoted(g)}", _TESTED | _ADJUSTED, _PLACES) for g in V.MODEL_STRATA}
    product = {"subgroup": "primary_diagnosis_group = 'Diabetes'", "tested:subgroup": "hba1c_group <> 'Not tested' AND primary_diagnosis_group = 'Diabetes'"}
    models["product"] = ("primary_diagnosis_group IN ('Diabetes', 'Circulatory')", _TESTED | product | _ADJUSTED, _PLACES)
    rate = lambda side: f"round_even(100.0 * avg(y) FILTER ({side} (hba1c_group <> 'Not tested')), 2)"
    return f"""WITH RECURSIVE {ANALYSIS},
{_models(models)},
crude AS (
  SELECT primary_diagnosis_group AS g, count(*) AS patients, {rate('NOT')} AS rate_not_tested_pct, {rate('')} AS rate_tested_pct
  FROM analysis GROUP BY 1
),
product AS (SELECT {_P_VALUE} AS p FROM terms WHERE g = 'product' AND term = 'tested:subgroup')
SELECT g AS primary_diagnosis, coalesce(patients, 0) AS patients, rate_not_tested_pct, rate_tested_pct,
  {_ratios().replace("AS odds_ratio", "AS adjusted_odds_ratio")}, (SELECT p FROM product) AS interaction_p_diabetes_vs_circulatory,
  {_status("'tested'")}
FROM (VALUES {", ".join(f"({_quoted(g)})" for g in V.MODEL_STRATA)}) strata(g)
LEFT JOIN crude USING (g) LEFT JOIN lost USING (g) LEFT JOIN (SELECT * FROM terms WHERE term = 'tested') USING (g)"""


def _features() -> str:
    scaled = ",\n  ".join(
        f"round((a.{c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train), 6) AS {c}"
        for c in _NUMERIC
    )

    def text(c: str) -> str:
        return f"if({c}, 'True', 'False')" if c in _BOOLEAN else c

    seen = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS col, {text(c)} AS level FROM train" for c in _CATEGORICAL)
    pairs = " UNION ALL ".join(f"SELECT encounter_id, '{c}' AS col, {text(c)} AS level FROM analysis" for c in _CATEGORICAL)
    return f"""WITH {ANALYSIS},
train AS (SELECT * FROM analysis WHERE NOT is_test),
seen AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY level) AS place FROM ({seen})),
named AS (
  SELECT p.encounter_id AS id, string_agg(p.col || '_' || p.level, '|' ORDER BY p.col || '_' || p.level) AS dummies
  FROM ({pairs}) p JOIN seen USING (col, level) WHERE place > 1 GROUP BY 1
)
SELECT a.encounter_id, {scaled}, coalesce(dummies, '') AS dummies,
  round((SELECT count(*) FROM train) / (2.0 * (SELECT count(*) FROM train t WHERE t.y = a.y)), 6) AS weight
FROM analysis a LEFT JOIN named ON id = a.encounter_id"""


def _risk_model() -> str:
    """``features(feature, place)`` after the intercept, ``odds``, and ``scored_test`` with every method's score, by the penalised fit."""
    numeric = ", ".join(f"(a.{c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train)" for c in _NUMERIC)
    text = lambda c: f"if({c}, 'True', 'False')" if c in _BOOLEAN else c
    seen = " UNION ALL ".join(f"SELECT DISTINCT {k} AS k, '{c}' AS col, {text(c)} AS level FROM train" for k, c in enumerate(_CATEGORICAL))
    names = ", ".join(f"({k}, '{c}')" for k, c in enumerate(_NUMERIC))
    return f"""WITH RECURSIVE {ANALYSIS},
train AS (SELECT * FROM analysis WHERE NOT is_test),
dummies AS (
  SELECT list({{'k': k + 1, 'level': level}} ORDER BY k, level) AS ds
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level) AS place FROM ({seen})) WHERE place > 1
),
features AS (
  SELECT feature, row_number() OVER (ORDER BY kind, k, level) AS place FROM (
    SELECT 0 AS kind, k, NULL AS level, name AS feature FROM (VALUES {names}) numeric_names(k, name)
    UNION ALL SELECT 1, k, level, col || '_' || level FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level) AS place FROM ({seen})) WHERE place > 1
  )
),
rows AS (
  SELECT a.encounter_id, a.y, a.is_test, a.lace_score, a.prior_inpatient, list_concat([1.0::DOUBLE, {numeric}],
    list_transform(ds, lambda d: ([{", ".join("a." + c if c not in _BOOLEAN else f"if(a.{c}, 'True', 'False')" for c in _CATEGORICAL)}])[d.k] = d.level)::INT[]::DOUBLE[]) AS x
  FROM analysis a, dummies
),
design AS (
  SELECT 'model' AS g, x, y * w AS e, w AS n
  FROM (SELECT x, y, (SELECT count(*) FROM train) / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM rows WHERE NOT is_test)
),
{_newton(2.0, 9)},
odds AS (SELECT feature, round(exp(b[place + 1]), 6) AS odds_ratio FROM features, fit),
scored_test AS (
  SELECT encounter_id, y, 1 / (1 + exp(-list_dot_product(x, b))) AS model_risk, lace_score, prior_inpatient FROM rows, fit WHERE is_test
)"""


#: Two-sided p-value of a normal z by the power series of the error function; beyond 6 it is 0 to eight places.
_P_VALUE = """if(abs(b / sqrt(v)) > 6, 0.0, round_even(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120),
    lambda n: if(n % 2 = 0, 1, -1) * exp((2 * n + 1) * ln(greatest(abs(b / sqrt(v)), 1e-300) / sqrt(2)) - lgamma(n + 1.0)) / (2 * n + 1))), 4))"""


def _wald(cte: str, estimates: str, more: str = "") -> str:
    """Estimates and variances to the columns of a coefficient table; 1.95996... is the normal 97.5 % point."""
    q = 1.959963984540054
    return f"""WITH {cte}, est AS ({estimates})
SELECT {more}term, round_even(b, 6) AS estimate, round_even(sqrt(v), 6) AS se, round_even(b / sqrt(v), 6) AS z,
  round_even(exp(b), 6) AS odds_ratio, round_even(exp(b - {q} * sqrt(v)), 6) AS ci95_low,
  round_even(exp(b + {q} * sqrt(v)), 6) AS ci95_high, {_P_VALUE} AS p_value FROM est"""


_CELLS = (
    COHORT
    + """,
cells AS (
  SELECT hba1c_tested AS t, primary_diagnosis_group = 'Diabetes' AS d, count_if(readmitted_30d)::DOUBLE AS e,
         count_if(NOT readmitted_30d)::DOUBLE AS o
  FROM cohort GROUP BY ALL
),
pair AS (SELECT t, sum(e) AS e, sum(o) AS o FROM cells GROUP BY t),
logits AS (SELECT t, d, ln(e / o) AS l, 1 / e + 1 / o AS v FROM cells)"""
)


def _cell(t: bool, d: bool, what: str) -> str:
    return f"(SELECT {what} FROM logits WHERE t = {t} AND d = {d})".lower()


def _interaction() -> str:
    l00, l01, l10, l11 = (_cell(t, d, "l") for t in (False, True) for d in (False, True))
    v00, v01, v10, v11 = (_cell(t, d, "v") for t in (False, True) for d in (False, True))
    return f"""SELECT * FROM (VALUES ('tested', {l10} - {l00}, {v10} + {v00}), ('diabetes', {l01} - {l00}, {v01} + {v00}),
  ('tested:diabetes', {l11} - {l10} - {l01} + {l00}, {v11} + {v10} + {v01} + {v00})) t(term, b, v)"""


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

ORACLE_COMPARISON = f"""{_risk_model()}, methods AS (
  {" UNION ALL ".join(f"SELECT {_quoted(m)} AS method, {c}::DOUBLE AS s, y, encounter_id AS id FROM scored_test" for m, c in V.METHODS.items())}
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY s DESC, id)
      <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY method)) AS top,
    rank() OVER (PARTITION BY method ORDER BY s) + (count(*) OVER (PARTITION BY method, s) - 1) / 2 AS mid_rank
  FROM methods
)
SELECT method,
  round_even((sum(mid_rank) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
    / (sum(y)::DOUBLE * sum(1 - y)::DOUBLE), 3) AS auc,
  round_even(100.0 * (sum(y) FILTER (top) / sum(y)), 1) AS readmissions_caught_top20_pct,
  round_even(100.0 * avg(y) FILTER (top), 1) AS readmission_rate_in_top20_pct,
  round_even(100.0 * avg(y), 2) AS baseline_rate_pct
FROM placed GROUP BY method"""

ORACLE_DECILES = f"""{_risk_model()}, placed AS (
  SELECT y, row_number() OVER (ORDER BY model_risk, encounter_id) AS r, count(*) OVER () AS n FROM scored_test
), tenths AS (
  SELECT greatest(1, (10 * (r - 1) + n - 2) // (n - 1)) AS d, count(*) AS c, round_even(100.0 * avg(y), 2) AS rate
  FROM placed GROUP BY 1
)
SELECT CAST(d AS INT) AS decile, c AS patients, rate AS readmission_rate_pct,
  CAST(sum(c) OVER () AS BIGINT) AS total_patients, round(sum(rate * c) OVER () / sum(c) OVER (), 6) AS weighted_rate_pct,
  d >= 9 AS highlighted FROM tenths"""

ORACLE_BANDS = f"""WITH {SCORED}
SELECT risk_band, count(*) AS patients, round(100.0 * count(*) / (SELECT count(*) FROM cohort), 1)
  AS share_of_patients_pct, CAST(sum(readmitted_30d::INT) AS BIGINT) AS readmitted,
  round(100.0 * avg(readmitted_30d::INT), 2) AS readmission_rate_pct
FROM scored GROUP BY risk_band"""

ORACLE_SUMMARY = f"""WITH {EXPOSED}
SELECT hba1c_group, count(*) AS patients, round(100.0 * avg(readmitted_30d::INT), 2) AS readmission_rate_pct
FROM exposed GROUP BY hba1c_group"""

ORACLES: dict[str, str] = {
    "q_load_counts": "SELECT *, CASE WHEN table_name IN ('region', 'nation') THEN 'as expected' "
    "WHEN table_name = 'supplier' THEN 'differs' ELSE 'nothing expected' END AS check FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES)
    + ")",
    "q_stacked_sections": """
SELECT p_partkey, 'brand' AS section, CAST(p_size AS BIGINT) AS id, p_brand || ', new' AS description FROM part
UNION ALL SELECT p_partkey, 'brand', p_size + 1, p_brand FROM part
UNION ALL SELECT p_partkey, 'type', p_partkey, p_type FROM part
UNION ALL SELECT p_partkey, 'name', p_size, 'the "' || p_name || '"' FROM part""",
    "q_read_text": f"WITH {RAW} SELECT {', '.join(RAW_COLUMNS)} FROM raw",
    "q_read_lookup": f"WITH {RAW} SELECT CAST(s_id AS INT) AS admission_source_id, s_text AS description FROM look_source",
    "q_staging": f"WITH {STAGED} SELECT * FROM staged",
    "q_band_midpoint": f"WITH {STAGED} SELECT age_band, age_mid, count(*) AS n_rows FROM staged GROUP BY ALL",
    "q_code_groups": f"""WITH {STAGED}
SELECT encounter_id, admission_type_group, admission_source_group, discharge_group FROM staged""",
    "q_code_chapters": f"""WITH {CHAPTERS}, coded AS (
  SELECT event_id, event_type AS e, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
), codes AS (
  SELECT event_id, CASE
    WHEN e = 'view' THEN CASE k % 10 WHEN 0 THEN '?' WHEN 1 THEN NULL ELSE 'V' || k END
    WHEN e = 'click' THEN if(k % 2 = 0, 'E9' || k, '250.' || k)
    WHEN e = 'purchase' THEN (10 * k + 5) || '.5'
    WHEN e = 'signup' THEN CASE k % 3 WHEN 0 THEN (700 + k) || 'd' WHEN 1 THEN ' ' || (440 + k)
      ELSE (440 + k) || '.99' END
    ELSE CAST((event_id * 7 + k) % 1000 AS VARCHAR) END AS code
  FROM coded
)
SELECT event_id, code, {_chapter("code")} AS chapter
FROM codes LEFT JOIN chapter_ranges ON TRY_CAST(code AS DOUBLE) BETWEEN lo AND hi""",
    "q_dq_suite": f"WITH {DQ} SELECT * FROM checks",
    "q_orphan_keys": f"""WITH {RAW}, misses AS (
  SELECT NOT EXISTS (FROM look_type WHERE t_id::VARCHAR = admission_type_id) AS t,
         NOT EXISTS (FROM look_source WHERE s_id::VARCHAR = admission_source_id) AS s,
         NOT EXISTS (FROM look_exit WHERE d_id::VARCHAR = discharge_disposition_id) AS d FROM raw
)
SELECT count(*) AS n_rows, count(*) FILTER (t OR s OR d) AS rows_with_orphan,
  count(*) FILTER (t) AS orphan_admission_type_id, count(*) FILTER (s) AS orphan_admission_source_id,
  count(*) FILTER (d) AS orphan_discharge_disposition_id FROM misses""",
    "q_dup_descriptions": f"""WITH {RAW}
SELECT s_text AS description, count(*) AS times FROM look_source GROUP BY s_text HAVING count(*) > 1""",
    "q_missing_share": f"""WITH {DQ}
SELECT check_id, regexp_replace(replace(check_name, ' recorded as ''?''', ' missing'), ' \\(.*\\)', '') AS label,
  affected_rows, round_even(100.0 * affected_rows / (SELECT count(*) FROM orders), 2) AS share_pct
FROM checks WHERE check_id IN ({', '.join(map(str, V.MISSING_SHARE_CHECKS))})""",
    "q_dq_display": f"WITH {DQ} SELECT check_name, affected_rows, handling FROM checks WHERE affected_rows > 0",
    "q_cohort": f"WITH {COHORT} SELECT * FROM cohort",
    "q_cohort_funnel": f"""WITH {COHORT}, steps AS (
  SELECT 1 AS step, 'All hospital encounters' AS description, count(*) AS encounters FROM staged
  UNION ALL SELECT 2, 'First encounter per patient', count(DISTINCT patient_nbr) FROM staged
  UNION ALL SELECT 3, 'Excluding died / hospice and invalid gender', count(*) FROM cohort
)
SELECT *, 100.0 * encounters / (SELECT encounters FROM steps WHERE step = 1) AS share_pct FROM steps""",
    "q_kpi": f"WITH {COHORT} {KPI}",
    "q_rate_profile": f"WITH {PROFILE} SELECT * FROM profile",
    "q_driver_flags": f"""WITH {PROFILE}, kpi AS ({KPI})
SELECT dimension, category, p.patients, p.readmission_rate_pct, k.readmission_rate_pct AS baseline_pct,
  CASE WHEN p.readmission_rate_pct > k.readmission_rate_pct * 1.15 THEN 'bad'
       WHEN p.readmission_rate_pct < k.readmission_rate_pct * 0.85 THEN 'good' ELSE 'neutral' END AS flag,
  p.readmission_rate_pct > k.readmission_rate_pct AS above_average
FROM profile p, kpi k""",
    "q_profile_slice": f"""WITH {PROFILE}, kpi AS ({KPI})
SELECT p.*, k.readmission_rate_pct AS baseline_pct, p.readmission_rate_pct > k.readmission_rate_pct AS above_average
FROM profile p, kpi k WHERE dimension = 'Discharged to'""",
    "q_top_category": f"""WITH {PROFILE}, kpi AS ({KPI}), best AS (
  SELECT * FROM profile
  QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY readmission_rate_pct DESC, category DESC) = 1
)
SELECT dimension, category, b.readmission_rate_pct, b.patients, k.readmission_rate_pct AS baseline_pct
FROM best b, kpi k""",
    "q_headlines": f"""WITH {PROFILE}
SELECT max(readmission_rate_pct) FILTER (dimension LIKE 'Inpatient%' AND category = '3+') AS rate_3_or_more_stays,
  max(readmission_rate_pct) FILTER (dimension LIKE 'Inpatient%' AND category = '0') AS rate_no_stay,
  max(readmission_rate_pct) FILTER (dimension LIKE 'HbA1c%' AND category = 'Tested') AS rate_tested,
  max(readmission_rate_pct) FILTER (dimension LIKE 'HbA1c%' AND category = 'Not tested') AS rate_not_tested,
  (SELECT round(100.0 * avg(readmitted_30d::INT), 2) FROM cohort
    WHERE primary_diagnosis_group = 'Diabetes' AND hba1c_tested) AS diabetes_rate_tested,
  (SELECT round(100.0 * avg(readmitted_30d::INT), 2) FROM cohort
    WHERE primary_diagnosis_group = 'Diabetes' AND NOT hba1c_tested) AS diabetes_rate_not_tested
FROM profile""",
    "q_points_score": f"""WITH {SCORED}
SELECT encounter_id, patient_nbr, readmitted_30d, l_points, a_points, c_points, e_points, lace_score, risk_band
FROM scored""",
    "q_band_validation": ORACLE_BANDS,
    "q_exposure_groups": f"""WITH {EXPOSED}
SELECT encounter_id, hba1c_group, primary_diagnosis_group, readmitted_30d FROM exposed""",
    "q_exposure_summary": ORACLE_SUMMARY,
    "q_exposure_by_group": f"""WITH {EXPOSED}
SELECT primary_diagnosis_group,
  round(100.0 * (count_if(readmitted_30d AND NOT hba1c_tested) / nullif(count_if(NOT hba1c_tested), 0)), 2)
    AS not_tested_pct,
  round(100.0 * (count_if(readmitted_30d AND hba1c_tested) / nullif(count_if(hba1c_tested), 0)), 2) AS tested_pct,
  count(*) FILTER (hba1c_tested) AS tested_patients, count(*) AS patients
FROM exposed GROUP BY 1
HAVING primary_diagnosis_group IN ({', '.join(map(_quoted, V.EXPOSURE_STRATA))})""",
    "q_top_levels": f"""WITH {COHORT}
SELECT medical_specialty, count(*) AS n_rows FROM cohort GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "q_kept_levels": f"WITH {ANALYSIS} SELECT specialty_grp, race, count(*) AS n_rows FROM analysis GROUP BY ALL",
    "q_split": f"WITH {ANALYSIS} SELECT encounter_id, y, is_test FROM analysis",
    "q_features": _features(),
    "q_auc": f"""WITH {SCORED}, per_score AS (
  SELECT lace_score AS s, count_if(readmitted_30d) AS p, count_if(NOT readmitted_30d) AS n FROM scored GROUP BY 1
)
SELECT round((SELECT sum(a.p::DOUBLE * b.n * if(a.s > b.s, 1, 0.5)) FROM per_score a, per_score b WHERE a.s >= b.s)
  / (sum(p)::DOUBLE * sum(n)::DOUBLE), 9) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives
FROM per_score""",
    "q_roc_points": f"""WITH {SCORED}, steps AS (
  SELECT lace_score AS threshold, count_if(readmitted_30d) AS p, count_if(NOT readmitted_30d) AS n FROM scored GROUP BY 1
), curve AS (
  SELECT threshold, sum(p) OVER falling AS tp, sum(n) OVER falling AS fp, p, n, row_number() OVER falling AS place,
    lead(p) OVER falling AS p_next, lead(n) OVER falling AS n_next
  FROM steps WINDOW falling AS (ORDER BY threshold DESC)
)
SELECT 'inf'::DOUBLE AS threshold, 0::DOUBLE AS tpr, 0::DOUBLE AS fpr
UNION ALL SELECT threshold, tp / (SELECT sum(p) FROM steps), fp / (SELECT sum(n) FROM steps)
FROM curve WHERE place = 1 OR p_next IS NULL OR p <> p_next OR n <> n_next""",
    "q_auc_ratio": f"""WITH {SCORED}, ratios AS (
  SELECT num_medications / los_days AS s, readmitted_30d::INT AS y FROM scored
), placed AS (
  SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS mid_rank FROM ratios
)
SELECT round((sum(mid_rank) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
    / (sum(y)::DOUBLE * sum(1 - y)::DOUBLE), 9) AS auc,
  CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM placed""",
    "q_capture_top_frac": f"""WITH {SCORED}, placed AS (
  SELECT readmitted_30d::INT AS y, row_number() OVER (ORDER BY lace_score DESC, encounter_id)
    <= CAST(floor(0.2::DOUBLE * count(*) OVER ()) AS BIGINT) AS top FROM scored
), totals AS (
  SELECT count(*) AS n_rows, count(*) FILTER (top) AS followed_up, CAST(sum(y) AS BIGINT) AS events,
    CAST(coalesce(sum(y) FILTER (top), 0) AS BIGINT) AS events_caught FROM placed
)
SELECT *, events_caught / events AS captured_share, events_caught / followed_up AS rate_in_top,
  events / n_rows AS baseline_rate, (events_caught / events) / 0.2::DOUBLE AS lift FROM totals""",
    "q_deciles": f"""WITH {SCORED}, placed AS (
  SELECT readmitted_30d::INT AS y, row_number() OVER (ORDER BY lace_score, encounter_id) AS r, count(*) OVER () AS n
  FROM scored
), tenths AS (
  SELECT greatest(1, (10 * (r - 1) + n - 2) // (n - 1)) AS d, count(*) AS c, round_even(100.0 * avg(y), 2) AS rate
  FROM placed GROUP BY 1
)
SELECT CAST(d AS INT) AS decile, c AS patients, rate AS readmission_rate_pct,
  CAST(sum(c) OVER () AS BIGINT) AS total_patients, round(sum(rate * c) OVER () / sum(c) OVER (), 6) AS weighted_rate_pct,
  d >= 9 AS highlighted FROM tenths""",
    "q_score_comparison": f"""WITH {SCORED}, methods AS (
  SELECT 'Points' AS method, lace_score::DOUBLE AS s, readmitted_30d::INT AS y, encounter_id AS id FROM scored
  UNION ALL SELECT 'Prior stays', prior_inpatient, readmitted_30d::INT, encounter_id FROM scored
  UNION ALL SELECT 'Medications per day', num_medications / los_days, readmitted_30d::INT, encounter_id FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY s DESC, id)
      <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY method)) AS top,
    rank() OVER (PARTITION BY method ORDER BY s)
      + (count(*) OVER (PARTITION BY method, s) - 1) / 2 AS mid_rank
  FROM methods
)
SELECT method,
  round_even((sum(mid_rank) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
    / (sum(y)::DOUBLE * sum(1 - y)::DOUBLE), 3) AS auc,
  round_even(100.0 * (sum(y) FILTER (top) / sum(y)), 1) AS readmissions_caught_top20_pct,
  round_even(100.0 * avg(y) FILTER (top), 1) AS readmission_rate_in_top20_pct,
  round_even(100.0 * avg(y), 2) AS baseline_rate_pct
FROM placed GROUP BY method""",
    "q_logit_2x2": _wald(
        _CELLS,
        """SELECT 'tested' AS term, ln(x.e * u.o / (x.o * u.e)) AS b, 1 / x.e + 1 / x.o + 1 / u.e + 1 / u.o AS v
  FROM pair x, pair u WHERE x.t AND NOT u.t""",
    ),
    "q_logit_groups": _wald(
        ANALYSIS
        + """, by_group AS (
  SELECT hba1c_group AS g, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS o FROM analysis GROUP BY 1
)""",
        """SELECT 'hba1c_group=' || x.g AS term, ln(x.e * u.o / (x.o * u.e)) AS b,
  1 / x.e + 1 / x.o + 1 / u.e + 1 / u.o AS v
  FROM by_group x, by_group u WHERE x.g <> 'Not tested' AND u.g = 'Not tested'""",
    ),
    "q_logit_strata_crude": _wald(
        ANALYSIS
        + """, by_side AS (
  SELECT primary_diagnosis_group AS g, hba1c_group <> 'Not tested' AS t, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS o
  FROM analysis GROUP BY ALL
)""",
        f"""SELECT x.g AS term, CAST(x.e + x.o + u.e + u.o AS BIGINT) AS n_rows, round(u.e / (u.e + u.o), 9) AS rate_0,
  round(x.e / (x.e + x.o), 9) AS rate_1, ln(x.e * u.o / (x.o * u.e)) AS b, 1 / x.e + 1 / x.o + 1 / u.e + 1 / u.o AS v
  FROM by_side x JOIN by_side u USING (g) WHERE x.t AND NOT u.t
    AND x.g IN ({", ".join(map(_quoted, V.MODEL_STRATA))})""",
        "n_rows, rate_0, rate_1, ",
    ),
    "q_logit_interaction": _wald(_CELLS, _interaction()),
    "q_covariate_patterns": f"""WITH {ANALYSIS}
SELECT age_mid, los_days, prior_inpatient, prior_emergency, number_diagnoses, hba1c_group, primary_diagnosis_group,
  admission_source_group, discharge_group, count(*) AS n, CAST(sum(y) AS BIGINT) AS events
FROM analysis GROUP BY ALL""",
    "q_global_rank": """WITH priced AS (
  SELECT l_orderkey, l_linenumber, if(l_discount = 0, 'inf'::DOUBLE, l_extendedprice / nullif(l_discount, 0)) AS per FROM lineitem
)
SELECT l_orderkey, l_linenumber, row_number() OVER by_price AS place, CAST(sum(l_linenumber) OVER by_price AS BIGINT) AS lines_upto
FROM priced WINDOW by_price AS (ORDER BY per, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)""",
    "q_risk_model": f"""{_risk_model()}
SELECT encounter_id, y, round(model_risk, 6) AS model_risk, lace_score, prior_inpatient FROM scored_test""",
    "q_odds_table": f"{_risk_model()} SELECT * FROM odds",
    "q_score_equations": f"""{_risk_model()}
SELECT 'intercept' AS feature, 0::DOUBLE AS off UNION ALL SELECT feature, 0 FROM features""",
    "q_model_comparison": ORACLE_COMPARISON,
    "q_model_deciles": ORACLE_DECILES,
    "q_model_roc": f"""{_risk_model()}, steps AS (
  SELECT model_risk AS threshold, sum(y) AS p, sum(1 - y) AS n FROM scored_test GROUP BY 1
), curve AS (
  SELECT threshold, sum(p) OVER falling AS tp, sum(n) OVER falling AS fp, p, n, row_number() OVER falling AS place,
    lead(p) OVER falling AS p_next, lead(n) OVER falling AS n_next
  FROM steps WINDOW falling AS (ORDER BY threshold DESC)
)
SELECT 'inf'::DOUBLE AS threshold, 0::DOUBLE AS tpr, 0::DOUBLE AS fpr
UNION ALL SELECT round(threshold, 6), tp / (SELECT sum(p) FROM steps), fp / (SELECT sum(n) FROM steps)
FROM curve WHERE place = 1 OR p_next IS NULL OR p <> p_next OR n <> n_next""",
    "q_logit_adjusted": _adjusted_groups(),
    "q_logit_tested": _adjusted_tested(),
    "q_logit_stratified": _adjusted_strata(),
    "q_stacked_files": """
SELECT p_size, 'brand' AS section, p_partkey, p_brand || ', new' AS description FROM part
UNION ALL SELECT p_size, 'type', p_partkey, p_type FROM part
UNION ALL SELECT p_size, 'name', p_partkey, 'the "' || p_name || '"' FROM part""",
    "q_load_written": "SELECT *, CASE WHEN table_name IN ('region', 'nation') THEN 'as expected' "
    "WHEN table_name = 'supplier' THEN 'differs' ELSE 'nothing expected' END AS check FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in "region nation supplier part customer orders".split())
    + ")",
    "q_code_groups_table": f"""WITH {STAGED}
SELECT encounter_id, admission_type_group, admission_source_group, discharge_group FROM staged""",
    "q_roc_bounded": """WITH steps AS (
  SELECT l_extendedprice AS threshold, count_if(l_quantity > 25) AS p, count_if(l_quantity <= 25) AS n FROM lineitem GROUP BY 1
), curve AS (
  SELECT threshold, sum(p) OVER falling AS tp, sum(n) OVER falling AS fp, sum(p) OVER () AS p_all, sum(n) OVER () AS n_all
  FROM steps WINDOW falling AS (ORDER BY threshold DESC)
)
SELECT 'inf'::DOUBLE AS threshold, 0::DOUBLE AS tpr, 0::DOUBLE AS fpr
UNION ALL SELECT min(threshold), max(tp) / any_value(p_all), max(fp) / any_value(n_all)
FROM curve GROUP BY floor(tp * 25 / p_all), floor(fp * 25 / n_all)""",
    "q_report_payload": f"""WITH RECURSIVE {PROFILE}, {CHECKS},
kpi AS ({KPI}),
compared AS (SELECT * FROM ({ORACLE_COMPARISON})),
tenths AS (SELECT * FROM ({ORACLE_DECILES})),
strata AS (SELECT * FROM ({_adjusted_strata()})),
tested AS (SELECT * FROM ({_adjusted_tested()}))
SELECT 1::INT AS part, 'kpi' AS section, 'all' AS name, patients AS n_rows, readmission_rate_pct AS value FROM kpi
UNION ALL SELECT 2, 'profile', dimension || ': ' || category, patients, readmission_rate_pct FROM profile
UNION ALL SELECT 3, 'models', method || ': auc', NULL, auc FROM compared
UNION ALL SELECT 3, 'models', method || ': readmissions_caught_top20_pct', NULL, readmissions_caught_top20_pct FROM compared
UNION ALL SELECT 4, 'deciles', decile::VARCHAR, patients, readmission_rate_pct FROM tenths
UNION ALL SELECT 5, 'hba', primary_diagnosis || ': adjusted_odds_ratio', patients, adjusted_odds_ratio FROM strata
UNION ALL SELECT 5, 'hba', primary_diagnosis || ': p_value', patients, p_value FROM strata
UNION ALL SELECT 6, 'hbaAll', 'odds_ratio', NULL, odds_ratio FROM tested
UNION ALL SELECT 6, 'hbaAll', 'ci95_low', NULL, ci95_low FROM tested
UNION ALL SELECT 6, 'hbaAll', 'ci95_high', NULL, ci95_high FROM tested
UNION ALL SELECT 6, 'hbaAll', 'p_value', NULL, p_value FROM tested
UNION ALL SELECT 7, 'funnel', 'All hospital encounters', count(*), NULL FROM staged
UNION ALL SELECT 7, 'funnel', 'First encounter per patient', count(DISTINCT patient_nbr), NULL FROM staged
UNION ALL SELECT 7, 'funnel', 'Excluding died / hospice and invalid gender', count(*), NULL FROM cohort
UNION ALL SELECT 8, 'dq', check_name, affected_rows, NULL FROM checks""",
    "q_export_preview": f"""WITH {PROFILE}, {CHECKS},
kpi AS ({KPI}),
bands AS (SELECT * FROM ({ORACLE_BANDS})),
summary AS (SELECT * FROM ({ORACLE_SUMMARY})),
placed AS (
  SELECT 'dq_results' AS table_name, check_id AS place, concat_ws(' | ', check_id, check_name, affected_rows) AS line FROM checks
  UNION ALL SELECT 'cohort_funnel', 1, concat_ws(' | ', 1, 'All hospital encounters', count(*)) FROM staged
  UNION ALL SELECT 'cohort_funnel', 2, concat_ws(' | ', 2, 'First encounter per patient', count(DISTINCT patient_nbr)) FROM staged
  UNION ALL SELECT 'cohort_funnel', 3, concat_ws(' | ', 3, 'Excluding died / hospice and invalid gender', count(*)) FROM cohort
  UNION ALL SELECT 'kpi_overall', 1, concat_ws(' | ', patients, readmitted_30d, readmission_rate_pct, avg_los_days, hba1c_tested_pct) FROM kpi
  UNION ALL SELECT 'risk_band_validation', row_number() OVER (ORDER BY CASE risk_band[1] WHEN 'L' THEN 1 WHEN 'M' THEN 2 ELSE 3 END),
    concat_ws(' | ', risk_band, patients, share_of_patients_pct, readmitted, readmission_rate_pct) FROM bands
  UNION ALL SELECT 'hba1c_summary', row_number() OVER (ORDER BY hba1c_group), concat_ws(' | ', hba1c_group, patients, readmission_rate_pct) FROM summary
)
SELECT table_name, place::BIGINT AS place, line FROM placed""",
    "q_export_cohort": f"WITH {COHORT} SELECT encounter_id, age_mid, los_days, prior_inpatient, readmitted_30d FROM cohort",
    "q_export_statistics": f"""SELECT 'hba1c_adjusted' AS table_name, group_vs_not_tested AS name, odds_ratio, p_value FROM ({_adjusted_groups()})
UNION ALL SELECT 'hba1c_by_diagnosis_adjusted', primary_diagnosis, adjusted_odds_ratio, p_value FROM ({_adjusted_strata()})""",
}
