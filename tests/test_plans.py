"""The physical plans are the intended ones."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from outcomelens.operators.evaluate import with_quantile
from outcomelens.plans import hospital, testbed
from outcomelens.registry import QUERIES, _cohort, _staged

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text: str) -> int:
    return len(re.findall(r"FileScan", text))


def test_no_pair_joins(spark):
    lazy = ["q_staging", "q_orphan_keys", "q_cohort", "q_cohort_funnel", "q_kpi", "q_rate_profile", "q_headlines"]
    for name in lazy:
        text = plan(QUERIES[name](spark, FOLDER))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_first_row_filter_runs_before_the_shuffle(spark):
    text = plan(_cohort(spark, FOLDER))
    assert "Final" in text and re.search(r"WindowGroupLimit.*Partial", text)


def test_unused_lookups_are_not_joined(spark):
    raw = testbed.raw_tables(spark, FOLDER)
    staged = hospital.stage(raw)
    text = plan(staged.select("encounter_id", "los_days"))
    assert "n_name" not in text and "r_name" not in text


def test_columns_are_pruned(spark):
    text = plan(_staged(spark, FOLDER).select("los_days"))
    line = next(x for x in text.splitlines() if "lineitem.parquet" in x)
    assert "ReadSchema: struct<l_orderkey:bigint>" in line


@pytest.fixture
def members(spark, scratch):
    return scratch.table(_cohort(spark, FOLDER))


def test_profile_reads_the_cohort_once(members):
    text = plan(hospital.profile(members))
    assert scans(text) == 1
    # the rows are summed before they are shuffled
    before = text[: text.index("FileScan")]
    assert before.rindex("partial_count") > before.index("hashpartitioning(dimension")


def test_quality_reads_rows_once_and_keys_once_each(spark, scratch):
    raw = testbed.raw_tables(spark, FOLDER)
    rows = scratch.table(raw.encounters)
    loaded = hospital.RawTables(rows, raw.admission_type, raw.admission_source, raw.discharge_disposition)
    optimized = hospital.data_quality(loaded)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in optimized
    text = plan(hospital.data_quality(loaded))
    reads = [x for x in text.splitlines() if "FileScan" in x and scratch.paths[0].split("/")[-1] in x]
    schemas = [x.split("ReadSchema: ")[1] for x in reads]
    assert sorted(schemas)[:1] == ["struct<encounter_id:string>"]
    assert "struct<patient_nbr:string>" in schemas
    wide = [s for s in set(schemas) if s.count(":") > 1]
    assert len(wide) == 1 and "insulin" not in wide[0]


def test_marking_deciles_needs_no_shuffle(spark, scratch):
    df = scratch.table(spark.range(5000).select("id", (F.col("id") % 7).alias("score")))
    assert "Exchange" not in plan(with_quantile(df, "score", "id"))


def test_lines_are_dealt_out_before_they_are_summed(spark):
    text = plan(testbed.encounters(spark, FOLDER))
    lines = text[: text.index("lineitem.parquet")]
    assert "partial_" not in lines[lines.rindex("Exchange") :]  # no map task holds sums of its own
    # the join takes the sums as they lie: one shuffle of the lines
    assert lines.count("Exchange hashpartitioning(l_orderkey") == 1


def test_days_stay_by_customer_for_the_join_with_customers(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(testbed.encounters(spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert re.search(r"SortMergeJoin \[d_custkey#\d+L\], \[c_custkey", text)
    assert not re.search(r"hashpartitioning\(d_custkey#\d+L, \d+\)", text)
    assert len(re.findall(r"Exchange hashpartitioning\(o_custkey#\d+L, \d+\)", text)) == 1


def test_sums_of_lines_with_nulls(spark):
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string"
    rows = [
        (1, 1, 2.0, 0.05, "R", "O"), (1, 2, 3.0, 0.04, "A", "F"), (1, 3, None, None, None, None), (1, 3, 1.0, float("nan"), "N", "O"),
        (2, None, None, 0.01, "A", None), (None, 1, 1.0, 0.08, "R", "O"), (None, 1, 1.0, 0.08, "A", "O"),
    ]
    found = {row[0]: tuple(row[1:]) for row in testbed._lines(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: (4, 6, 9, 1, 1, 2, 2), 2: (1, None, None, 0, 1, 0, 0), None: (2, 2, 2, 1, 1, 2, 2)}
