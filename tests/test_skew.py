"""One customer with a third of all orders and one order with a third of all lines: same rows as SQL."""

from __future__ import annotations

import duckdb
import pytest

from outcomelens.plans.testbed import SCHEMAS

from . import oracle

SOURCE = "/root/testdata/sf0.001"
NAMES = [
    "q_staging", "q_dq_suite", "q_cohort", "q_cohort_funnel", "q_rate_profile", "q_band_validation",
    "q_split", "q_auc", "q_capture_top_frac", "q_deciles", "q_covariate_patterns",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    hot = {
        "orders": "SELECT * REPLACE (if(o_orderkey % 3 = 0, 7, o_custkey) AS o_custkey)",
        "lineitem": "SELECT * REPLACE (if(l_partkey % 3 = 0, 5, l_orderkey) AS l_orderkey)",
    }
    for name in SCHEMAS:
        path = f"{SOURCE}/{name}.parquet"
        if name in hot:
            duckdb.execute(f"COPY ({hot[name]} FROM '{path}') TO '{out}/{name}.parquet'")
        else:
            (out / f"{name}.parquet").symlink_to(path)
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, folder, name):
    oracle.check(spark, folder, name, oracle.connect(folder))
