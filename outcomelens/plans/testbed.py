"""Raw hospital tables built from the driver's test tables: orders are the encounters.

The mapping only has to give every operator something to do. Time order within a customer is worked out on
one row per customer and day, so a customer with a third of all orders is at most one row per
calendar day in any window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixed_values as V
from .hospital import RawTables

# Declared, so that opening a table starts no job to read the schema from its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.expr("n_regionkey = r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


def _days(orders: DataFrame) -> DataFrame:
    """Per customer and day: last order, orders in the 365 days before, day of the next order."""
    daily = orders.groupBy("o_custkey", "day").agg(
        F.count("*").alias("n_orders"), F.max("o_orderkey").alias("last_key")
    )
    by_day = Window.partitionBy("o_custkey").orderBy("day")
    placed = daily.withColumns(
        {
            "prior": F.coalesce(F.sum("n_orders").over(by_day.rangeBetween(-365, -1)), F.lit(0)),
            "next_day": F.lead("day").over(by_day),
        }
    )
    # renamed above the windows: below them Spark would not see that the rows lie by customer already, and shuffle them again
    return placed.select(F.col("o_custkey").alias("d_custkey"), F.col("day").alias("d_day"), "last_key", "prior", "next_day")


# What is counted of an order's lines; a line's answers travel as the bits of one number.
_MARKS = {
    "n_returned": "l_returnflag = 'R'",
    "n_accepted": "l_returnflag = 'A'",
    "n_open": "l_linestatus = 'O'",
    "n_taxed": "l_tax > 0.04D",
}


def _lines(lineitem: DataFrame) -> DataFrame:
    """Sums and counts per order.

    Lines are dealt out by order before they are summed: a map task meets few lines of an order, so sums taken there would hold
    nearly a row per line, and spill once a task reads millions of them.
    """
    marks = " + ".join(f"if({test}, {1 << bit}, 0)" for bit, test in enumerate(_MARKS.values()))
    counted = {
        "n_lines": "count(*)",
        "quantity": "cast(sum(l_quantity) as bigint)",
        "line_numbers": "sum(l_linenumber)",
        **{name: f"count_if(marks & {1 << bit} > 0)" for bit, name in enumerate(_MARKS)},
    }
    narrow = lineitem.selectExpr("l_orderkey", "l_quantity", "l_linenumber", f"{marks} as marks")
    return narrow.repartition("l_orderkey").groupBy("l_orderkey").agg(*[F.expr(sql).alias(name) for name, sql in counted.items()])


# A diagnosis code from the price: blanks, V and E codes, decimals, letters and plain numbers.
_DIAGNOSIS = """
case when q < 10 then '?'
     when q < 30 then concat('V', q)
     when q < 50 then concat('E', q + 900)
     when q < 300 then concat('250.', lpad(q % 100, 2, '0'))
     when q < 550 then cast(q % 70 + 390 as string)
     when q < 750 then cast(q % 60 + 460 as string)
     when q < 760 then concat('459.', lpad(q % 100, 2, '0'))
     when q < 770 then concat('785.', lpad(q % 100, 2, '0'))
     when q < 780 then concat(q, 'd')
     else cast((q - 780) * 4 + 140 as string) end
"""

# Raw column -> expression over one order with its lines, its customer and its customer's other orders.
_ENCOUNTER = {
    "encounter_id": "o_orderkey",
    "patient_nbr": "o_custkey",
    "race": "if(c_mktsegment = 'FURNITURE', '?', c_mktsegment)",
    "gender": "case when c_nationkey = 0 then 'Unknown/Invalid' when c_nationkey % 2 = 1 then 'Female' else 'Male' end",
    "age": "concat('[', decade * 10, '-', decade * 10 + 10, ')')",
    "weight": "if(c_acctbal < -700, '[75-100)', '?')",
    "admission_type_id": "substring(o_orderpriority, 1, 1)",
    "discharge_disposition_id": "dayofmonth(o_orderdate)",
    "admission_source_id": "c_nationkey + 1",
    "time_in_hospital": "least(coalesce(n_lines, 0) + 1, 14)",
    "payer_code": "if(r_name in ('AFRICA', 'ASIA'), '?', n_name)",
    "medical_specialty": "if(r_name in ('AMERICA', 'EUROPE'), '?', n_name)",
    "num_lab_procedures": "coalesce(quantity, 0)",
    "num_procedures": "coalesce(n_accepted, 0)",
    "num_medications": "coalesce(line_numbers, 0)",
    "number_outpatient": "coalesce(n_taxed, 0)",
    "number_emergency": "coalesce(n_returned, 0)",
    "number_inpatient": "prior",
    "diag_1": _DIAGNOSIS,
    "number_diagnoses": "coalesce(n_open, 0) + 1",
    "A1Cresult": "case when c2 < 80 then 'None' when c2 < 87 then 'Norm' when c2 < 93 then '>7' else '>8' end",
    "insulin": "element_at(array('No', 'Steady', 'Up', 'Down'), quarter(o_orderdate))",
    "change": "if(o_orderstatus = 'F', 'Ch', 'No')",
    "diabetesMed": "if(o_orderstatus <> 'P', 'Yes', 'No')",
    "readmitted": "case when gap is null then 'NO' when gap < 30 then '<30' else '>30' end",
}

RAW_COLUMNS = V.RAW_COLUMNS


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    """One text row per order, in the columns of the hospital's raw table."""
    orders = table(spark, folder, "orders").withColumn("day", F.expr("datediff(cast(o_orderdate as date), '1970-01-01')"))
    # customer columns ride on the daily rows, which bounds what a busy customer sends through that join
    days = _days(orders).join(_customers(spark, folder), F.expr("d_custkey = c_custkey"), "left")
    lines = _lines(table(spark, folder, "lineitem"))
    joined = (
        orders.join(lines, F.expr("o_orderkey = l_orderkey"), "left")
        .join(days, F.expr("o_custkey = d_custkey and day = d_day"), "left")
        .join(_places(spark, folder), F.expr("c_nationkey = n_nationkey"), "left")
    )
    derived = joined.selectExpr(
        "*",
        "cast(round(o_totalprice * 100) as bigint) % 100 as c2",
        "cast(round(o_totalprice * 100) as bigint) div 100 % 1000 as q",
        "greatest(0, least(9, floor((c_acctbal + 1000) / 1100))) as decade",
        "if(o_orderkey < last_key, 0, next_day - day) as gap",
    )
    return derived.selectExpr(*[f"cast({sql} as string) as {name}" for name, sql in _ENCOUNTER.items()])


def raw_tables(spark: SparkSession, folder: str) -> RawTables:
    """Encounters with lookups from regions and nations; discharge codes over 25 have no match."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return RawTables(
        encounters(spark, folder),
        region.selectExpr("r_regionkey + 1 as admission_type_id", "r_name as description"),
        nation.join(region, F.expr("n_regionkey = r_regionkey")).selectExpr(
            "n_nationkey + 1 as admission_source_id", "r_name as description"
        ),
        nation.selectExpr("n_nationkey + 1 as discharge_disposition_id", "n_name as description"),
    )
