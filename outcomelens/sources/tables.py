"""Reading text tables and typed lookups, counting what was loaded, exporting results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch


def read_text_table(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Header CSV with every column as text, so that '?' and 'V57' survive for the checks.

    ``columns`` names all columns of the file in order; without it the header does. Embedded quotes are
    doubled quotes. ``multi_line`` is only for files whose fields hold line breaks: such a file
    cannot be split between tasks.
    """
    reader = spark.read
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in columns]))
    return reader.csv(path, header=True, inferSchema=False, escape='"', multiLine=multi_line)


def read_lookup(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Header CSV with declared types, e.g. ``'admission_type_id int, description string'``."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', mode="FAILFAST")


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few driver rows (coefficients, say) as a local relation, which starts no tasks."""
    names = T.StructType.fromDDL(schema).names
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns), schema)


def load_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int] | None = None) -> DataFrame:
    """Rows per table; with ``expected``, also whether the count is the expected one (NULL: no claim)."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit((expected or {}).get(name)).cast("bigint").alias("expected_rows"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).withColumn(
        "as_expected", F.col("n_rows") == F.col("expected_rows")
    )


def load_tables(
    tables: Mapping[str, DataFrame], scratch: Scratch, expected: Mapping[str, int] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table written once, and the counts of ``load_counts``, taken while writing: no table is read a second time for them."""
    written, counts = {}, []
    for name, df in tables.items():
        rows = Observation()
        written[name] = scratch.table(df.observe(rows, F.count(F.lit(1)).alias("n_rows")), "loaded")
        counts.append((name, rows.get["n_rows"], (expected or {}).get(name)))
    if not counts:
        raise ValueError("no tables")
    session = next(iter(written.values())).sparkSession
    table = small_table(session, counts, "table_name string, n_rows bigint, expected_rows bigint")
    return written, table.withColumn("as_expected", F.col("n_rows") == F.col("expected_rows"))


def export_csv(
    tables: Mapping[str, DataFrame],
    folder: str,
    row_level: Iterable[str] = (),
    order: Mapping[str, Sequence[str | Column]] | None = None,
) -> None:
    """Aggregate tables as CSV with a header; the ``row_level`` ones as Parquet, in many files.

    A table with an ``order`` is small and becomes a single sorted file.
    """
    as_parquet, order = set(row_level), order or {}
    for name, df in tables.items():
        if name in order:
            df = df.coalesce(1).sortWithinPartitions(*order[name])
        writer = df.write.mode("overwrite")
        if name in as_parquet:
            writer.parquet(f"{folder}/{name}")
        else:
            writer.csv(f"{folder}/{name}", header=True, escape='"')
