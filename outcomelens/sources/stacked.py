"""Text files that stack several small CSV tables, parted by a line holding only a comma."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def split_stacked(
    files: DataFrame, text: str | Column, sections: Sequence[str], schema: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per data line: the ``keep`` columns, ``section`` and the columns of ``schema``.

    ``files`` holds one stacked file per row. Sections are named by position, empty ones skipped;
    the first line of each is its header. Each file is parsed where its row lies: no shuffle.
    """
    source = F.col(text) if isinstance(text, str) else text
    blocks = F.split(F.regexp_replace(source, "\r", ""), "\n,\n")
    blocks = F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    names = F.array(*[F.lit(name) for name in sections])

    parted = files.select(*keep, F.posexplode(blocks).alias("_place", "_block")).where(
        F.col("_place") < len(sections)
    )
    lines = parted.select(
        *keep,
        F.element_at(names, F.col("_place") + 1).alias("section"),
        F.posexplode(F.split("_block", "\n")).alias("_line_no", "_line"),
    ).where((F.col("_line_no") > 0) & (F.trim("_line") != ""))
    parsed = F.from_csv("_line", F.lit(schema), {"escape": '"', "mode": "FAILFAST"})
    return lines.withColumn("_row", parsed).select(*keep, "section", "_row.*")


def read_stacked(
    spark: SparkSession, path: str | list[str], sections: Sequence[str], schema: str, scratch: Scratch, keep_file: bool = False
) -> DataFrame:
    """The data lines of stacked files of any size: ``section`` and the columns of ``schema``; with ``keep_file`` the file's path before them.

    A line of nothing but a comma ends a section. Sections are named by position, those without text skipped, and the first line with
    text in each is its header. Lines of more sections than names are left out, blank lines too; a line that does not fit
    the schema raises an error.

    A file is read by as many tasks as it has splits. Lines are numbered within their split; a running total over the splits of a file, one row
    each, tells which section a line is in. Files need no order and no task holds one.
    """
    place = "_metadata"
    lines = spark.read.text(path).select(
        F.col(f"{place}.file_path").alias("file"),
        F.col(f"{place}.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),  # ascends within a split
        F.rtrim("value", F.lit("\r")).alias("value"),
    )
    lines = scratch.table(lines.withColumn("border", F.col("value") == ","), "lines")
    borders = lines.groupBy("file", "split").agg(F.count_if("border").alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = borders.select(
        F.col("file").alias("_file"), F.col("split").alias("_split"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("_own", F.count_if("border").over(within)).where(~F.col("border") & (F.trim("value") != ""))
    lines = lines.join(starts, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    lines = lines.select("file", "split", "line", "value", (F.col("_start") + F.col("_own")).alias("part"))
    # sections with text, their names and where their headers stand: a row each
    heads = lines.groupBy("file", "part").agg(F.min(F.struct("split", "line")).alias("head"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("part"))
    heads = heads.withColumn("number", number).where(F.col("number") <= len(sections)).select(
        F.col("file").alias("_file"), F.col("part").alias("_part"), "head", F.element_at(F.array(*map(F.lit, sections)), F.col("number")).alias("section")
    )
    data = lines.join(heads, (F.col("file") == F.col("_file")) & (F.col("part") == F.col("_part")))
    data = data.where(F.struct("split", "line") != F.col("head"))
    parsed = F.from_csv("value", F.lit(schema), {"escape": '"', "mode": "FAILFAST"})
    return data.withColumn("_row", parsed).select(*(["file"] if keep_file else []), "section", "_row.*")
