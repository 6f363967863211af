"""What several operators share: word counts, gapless numbering, connected components."""

from __future__ import annotations

from functools import reduce

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, for tasks that read or write files themselves."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        # Hadoop's names of the object store
        return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith(("s3a:", "s3n:")) else uri)
    return fs.LocalFileSystem(), uri


def words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; null has none. ``bytes.split`` parts at the very characters that ``WORD`` leaves out."""
    return text.encode().split() if text else []


#: Tables of at most so many bytes are broadcast, after they were measured.
SMALL = 32 << 20


def bounded(df: DataFrame) -> DataFrame:
    """Marks a table of numbers and short texts for broadcast if it was measured to be small."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    width = 24 + 8 * len(df.columns)
    size = df.agg(F.coalesce(F.sum(reduce(Column.__add__, texts, F.lit(width)).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= SMALL else df


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with a key of their own, columns ``_file`` and ``_at``, the same whenever they are read.

    For rows read from files, projected or filtered, that is a hash of the file's path and the row's place in it; all others are written
    once, with a number each.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().head()
    if node.nodeName() in ("Relation", "LogicalRelation") or node.getClass().getSimpleName() == "LogicalRelation":
        try:
            place = docs.metadataColumn("_metadata")
            return docs.select("*", F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_at"))
        except AnalysisException:  # a format without row numbers
            pass
    numbers = docs.select("*", F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return scratch.table(numbers, "keyed")


def sampled(rows: DataFrame, group: str, counts: dict, most: int, order: Column, *ties: str) -> DataFrame:
    """At most ``most`` rows of each group of ``counts`` (rows by group): those with the smallest ``order``, a hash.

    A first cut by the hash leaves about four times as many, so the task that ranks a group gets a bounded number of rows
    however many there are. Adds the rank as ``_rank``.
    """
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(group) == value, min(1.0, 4 * most / max(1, n))).otherwise(share)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_order", *ties))
    near = rows.withColumn("_order", order).where(F.pmod("_order", F.lit(1 << 20)) < share * (1 << 20))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_order")


def told_apart(rows: DataFrame, scratch: Scratch, key: list[str], most: int) -> DataFrame:
    """Adds ``_copy``: where more than ``most`` rows of a written table are equal in ``key``, their number from 0 without gaps; else 0.

    Equal rows are numbered by blocks of about ``most``, so none of them meet in one task, and which number a row gets does not matter.
    """
    equal = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    equal = equal.select(*[F.col(c).alias(f"_e{k}") for k, c in enumerate(key)], "_n", F.monotonically_increasing_id().alias("_equal"))
    equal = scratch.table(equal, "equal")
    if equal.isEmpty():
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_e{k}")) for k, c in enumerate(key)])
    equal = bounded(equal)
    parts = keyed(rows, scratch).join(equal, same).drop(*[f"_e{k}" for k in range(len(key))])
    parts = parts.withColumn("_part", F.pmod(F.xxhash64("_file", "_at"), F.ceil(F.col("_n") / most)))
    sizes = parts.groupBy("_equal", "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_equal").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("_equal").alias("_on"), F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")
    )
    place = F.row_number().over(Window.partitionBy("_equal", "_part").orderBy("_file", "_at")) - 1
    parts = parts.withColumn("_place", place).join(sizes, (F.col("_equal") == F.col("_on")) & (F.col("_part") == F.col("_of")))
    parts = parts.select(*rows.columns, (F.col("_place") + F.col("_base")).cast("long").alias("_copy"))
    return rows.join(equal, same, "left_anti").withColumn("_copy", F.lit(0).cast("long")).unionByName(parts)


def numbered(
    df: DataFrame, scratch: Scratch, groups: list[str], key: list[str], name: str, rows_per_block: int = 50_000
) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, as column ``name``.

    Rows fall into blocks by a hash of ``key``; they are numbered within their block, and a block starts
    where the ones before it end. So no task sorts a whole group, however large. The numbers depend on
    the rows only. Rows equal in ``key`` are numbered in any order; where a block's worth of them is equal, they
    are dealt out by a number each.
    """
    rows = scratch.table(df, "numbered")
    blocks = max(1, -(-rows.count() // rows_per_block))
    block = F.pmod(F.xxhash64(*key, F.lit(11)), F.lit(blocks))
    if not rows.groupBy(block).count().where(F.col("count") > 2 * rows_per_block).isEmpty():
        rows = scratch.table(told_apart(rows, scratch, [*groups, *key], rows_per_block // 2), "numbered")
        apart = F.when(F.col("_copy") > 0, F.xxhash64(*key, F.lit(11), "_copy")).otherwise(F.xxhash64(*key, F.lit(11)))
        block = F.pmod(apart, F.lit(blocks))
    rows = rows.withColumn("_block", block)
    place = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*groups, "_block")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(place), F.lit(0)))
        .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], F.col("_block").alias("_b"), "_start")
    )
    within = Window.partitionBy(*groups, "_block").orderBy(*key)
    rows = rows.withColumn("_rank", F.row_number().over(within) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups)]
    on = F.col("_block") == F.col("_b")
    for condition in same:
        on = on & condition
    return rows.join(starts, on).withColumn(name, (F.col("_start") + F.col("_rank")).cast("long")).select(*df.columns, name)


def _larger_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    return (
        edges.join(least, F.col("b") == F.col("v"))
        .select("a", F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _smaller_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to its smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.withColumnRenamed("a", "v"), F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is its smallest reachable node.

    Alternating stars: each round is two joins on the links, kept as a table, until nothing moves. Only
    the count and a checksum of the links come to the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = scratch.table(now, "links"), None
    while True:
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = scratch.table(_smaller_star(_larger_star(now)), "links")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
