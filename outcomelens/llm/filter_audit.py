"""What each of several filters removes, alone, in every order and beside the others.

Removing is a game of coalitions: the worth of a set of filters is the number of rows that fail one of them. A
row counts only by the set of filters it fails, so every part is summed up in a histogram of at most 2^n failure sets,
and all orders follow from the worths of its 2^n coalitions:

* a step removes the difference of the worths with and without its filter, of the filters up to it;
* the Hart-Mas-Colell potential of a coalition is its worth plus the potentials of the coalitions that lack one member,
  over its size. A filter's Shapley value is the potential of all filters minus the potential without it. Potentials times
  n! are whole numbers, and so is a Shapley value times n!: the filter's removals summed over all n! orders.

Everything is DataFrame expressions. Rows meet by text and doc_id, never by text alone, so a text that a third of all rows share
is no hot key.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .common import WORD

#: All orders of the filters become rows, n! for each part and step.
MOST_FILTERS = 6


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def quality_failures(text: Column) -> dict[str, Column]:
    """Failure conditions on a whole text; null counts as empty.

    A: under 100 words. B: under 80 % of the words distinct, case-sensitive. C: over 10 % of the code points are A-Z.
    D: holds one of ``# $ % & * |``. A text without words fails A only.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_sets(
    docs: DataFrame, scratch: Scratch, failures: dict[str, Column], part: Column, copies: str | None = None, text: str = "text"
) -> DataFrame:
    """(doc_id, part, failed, n): how many rows share a doc_id, part and set of failed filters, and their text.

    Bit k of ``failed`` is the k-th filter of ``failures``. ``copies``, if given, names one more filter, the last bit: a row fails it if a row
    of a smaller doc_id anywhere in ``docs`` has the identical text. Rows that share the smallest doc_id all pass; so does a null
    doc_id, which is smaller than none. Null texts count as empty. No rows give no rows; columns not named are not read.
    """
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(failures.values())]
    same = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = docs.select("doc_id", part.alias("part"), _sum(bits).cast("int").alias("failed"), same.alias("same"))
    rows = scratch.table(rows.groupBy("doc_id", "part", "failed", "same").agg(F.count("*").alias("n")), "failures")
    if copies is None:
        return rows.drop("same")
    first = rows.where("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("_id")).withColumnRenamed("same", "_same")
    # on both columns: the rows of one text are dealt out by their doc_id
    rows = rows.join(first, (F.col("same") == F.col("_same")) & (F.col("doc_id") == F.col("_id")), "left")
    again = F.col("doc_id").isNotNull() & F.col("_id").isNull()
    failed = F.col("failed") + F.when(again, 1 << len(failures)).otherwise(0)
    return rows.select("doc_id", "part", failed.cast("int").alias("failed"), "n")


def with_marks(rows: DataFrame, labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Adds for each mark the number of rows whose doc_id is marked: any of its labels meets the condition.

    A doc_id without a label, or a null one, is not marked, a null condition does not hold.
    """
    kept = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    marked = kept.agg(*[F.max(F.coalesce(condition, F.lit(False))).alias(f"_{name}") for name, condition in marks.items()])
    marked = marked.where(reduce(lambda a, b: a | b, [F.col(f"_{name}") for name in marks]))
    rows = rows.join(marked, F.col("doc_id") == F.col("_id"), "left")
    return rows.select(
        "doc_id", "part", "failed", "n", *[F.when(F.col(f"_{name}"), F.col("n")).otherwise(0).cast("long").alias(name) for name in marks]
    )


def interactions(rows: DataFrame, filters: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """A row per part, order of the filters and step: what the step's filter removes after those before it.

    ``rows`` has part, failed (bit k: the k-th letter of ``filters``), n and a count for each mark. Returns part, filter_order, step, filter,
    kept (after the step), removed, redundant (fail the filter, removed earlier), unique_fails (fail it only),
    ``<mark>_lost`` (removed here) and shapley (removed by the filter, summed over all orders), all counts long.
    Parts without rows do not appear; a filter that nothing fails has zeros.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or len(set(filters)) < n:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters, each with a letter of its own")
    counts = ("n", *marks)
    cells = rows.groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in counts])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("failed", *counts)).alias("cells"))  # 2^n at most

    def worth(count: str) -> Column:
        """By coalition: how many fail one of its filters."""
        add = lambda s: lambda total, cell: total + F.when(cell["failed"].bitwiseAND(s) != 0, cell[count]).otherwise(0)
        every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
        return F.transform(every, lambda s: F.aggregate("cells", F.lit(0).cast("long"), add(s)))

    def at(values: Column, coalition: Column) -> Column:
        return F.element_at(values, (coalition + 1).cast("int"))

    def potential(found: Column, s: Column) -> Column:
        """Appends the potential of coalition s; those with a member less stand before it."""
        less = [F.when(s.bitwiseAND(1 << k) != 0, at(found, s - (1 << k))).otherwise(0) for k in range(n)]
        return F.array_append(found, F.call_function("div", at(F.col("w_n"), s) * factorial(n) + _sum(less), F.bit_count(s).cast("long")))

    everything = F.aggregate("cells", F.lit(0).cast("long"), lambda total, cell: total + cell["n"])
    parts = parts.select("part", everything.alias("all"), *[worth(c).alias(f"w_{c}") for c in counts])
    coalitions = F.sequence(F.lit(1), F.lit((1 << n) - 1))
    parts = parts.withColumn("p", F.aggregate(coalitions, F.array(F.lit(0).cast("long")), potential))

    orders = F.array(*[F.lit("".join(order)) for order in permutations(filters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda k: F.pow(F.lit(2), F.instr(F.lit(filters), F.substring("filter_order", k, 1)) - 1).cast("int")
    before = _sum([F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, n + 1)])
    own = _sum([F.when(F.col("step") == k, bit(k)).otherwise(0) for k in range(1, n + 1)])
    steps = steps.withColumn("before", before).withColumn("own", own).withColumn("after", F.col("before") + F.col("own"))
    grand = F.lit((1 << n) - 1)
    w = F.col("w_n")
    lost = lambda c: at(F.col(f"w_{c}"), F.col("after")) - at(F.col(f"w_{c}"), F.col("before"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.expr("substring(filter_order, step, 1)").alias("filter"),
        (F.col("all") - at(w, F.col("after"))).alias("kept"),
        lost("n").alias("removed"),
        (at(w, F.col("own")) - lost("n")).alias("redundant"),
        (at(w, grand) - at(w, grand - F.col("own"))).alias("unique_fails"),
        *[lost(mark).alias(f"{mark}_lost") for mark in marks],
        (at(F.col("p"), grand) - at(F.col("p"), grand - F.col("own"))).alias("shapley"),
    )
