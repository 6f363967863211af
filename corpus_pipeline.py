"""The corpus pipeline: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcomelens.llm.exact_dedup import drop_duplicates
from outcomelens.llm.language_id import UNKNOWN, learn, recognised
from outcomelens.llm.mixing import mixed
from outcomelens.llm.ngram_join import drop_near_duplicates
from outcomelens.llm.packing import pack
from outcomelens.sources.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_open: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    """Tables of a stage. Those of the stage before go: its result has been written when the next stage is called."""
    while _open:
        _open.pop().drop()
    _open.append(Scratch(spark))
    return _open[-1]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: without a letter, or with no language likely. Fills missing labels in."""
    _scratch(spark)
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    kept = recognised(docs.withColumnsRenamed(own), learn(docs, F.lit(True)))
    found = F.coalesce("lang", F.nullif("lang_pred", F.lit(UNKNOWN)))
    return kept.select(*[(found if c == "lang" else F.col(own.get(c, c))).alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_duplicates(docs, _scratch(spark))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 one stays."""
    return drop_near_duplicates(docs, _scratch(spark), n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice."""
    return mixed(docs, _scratch(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in length buckets."""
    return pack(docs, _scratch(spark))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses neither the trained recogniser nor the balanced sample, so there is none for the whole.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; each stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        for path in scratch.paths[:-1]:
            scratch.release(path)
    return docs
