"""The operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .common import WORD
from .exact_dedup import mark_duplicates
from .filter_audit import failure_sets, interactions, quality_failures, with_marks
from .html_extract import main_text
from .language_id import held_out, identify, learn
from .mixing import mix
from .ngram_join import jaccard_components
from .packing import pack
from .periodic_runs import periodic_runs, strongest
from .sharding import shard
from .substring_dedup import drop_repeats
from .toxicity import learn as learn_toxicity
from .toxicity import score as score_toxicity
from .vector_dedup import near_duplicates
from .warc import archive, page_of


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(read(spark, folder, "pages"), Scratch(spark))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    kept_back = held_out("doc_id", 4, 2)
    labelled = identify(docs.select("doc_id", "text"), learn(docs, ~kept_back))
    return labelled.select("doc_id", kept_back.alias("held_out"), "lang_pred", "score")


def op3_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "embeddings"), Scratch(spark), threshold=0.9)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    kept_back = held_out("doc_id", 5, 0)
    scored = score_toxicity(docs, learn_toxicity(docs, labels, ~kept_back))
    return scored.select("doc_id", kept_back.alias("held_out"), "score", "predicted", "spans")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive(read(spark, folder, "pages"), Scratch(spark)).select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return mark_duplicates(read(spark, folder, "documents"), Scratch(spark))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(read(spark, folder, "documents"), Scratch(spark))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(read(spark, folder, "documents"), 8, Scratch(spark))


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = jaccard_components(read(spark, folder, "documents"), Scratch(spark), n=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"), Scratch(spark))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts gets a run at a place, of a period and an exponent that a checksum of the id decides."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    # a column of its own, so that a text is split once
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    g, w, n = F.col("g"), F.col("w"), F.size("w")
    docs = docs.withColumn("a", F.when(n > 0, g % n).cast("int"))
    docs = docs.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    repeated = F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.element_at(w, a + (i - a) % p + 1)))
    return docs.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, folder, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return drop_repeats(docs, Scratch(spark)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    rows = failure_sets(docs, Scratch(spark), quality_failures(F.col("text")), F.coalesce("lang", F.lit("")), copies="E")
    rows = with_marks(rows, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return interactions(rows, "ABCDE", ("good", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_language_id": op2_language_id,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_ngram_join": op9_ngram_join,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    # all pairs, and components by what is reachable
    "op3_vector_dedup": """
        WITH RECURSIVE whole AS (
            SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings
        ), unit AS (
            SELECT vec_id, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS u FROM whole
            WHERE len(e) > 0 AND len(list_filter(e, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_dot_product(e, e) > 0
        ), link AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y
            ON x.vec_id <> y.vec_id AND len(x.u) = len(y.u) AND list_dot_product(x.u, y.u) >= 0.9
        ), reach(a, b) AS (
            SELECT a, a FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), least AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
        direct AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
               vec_id = coalesce(component, vec_id) AS kept
        FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN direct ON direct.a = vec_id
    """,
    # a base32 digit is five of the digest's 160 bits, out of two hexadecimal digits
    "op5_warc": """
        WITH payload AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS hex FROM pages
        ), digits AS (
            SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
                   array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                       (('0x' || substr(hex, 5 * i // 4 + 1, 2))::INTEGER >> (3 - i % 4)) % 32 + 1]), '') AS payload_digest
            FROM payload
        )
        SELECT page_id, payload_bytes, payload_digest, if(page_id = first, 'response', 'revisit') AS record_type,
               if(page_id = first, NULL, first) AS refers_to FROM digits
    """,
    "op9_ngram_join": """
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(list_transform(range(if(len(w) = 0, 0, greatest(1, len(w) - 3))),
                lambda i: array_to_string(w[i + 1:i + 4], ' '))) AS s FROM split
        ), shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
        link AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM shingle x JOIN shingle y ON x.v = y.v AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ), reach(a, b) AS (
            SELECT a, a FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id
        FROM sets LEFT JOIN least ON least.a = doc_id
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER texts AS keep_id, count(*) OVER texts AS group_size,
               doc_id = max(doc_id) OVER texts AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW texts AS (PARTITION BY coalesce(text, ''))
    """,
    # words that repeat q words later, in islands; one island for every (start, length), that of the smallest period.
    # The checksum is CRC-32 bit by bit, with its polynomial.
    "op11_periodic_runs": """
        WITH given AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   xor(4294967295, list_reduce(
                       list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT),
                       lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
                           lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)),
                       4294967295::BIGINT)) AS h
            FROM documents
        ), cut AS (
            SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given
        ), planted AS (
            SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
                       w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END) + 1]) END AS w
            FROM cut
        ), word AS (
            SELECT doc_id, n, unnest(w) AS v, unnest(range(n)) AS i FROM planted
        ), alike AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y
            ON x.doc_id = y.doc_id AND x.v = y.v AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
        ), island AS (
            SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM alike
        ), stretch AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, part
        ), run AS (
            SELECT doc_id, start, length, min(q) AS period FROM stretch
            WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
        ), best AS (
            SELECT * FROM run QUALIFY row_number() OVER (
                PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
        ), line AS (
            SELECT doc_id, count(*) AS n_runs,
                   string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
            FROM run GROUP BY doc_id
        ), stay AS (
            SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM word ANTI JOIN run
            ON word.doc_id = run.doc_id AND i >= start + period AND i < start + length GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM documents LEFT JOIN line USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN stay USING (doc_id)
    """,
    "op12_substring_dedup": """
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), word AS (
            SELECT doc_id, unnest(w) AS v, unnest(range(len(w))) AS i,
                   unnest(list_transform(range(len(w)), lambda i: CASE WHEN i + 20 <= len(w) THEN array_to_string(w[i + 1:i + 20], ' ') END)) AS twenty
            FROM split
        ), again AS (
            SELECT doc_id, v, i, twenty IS NOT NULL AND row_number() OVER (PARTITION BY twenty ORDER BY doc_id, i) > 1 AS repeated FROM word
        ), covered AS (
            SELECT doc_id, v, i, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM again
        ), counted AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
                   string_agg(v, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
            FROM covered GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN counted USING (doc_id)
    """,
    # every order and step by itself, from the failure sets; no potentials
    "op13_filter_audit": """
        WITH split AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), failing AS (
            SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed,
                   coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS bad
            FROM split LEFT JOIN labels USING (doc_id)
        ), cell AS (
            SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad
            FROM failing GROUP BY part, failed
        ), letter(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        ordering AS (
            SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM letter a, letter b, letter c, letter d, letter e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ), place AS (
            SELECT filter_order, step, l, bit, coalesce(sum(bit) OVER (
                       PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS before
            FROM ordering, range(1, 6) AS steps(step), letter WHERE l = substring(filter_order, step, 1)
        ), counted AS (
            SELECT part, filter_order, step::INTEGER AS step, l AS filter,
                   coalesce(sum(n) FILTER (WHERE failed & (before | bit) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (WHERE failed & before = 0 AND failed & bit > 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (WHERE failed & before > 0 AND failed & bit > 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (WHERE failed = bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (WHERE failed & before = 0 AND failed & bit > 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(bad) FILTER (WHERE failed & before = 0 AND failed & bit > 0), 0)::BIGINT AS toxic_lost
            FROM cell, place GROUP BY part, filter_order, step, l
        )
        SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM counted
    """,
}
