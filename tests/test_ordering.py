"""Exact positions, splits, deciles and totals against a plain sort."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from outcomelens.operators import ordering
from outcomelens.operators.evaluate import auc, capture_at, compare_scores, decile_table, roc_points, with_quantile
from outcomelens.operators.ordering import after, global_rank, order_statistics, running_totals
from outcomelens.operators.risk_model import balanced_weights
from outcomelens.operators.split import class_sizes, hash_order, stratified_split


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _hot(n: int, seed: int = 3) -> list[tuple[float, int]]:
    """A third of all rows share one score; ids are shuffled and far apart."""
    rnd = random.Random(seed)
    ids = rnd.sample(range(10**9), n)
    return [(7.0 if rnd.random() < 0.34 else round(rnd.gauss(7, 2), 1), i) for i in ids]


@pytest.mark.parametrize("fetch_limit", [1, 40, 10_000])
def test_positions_equal_a_sort(spark, fetch_limit):
    rows = _hot(6000)
    df = _frame(spark, rows, "score double, id bigint")
    places = [1, 2, 599, 600, 1999, 2500, 3000, 3333, 4500, 5999, 6000]
    found = order_statistics(df, ["score", "id"], lambda n: [(None, p) for p in places], fetch_limit=fetch_limit)
    ordered = sorted(rows)
    assert found == [ordered[p - 1] for p in places]


def test_positions_per_stratum(spark):
    rows = [(s, i, i % 3) for s, i in _hot(3000)]
    df = _frame(spark, rows, "score double, id bigint, g int")
    found = order_statistics(
        df, ["score", "id"], lambda n: [(g, size // 2) for g, size in sorted(n.items())], "g", fetch_limit=5
    )
    for g in range(3):
        part = sorted((s, i) for s, i, h in rows if h == g)
        assert found[g] == part[len(part) // 2 - 1]


def test_ids_too_large_for_a_double(spark):
    base = 2**62
    ids = [base + i for i in range(500)]
    random.Random(1).shuffle(ids)
    df = _frame(spark, [(i,) for i in ids], "id bigint")
    found = order_statistics(df, ["id"], lambda n: [(None, 1), (None, 250), (None, 500)], fetch_limit=2)
    assert found == [(base,), (base + 249,), (base + 499,)]


def test_position_out_of_range(spark):
    df = _frame(spark, [(1,)], "id bigint")
    with pytest.raises(ValueError):
        order_statistics(df, ["id"], lambda n: [(None, 2)])


def test_null_keys_are_refused(spark):
    df = _frame(spark, [(1.0, 1), (None, 2)], "score double, id bigint")
    with pytest.raises(ValueError, match="NULL"):
        order_statistics(df, ["score", "id"], lambda n: [(None, 1)])


def test_after_is_lexicographic(spark):
    df = _frame(spark, [(1, 9), (2, 1), (2, 2), (3, 0)], "a int, b int")
    later = df.where(after([F.col("a"), F.col("b")], (2, 1))).collect()
    assert sorted(map(tuple, later)) == [(2, 2), (3, 0)]


@pytest.mark.parametrize("n", [10, 11, 23, 101, 17493])
def test_decile_sizes(spark, n):
    df = spark.range(n).select(F.lit(1).alias("score"), F.col("id").alias("id"), (F.col("id") % 2).alias("y"))
    table = decile_table(with_quantile(df, "score", "id"), "decile", "y").collect()
    want = [0] * 10
    for r in range(1, n + 1):
        want[max(1, -(-10 * (r - 1) // (n - 1))) - 1] += 1
    assert [row.patients for row in table] == want
    if n == 17493:  # the published sizes
        assert want == [1750, 1749, 1749, 1749, 1750, 1749, 1749, 1749, 1749, 1750]
    assert {row.total_patients for row in table} == {n}


def test_one_row_is_one_decile(spark):
    df = _frame(spark, [(0.5, 1, 1)], "score double, id bigint, y int")
    assert with_quantile(df, "score", "id").first().decile == 1


def test_capture_cuts_ties_by_lower_id(spark):
    rows = [(5.0, 4, 1), (5.0, 2, 0), (5.0, 3, 1), (9.0, 9, 1), (1.0, 1, 1)]
    df = _frame(spark, rows, "score double, id bigint, y int")
    row = capture_at(df, "score", "y", "id", 0.6).first()  # 9, then ids 2 and 3
    assert (row.followed_up, row.events_caught, row.events) == (3, 2, 4)
    assert row.captured_share == 0.5 and row.rate_in_top == 2 / 3
    assert row.lift == 0.5 / 0.6


def test_capture_of_nothing(spark):
    df = _frame(spark, [(1.0, 1, 1), (2.0, 2, 0)], "score double, id bigint, y int")
    row = capture_at(df, "score", "y", "id", 0.2).first()
    assert (row.followed_up, row.events_caught, row.rate_in_top) == (0, 0, None)


def _auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc_by_pairs(spark, scratch):
    rnd = random.Random(5)
    rows = [(rnd.choice([0.1, 0.2, 0.2, 0.7, rnd.random()]), int(rnd.random() < 0.3)) for _ in range(400)]
    df = _frame(spark, rows, "score double, y int")
    assert auc(df, "score", "y", scratch).first().auc == pytest.approx(_auc(rows), abs=1e-12)


@pytest.mark.parametrize("range_rows", [1, 70, 100_000])
def test_running_totals_in_ranges(spark, scratch, range_rows):
    rnd = random.Random(8)
    rows = [(k * 0.5 - 100, rnd.randrange(10)) for k in range(1000)]
    df = _frame(spark, rnd.sample(rows, len(rows)), "k double, v bigint")
    totals = running_totals(df, "k", {"total": "v"}, scratch, following={"next": "v"}, range_rows=range_rows)
    got = {r.k: (r.total, r.next) for r in totals.collect()}
    total, want = 0, {}
    for (k, v), after_it in zip(rows, [*rows[1:], (None, None)], strict=True):
        total += v
        want[k] = (total, after_it[1])
    assert got == want


@pytest.mark.parametrize("range_rows", [3, 100_000])
def test_running_totals_start_anew(spark, scratch, range_rows):
    rows = [(g, float(k), k + 1) for g in "abc" for k in range(10)]
    got = running_totals(_frame(spark, rows, "g string, k double, v bigint"), "k", {"t": "v"}, scratch, "g", {"next": "v"}, range_rows)
    want = [(g, k, v, v * (v + 1) // 2, v + 1 if v < 10 else None) for g, k, v in rows]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("bad", [None, float("nan")])
@pytest.mark.parametrize("rows", [1, 400])
def test_blank_scores_are_refused(spark, scratch, monkeypatch, bad, rows):
    monkeypatch.setattr(ordering, "_RANGE", 10)
    df = _frame(spark, [(float(k), k, k % 2) for k in range(rows)] + [(bad, -1, 1)], "score double, id bigint, y int")
    for measure in (lambda: auc(df, "score", "y", scratch), lambda: roc_points(df, "score", "y", scratch), lambda: capture_at(df, "score", "y", "id", 0.5)):
        with pytest.raises(ValueError, match="NaN"):
            measure()


def test_null_outcomes_are_refused(spark, scratch):
    df = _frame(spark, [(1.0, 1, 0), (2.0, 2, None), (3.0, 3, 1)], "score double, id bigint, y int")
    with pytest.raises(ValueError, match="NULL y"):
        stratified_split(df, "id", "y")
    with pytest.raises(ValueError, match="NULL y"):
        balanced_weights(df, "y")
    with pytest.raises(Exception, match="NULL outcome"):
        auc(df, "score", "y", scratch).collect()


def test_histogram_rows_do_not_grow_with_the_map_tasks(spark):
    """What the counting step shuffles to any task is bounded by the bins, whatever the number of partitions."""
    sizes = []
    for parts in (16, 64):
        rows = spark.range(0, 40_000, 1, parts).select((F.col("id") * 7919 % 40_009).cast("double").alias("k"))
        binned = rows.select(ordering._bin(F.col("k"), 0.0, 40_008.0).alias("bin"))
        sizes.append(binned.groupBy("bin").count().count())
        found = order_statistics(rows, ["k"], lambda n: [(None, 20_000)], fetch_limit=10)
        assert found == [tuple(rows.orderBy("k").limit(20_000).agg(F.max("k")).first())]
    assert sizes[0] == sizes[1] <= ordering._BINS


def test_all_methods_share_their_passes(spark, scratch):
    rnd = random.Random(4)
    rows = [(k, int(rnd.random() < 0.3), rnd.random(), rnd.randrange(5), float(-k)) for k in range(300)]
    df = _frame(spark, rows, "id bigint, y int, a double, b int, c double")
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n in (1, 3):
        group = f"methods-{n}"
        spark.sparkContext.setJobGroup(group, group)
        scores = dict(list({"z": "a", "a": "b", "m": "c"}.items())[:n])
        table = compare_scores(df, scores, "y", "id", scratch).collect()
        jobs.append(len(tracker.getJobIdsForGroup(group)))
        assert [r.method for r in table] == list(scores)
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]
    for r, score in zip(table, ("a", "b", "c"), strict=True):
        at = {"a": 2, "b": 3, "c": 4}[score]
        assert r.auc == pytest.approx(_auc([(x[at], x[1]) for x in rows]), abs=5e-4)
        top = sorted(rows, key=lambda x: (-x[at], x[0]))[:60]
        assert r.readmissions_caught_top20_pct == pytest.approx(100 * sum(x[1] for x in top) / sum(x[1] for x in rows), abs=0.06)


def test_roc_ends_at_one(spark, scratch):
    df = _frame(spark, [(3.0, 1), (2.0, 0), (2.0, 1), (1.0, 0)], "score double, y int")
    points = sorted(map(tuple, roc_points(df, "score", "y", scratch).collect()), reverse=True)
    assert points == [(float("inf"), 0.0, 0.0), (3.0, 0.5, 0.0), (2.0, 1.0, 0.5), (1.0, 1.0, 1.0)]


def test_roc_leaves_out_collinear_points(spark, scratch, monkeypatch):
    monkeypatch.setattr(ordering, "_RANGE", 2)
    rows = [(9.0, 1), (8.0, 1), (7.0, 1), (6.0, 0), (5.0, 0), (4.0, 1), (4.0, 0), (3.0, 1), (3.0, 0), (2.0, 0)]
    points = sorted(map(tuple, roc_points(_frame(spark, rows, "s double, y int"), "s", "y", scratch).collect()), reverse=True)
    assert [p[0] for p in points] == [float("inf"), 9.0, 7.0, 5.0, 3.0, 2.0]


def test_class_sizes_share_out_the_total():
    sizes = class_sizes({0: 63693, 1: 6277}, 0.25)
    assert sum(sizes.values()) == 17493
    assert sizes == {0: 15924, 1: 1569}


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(4001).select("id", (F.col("id") % 9 == 0).cast("int").alias("y"))
    one = stratified_split(df, "id", "y").where("is_test")
    two = stratified_split(df.repartition(7), "id", "y").where("is_test")
    ids = sorted(r.id for r in one.collect())
    assert ids == sorted(r.id for r in two.collect())
    assert len(ids) == 1001
    order = {r.id: r.h for r in df.select("id", hash_order("id", 42).alias("h")).collect()}
    for y, size in class_sizes({0: 3556, 1: 445}, 0.25).items():
        members = sorted((i for i in range(4001) if (i % 9 == 0) == bool(y)), key=lambda i: (order[i], i))
        assert sorted(members[:size]) == [i for i in ids if (i % 9 == 0) == bool(y)]


INF = math.inf


def _infinite(n: int = 6000, seed: int = 9) -> list[tuple[float, int, int]]:
    """A seventh of all scores is infinite, some are minus infinite."""
    rnd = random.Random(seed)
    scores = [INF if k % 7 == 0 else -INF if k % 50 == 1 else round(rnd.gauss(0, 5), 1) for k in range(n)]
    return [(s, i, int(rnd.random() < 0.2)) for s, i in zip(scores, rnd.sample(range(10**6), n), strict=True)]


@pytest.mark.parametrize("fetch_limit", [1, 2000])
def test_infinite_scores_end(spark, fetch_limit):
    rows = _infinite()
    df = _frame(spark, rows, "score double, id bigint, y int")
    places = [1, 100, 121, 2500, 5142, 5143, 5999, 6000]
    found = order_statistics(df, ["score", "id"], lambda n: [(None, p) for p in places], fetch_limit=fetch_limit)
    ordered = sorted((s, i) for s, i, _ in rows)
    assert found == [ordered[p - 1] for p in places]
    only = _frame(spark, [(INF, k) for k in range(3000)] + [(-INF, 5000)], "score double, id bigint")
    assert order_statistics(only, ["score", "id"], lambda n: [(None, 1), (None, 2), (None, 3001)]) == [(-INF, 5000), (INF, 0), (INF, 2999)]


def test_evaluation_with_infinite_scores(spark, scratch):
    rows = _infinite()
    df = scratch.table(_frame(spark, rows, "score double, id bigint, y int"))
    top = sorted(rows, key=lambda r: (-r[0], r[1]))[: int(len(rows) * 0.2)]
    caught = capture_at(df, "score", "y", "id", 0.2).first()
    assert (caught.followed_up, caught.events_caught) == (len(top), sum(r[2] for r in top))
    tenths = {r.id: r.decile for r in with_quantile(df, "score", "id").collect()}
    ordered = [i for _, i, _ in sorted(rows)]
    assert [tenths[i] for i in ordered] == sorted(tenths.values())
    assert [r.patients for r in decile_table(with_quantile(df, "score", "id"), "decile", "y").collect()] == [600] * 10
    compared = compare_scores(df, {"m": "score"}, "y", "id", scratch).first()
    assert 0 < compared.auc < 1


@pytest.mark.parametrize("range_rows", [None, 100])
def test_global_rank_is_a_sort(spark, scratch, range_rows):
    rows = _infinite(3000) + [(math.nan, 10**7, 1), (None, 10**7 + 1, 0)]
    df = _frame(spark, rows, "score double, id bigint, y int").repartition(5)
    got = global_rank(df, ["score", "id"], scratch, "place", {"upto": "y"}, range_rows).collect()
    key = lambda r: (r[0] is not None, r[0] is not None and math.isnan(r[0]), 0 if r[0] is None or math.isnan(r[0]) else r[0], r[1])
    total, want = 0, {}
    for place, row in enumerate(sorted(rows, key=key), 1):
        total += row[2]
        want[row[1]] = (place, total)
    assert {r.id: (r.place, r.upto) for r in got} == want


def test_global_rank_orders_as_told_and_splits_ties(spark, scratch):
    rows = [("b" if k % 3 else None, k) for k in range(900)]
    df = _frame(spark, rows, "name string, id int")
    got = global_rank(df, [F.col("name").asc_nulls_last()], scratch, range_rows=100)
    ranges = spark.read.parquet(next(p for p in scratch.paths if "ranges" in p)).groupBy("_range").count().collect()
    assert max(r["count"] for r in ranges) < 300  # a range has about 100, however many are equal
    assert sorted(r.rank for r in got.collect()) == list(range(1, 901))
    assert {r.rank for r in got.where("name is null").collect()} == set(range(601, 901))
    assert global_rank(df.where("id < 0"), ["id"], scratch).count() == 0


def test_bounded_curves(spark, scratch):
    rnd = random.Random(5)
    rows = [(rnd.gauss(y, 1.5), y) for y in (int(rnd.random() < 0.3) for _ in range(4000))]
    df = scratch.table(_frame(spark, rows, "score double, y int"))
    n, full, tp, fp = [sum(y == k for _, y in rows) for k in (0, 1)], [(INF, 0.0, 0.0)], 0, 0
    for x, y in sorted(rows, reverse=True):
        tp, fp = tp + y, fp + 1 - y
        full.append((x, tp / n[1], fp / n[0]))
    for steps in (10, 40):
        cut = sorted(map(tuple, roc_points(df, "score", "y", scratch, steps).collect()), reverse=True)
        assert set(cut) <= set(full) and len(cut) <= 2 * steps + 2 and cut[0] == full[0] and cut[-1] == full[-1]
        assert max(min(max(abs(a[1] - b[1]), abs(a[2] - b[2])) for b in cut[1:]) for a in full[1:]) <= 1 / steps
    few = scratch.table(df.withColumn("score", F.round("score", 0)))
    assert roc_points(few, "score", "y", scratch, 40).count() == roc_points(few, "score", "y", scratch).count()
