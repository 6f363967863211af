from __future__ import annotations

import json
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from outcomelens.functions import band_midpoint, keep_levels, round_half_away, round_half_even
from outcomelens.operators.levels import distinct_levels, top_level_names
from outcomelens.functions import map_codes
from outcomelens.operators.lookups import Lookup, attach_groups, attach_labels, mark_orphans
from outcomelens.sources import Scratch, load_counts, load_tables, read_stacked, read_text_table, report_payload, split_stacked
from outcomelens.sources.scratch import shared_folder

STACKED = (
    "type_id,description\r\n1,Emergency\r\n2,\"Urgent, soon\"\r\n,\r\n"
    "exit_id,description\n1,Home\n\n2,\"to \"\"care\"\"\"\n,\n"
    "source_id,description\n9,Not Available\n\n"
)


def test_text_table_keeps_text(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('id,code,note\n007,V57,"say ""hi"", then go"\n8,?,\n')
    rows = [tuple(r) for r in read_text_table(spark, str(path), ["id", "code", "note"]).collect()]
    assert rows == [("007", "V57", 'say "hi", then go'), ("8", "?", None)]


def test_line_breaks_in_fields(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('id,note\n1,"two\nlines"\n')
    rows = read_text_table(spark, str(path), ["id", "note"], multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines")]


def test_stacked_file(spark, tmp_path, scratch):
    path = tmp_path / "ids.csv"
    path.write_bytes(STACKED.encode())
    rows = read_stacked(spark, str(path), ["type", "exit", "source"], "id int, description string", scratch).collect()
    assert sorted(map(tuple, rows)) == [
        ("exit", 1, "Home"),
        ("exit", 2, 'to "care"'),
        ("source", 9, "Not Available"),
        ("type", 1, "Emergency"),
        ("type", 2, "Urgent, soon"),
    ]


def test_load_counts(spark):
    rows = load_counts({"a": spark.range(3), "b": spark.range(0)}, {"a": 4}).collect()
    assert [tuple(r) for r in rows] == [("a", 3, 4, False), ("b", 0, None, None)]


def test_scratch_tables_go_with_the_block(spark):
    with Scratch(spark) as scratch:
        assert scratch.table(spark.range(5), "five").count() == 5
        path = scratch.paths[0]
        assert path.startswith(shared_folder(spark)) and os.path.exists(path)
    assert not os.path.exists(path)


def test_scratch_tables_can_go_early(spark, scratch):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = scratch.table(spark.range(4).groupBy("id").count())
    scratch.table(spark.range(3))
    path = scratch.paths[-1]
    scratch.release(path)
    assert not os.path.exists(path) and path not in scratch.paths and kept.count() == 4
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


@pytest.mark.parametrize("configured", ["hdfs:///shared/", None])
def test_shared_folder(configured):
    """The cluster's folder, or one in the warehouse, which is shared as well; never a machine's own."""
    made = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    conf = {"spark.checkpoint.dir": configured, "spark.sql.warehouse.dir": "hdfs:///warehouse/"}
    session = SimpleNamespace(conf=conf, sparkContext=context)
    folder = shared_folder(session)
    assert folder == ("hdfs:///shared" if configured else "hdfs:///warehouse/_scratch")
    assert made == ([] if configured else [folder])


def test_payload(spark):
    kpi = spark.createDataFrame([(6, 16.67)], "patients bigint, rate double")
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "step int, name string")
    payload = json.loads(report_payload(spark, {"kpi": kpi}, {"funnel": (rows, ["step"])}).first().payload)
    assert payload == {
        "kpi": {"patients": 6, "rate": 16.67},
        "funnel": [{"step": 1, "name": "a"}, {"step": 2, "name": "b"}],
    }


def test_repeated_lookup_key_does_not_multiply_rows(spark):
    fact = spark.createDataFrame([("1",), ("2",), ("5",), (None,)], "code string")
    table = spark.createDataFrame([(1, "x"), (1, "a"), (2, None)], "id int, description string")
    lookup = Lookup(table, "id", F.col("code").cast("int"))
    rows = sorted(map(tuple, attach_labels(fact, {"label": lookup}).collect()), key=repr)
    assert rows == [("1", "a"), ("2", None), ("5", None), (None, None)]
    flags = {r.code: r.miss for r in mark_orphans(fact, [lookup], "miss").collect()}
    assert flags == {"1": False, "2": False, "5": True, None: True}


def test_levels(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("c",), (None,)], "x string")
    assert top_level_names(df, "x", 2) == ["b", "a"]
    assert distinct_levels(df, ["x"]) == {"x": ["a", "b", "c"]}
    with pytest.raises(ValueError):
        distinct_levels(df, ["x"], max_levels=2)
    kept = [r[0] for r in df.select(keep_levels(F.col("x"), ["b"])).collect()]
    assert kept == ["b", "b", "Other", "Other", "Other"]


@pytest.mark.parametrize(
    "x, away, even",
    [(1.005, 1.0, 1.0), (0.125, 0.13, 0.12), (2.675, 2.68, 2.68), (-0.125, -0.13, -0.12), (8.97, 8.97, 8.97)],
)
def test_rounding(spark, x, away, even):
    import duckdb
    import numpy as np

    row = spark.range(1).select(round_half_away(F.lit(x), 2), round_half_even(F.lit(x), 2)).first()
    assert tuple(row) == (away, even)
    assert row[0] == duckdb.sql(f"SELECT round({x}::DOUBLE, 2)").fetchall()[0][0]
    assert row[1] == np.round(x, 2)


def test_band_without_bound_fails(spark):
    df = spark.createDataFrame([("70+",)], "age string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(band_midpoint(F.col("age"))).collect()


@pytest.mark.parametrize("split", ["128m", "300"])
def test_stacked_files_over_many_splits(spark, tmp_path, scratch, split):
    """Sections, headers and lines do not depend on where a file is cut; empty sections are skipped and odd ones left out."""
    rnd, want = random.Random(4), []
    for name in ("one.csv", "two.csv"):
        text = ""
        for k, section in enumerate(["type", "exit", "source", None]):
            if name == "two.csv" and k == 1:
                text += " \n\n,\n"  # nothing in it: the next section takes its name
            text += f"\n{section}_id,description\r\n"
            for j in range(rnd.randrange(1, 90)):
                text += f'{j},"{section} ""{j}"""' + rnd.choice(["\n", "\r\n", "\n\n"])
                if section:
                    want.append((name, section, j, f'{section} "{j}"'))
            text += ",\n" if section else ""
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = read_stacked(spark, str(tmp_path), ["type", "exit", "source"], "id int, description string", scratch, keep_file=True).collect()
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((os.path.basename(r[0]), *r[1:]) for r in got) == sorted(want)
    assert tasks > 10 if split == "300" else tasks <= 4


def test_stacked_lines_that_do_not_fit_raise(spark, tmp_path, scratch):
    (tmp_path / "ids.csv").write_text("id,description\nx,y\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_stacked(spark, str(tmp_path), ["a"], "id int, description string", scratch).collect()


def test_the_readers_of_stacked_files_agree(spark, tmp_path, scratch):
    (tmp_path / "ids.csv").write_bytes(STACKED.encode())
    names, schema = ["type", "exit", "source"], "id int, description string"
    cells = split_stacked(spark.createDataFrame([(STACKED,)], "text string"), "text", names, schema)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, read_stacked(spark, str(tmp_path), names, schema, scratch).collect()))


def test_loaded_tables_are_counted_while_they_are_written(spark, scratch):
    written, counts = load_tables({"a": spark.range(7).repartition(3), "b": spark.range(0)}, scratch, {"a": 7})
    assert [tuple(r) for r in counts.collect()] == [("a", 7, 7, True), ("b", 0, None, None)]
    assert written["a"].count() == 7 and "LocalTableScan" in counts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_mapping_tables_do_as_the_conditions(spark, scratch, most_bytes):
    """A hot code with a third of all rows, unknown ones and NULL; repeated keys multiply nothing."""
    rows = [(k, 1 if k % 3 == 0 else k % 50 if k % 7 else None, "x") for k in range(5000)]
    fact = scratch.table(spark.createDataFrame(rows, "id int, code int, _label_ string"))
    groups = {"one": [1, 2, 3], "two": [4, 40, 99]}
    mapping = spark.createDataFrame([(c, label) for label, codes in groups.items() for c in codes] + [(1, "zz"), (None, "n")], "code int, label string")
    got = attach_groups(fact, F.col("code"), mapping, "other", "grp", scratch, most_bytes)
    want = fact.withColumn("grp", map_codes(F.col("code"), groups, "other"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_payloads_are_measured_and_in_order(spark):
    kpi, rows = spark.range(1), spark.range(2000)
    parts = {"rows": (rows, ["id"])}
    payload = report_payload(spark, {"kpi": kpi}, parts, order=["rows", "kpi"]).first().payload
    assert list(json.loads(payload)) == ["rows", "kpi"]
    with pytest.raises(ValueError, match="rows.*too large|too large.*rows"):
        report_payload(spark, {"kpi": kpi}, parts, part_bytes=1000)
    with pytest.raises(ValueError, match="order"):
        report_payload(spark, {"kpi": kpi}, parts, order=["kpi"])


def test_local_folders_are_refused_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: default if key == "spark.checkpoint.dir" else "file:/tmp/warehouse")
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None, master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
    context.master = "local[4]"
    assert shared_folder(SimpleNamespace(conf=conf, sparkContext=context)) == "file:/tmp/warehouse/_scratch"
