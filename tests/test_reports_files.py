"""Tables of results as lines, places of lines in files, and settings."""

from __future__ import annotations

import uuid

import pytest

from lexispark.operators import reports
from lexispark.plans import catalogue
from lexispark.sources import collection, sinks

TABLE = "name string, place int, AP double, `nDCG@10` double, old double"


def test_lines_of_a_table(spark):
    rows = [("b", 2, 0.1236, None, 0.1), ("a", 1, 0.5, 0.0625, 0.0), ("c", 3, None, 1.0, 0.5), ("d", 4, 0.2, 0.00125, None)]
    got = reports.lines(spark.createDataFrame(rows, TABLE), "place", {"place": -1, "name": -1, "AP": 2, "nDCG@10": 3}, {"AP": "old"})
    assert [r.line for r in got.orderBy("place").collect()] == [
        "| place | name | AP | nDCG@10 |", "| --- | --- | ---: | ---: |",
        "| 1 | a | 0.50 | 0.063 |",  # a change from nothing is not told
        "| 2 | b | 0.12 (+23.6%) | - |", "| 3 | c | - | 1.000 |", "| 4 | d | 0.20 | 0.001 |",
    ]
    assert [r.place for r in got.orderBy("place").collect()] == [-1, 0, 1, 2, 3, 4]


def test_an_empty_table_has_its_head(spark):
    got = reports.lines(spark.createDataFrame([], TABLE), "place", {"name": -1, "AP": 1})
    assert [r.line for r in got.orderBy("place").collect()] == ["| name | AP |", "| --- | ---: |"]


@pytest.mark.parametrize("most", ["128m", "1000"])
def test_places_of_lines(spark, tmp_path, most):
    """Lines keep their places over files and over splits of a file."""
    path = str(tmp_path / uuid.uuid4().hex)
    lines = [f"{i:05d} {'x' * (i % 90)}" if i % 13 else "" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string").repartition(5)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        sinks.write_lines(df, path, ["i"])
        assert [r.value for r in collection.placed_lines(spark, path).orderBy("place").collect()] == lines
        sinks.write_file(df, path + ".txt", ["i"])
        got = collection.placed_lines(spark, path + ".txt").orderBy("place").collect()
        assert [(r.place, r.value) for r in got] == list(enumerate(lines, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sinks.write_lines(df.limit(0), path, ["i"])
    assert collection.placed_lines(spark, path).count() == 0


def test_tables_and_settings_round_trip(spark, tmp_path):
    rows = [("a, \"b\"", 1, 0.1 + 0.2, None, -0.0), ("c", 2, 1e-17, 1 / 3, 2.0)]
    sinks.write_csv(spark.createDataFrame(rows, TABLE), str(tmp_path / "csv"))
    assert sorted(map(tuple, collection.read_table(spark, str(tmp_path / "csv"), TABLE).collect())) == rows
    sinks.write_json(spark, catalogue.REPORT_CHANGES, str(tmp_path / "json"))
    got = collection.read_config(spark, str(tmp_path / "json"), {**catalogue.REPORT, "kept": 3})
    assert got == {**catalogue.REPORT_CHANGES, "kept": 3} and list(got["decimals"]) == list(catalogue.REPORT_CHANGES["decimals"])
