"""Runs, their arguments, lists of holdings, universe files, and results that replace one another whole."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tickloom.plans import queries, universes
from tickloom.run import Run, from_arguments, run_of
from tickloom.sources import publish, universe
from tickloom.sources.stage import shared_folder

SF = "/root/testdata/sf0.01"


def test_tickers_of_lists(spark):
    raw = [" abc (W/I) *", "", "brk.b", "X**", "Y* (note) ", "(w/i)", "\tq \n", "A (1) (2)", "Z(", None]
    want = ["ABC (W/I)", "", "BRK.B", "X", "Y", "", "Q", "A (1)", "Z(", None]
    got = spark.createDataFrame(list(enumerate(raw)), "i int, t string").orderBy("i").select(universe.normalised(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in got] == want


def test_constituents_fall_back(spark):
    lines = [(1, "abc*", "", "", None), (2, "ABC", "twice", "s", "NASDAQ"), (3, "(w/i)", "n", "s", ""), (4, "d", None, None, "nasdaq gs"), (5, "e", "n", "s", "LSE"), (6, " ", "n", "s", "LSE"), (7, None, "n", "s", None)]
    kept, out = universe.constituents(spark.createDataFrame(lines, "line int, ticker string, name string, sector string, exchange string"))
    assert sorted(map(tuple, kept.collect())) == [("ABC", "ABC", "Unknown"), ("D", "D", "Unknown")]
    assert [r["ticker"] for r in out.collect()] == ["e"]


def test_arguments():
    assert from_arguments(["--data=/x", "bars"]) == (Run("/x"), ["bars"], None)
    run, names, out = from_arguments(["--data=/x", "--universe=customers", "--step=1", "--horizons=5,20", "--out=/o", "a", "b"])
    assert run == Run("/x", "customers", 1, horizons=(5, 20)) and names == ["a", "b"] and out == "/o"
    for bad in (["bars"], ["--data=/x", "--step=0", "--out=/o"], ["--data=/x", "--step=11", "--out=/o"], ["--data=/x", "--step=2.5", "--out=/o"], ["--data=/x", "--step=1"], ["--data=/x", "--what=1"], ["--data=/x", "--horizons=20,5"], ["--data=/x", "--universe="]):
        with pytest.raises(ValueError):
            from_arguments(bad)
    assert run_of("/x") == Run("/x") and hash(Run("/x")) == hash(run_of("/x"))


def test_runs_share_no_tables(spark):
    """A run of another step isn't answered from the tables of the first; nor is another universe."""
    usual = queries._dates(spark, SF).count()
    daily = queries._dates(spark, dataclasses.replace(run_of(SF), step=1)).count()
    assert daily > 4 * usual > 0
    first, second = (queries._priced(spark, universes.in_universe(SF, u)).agg(F.sum("close")).first()[0] for u in ("suppliers", "customers"))
    assert first != second


def test_comparison_keeps_cells_of_either_side(spark):
    figures = ", ".join(f"{c} double" for c in universes.FIGURES)
    a = spark.createDataFrame([("x", 3, *[0.1] * 5), ("y", 2, *[0.2] * 5)], f"k string, signals long, {figures}")
    b = spark.createDataFrame([("x", 5, *[0.4] * 5), ("z", 1, *[0.3] * 5)], f"k string, signals long, {figures}")
    got = {r["k"]: r for r in universes.compared({"a": a, "b": b}, ["k"]).collect()}
    assert got.keys() == {"x", "y", "z"} and got["x"]["win_rate_delta"] == 0.3 and got["y"]["signals_b"] is None and got["z"]["mdd_delta"] is None and got["z"]["mdd_b"] == 0.3


def test_universe_files_keep_places_and_bars(spark):
    path = f"{shared_folder(spark)}/test-universe-{id(spark)}"
    b = queries._priced(spark, "/root/testdata/sf0.001")
    universe.write_universe(b, path)
    back = universe.read_universe(spark, path, lines=True)
    columns = ["ticker", "sector", "pos", "idx", "date", "open", "high", "low", "close", "volume"]
    assert back.select(*columns).exceptAll(b.select(*columns)).count() == 0 and back.count() == b.count()
    one = '{"tickers": [{"ticker": "b", "sector": "s", "series": [{"date": "2020-01-01", "close": 1.5}]}, {"ticker": "a", "series": [null, {}]}]}'
    spark.createDataFrame([(one,)], "value string").coalesce(1).write.mode("overwrite").text(path + "-one")
    assert sorted((r["ticker"], r["pos"], r["idx"]) for r in universe.read_universe(spark, path + "-one").collect()) == [("a", 1, 0), ("a", 1, 1), ("b", 0, 0)]


def test_results_replace_one_another_whole(spark):
    path = f"{shared_folder(spark)}/test-published-{id(spark)}/table"
    schema = "k int, v string"
    first, second = (spark.createDataFrame([(k, str(k)) for k in range(n)], schema) for n in (3, 5))
    none = lambda df: df.filter("v IS NULL")
    assert publish.published(spark, path, schema).count() == 0
    assert publish.stale(spark, path, 7).first()["stale"]
    publish.publish(first, path, none)
    assert publish.published(spark, path, schema, none).count() == 3
    with pytest.raises(ValueError):
        publish.publish(spark.createDataFrame([(1, None)], schema), path, none)
    assert publish.published(spark, path, schema).count() == 3
    with pytest.raises(Exception):
        publish.publish(second.withColumn("v", F.raise_error(F.lit("dies"))), path)
    assert publish.published(spark, path, schema).count() == 3
    publish.publish(publish.published(spark, path, schema).union(second), path)  # reads what it replaces
    assert publish.published(spark, path, schema).count() == 8
    assert publish.published(spark, path, "k string, v string").count() == 0  # other types
    assert publish.published(spark, path, schema, lambda df: df.filter("k > 3")).count() == 0  # a broken rule
    r = publish.stale(spark, path, 7).first()
    assert not r["stale"] and r["date"] is not None and publish.stale(spark, path, 7, "2999-01-01").first()["stale"]
