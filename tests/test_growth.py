"""Steps whose cost must follow the tables' size no faster than the tables grow."""

import datetime

import pytest
from compare import oracle, rows

from tickloom.plans import backtest_queries
from tickloom.plans.catalogue import QUERIES, SQL
from tickloom.sources import bars as source

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sums, key", [(source._suppliers, "suppkey"), (source._customers, "custkey"), (source.quarters, "custkey")])
def test_line_items_and_orders_are_summed_before_they_are_shuffled(spark, sums, key):
    shuffles = [x for x in plan(sums(spark, SF)).splitlines() if "Exchange hashpartitioning" in x]
    assert shuffles and not [x for x in shuffles if key in x]


@pytest.mark.parametrize("name", ["bars", "quarters"])
def test_many_keys_give_the_same_sums(spark, monkeypatch, name):
    """Beyond the bound on broadcast keys rows are shuffled by key."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(source, "BROADCAST_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, SF)
        assert "suppkey" in plan(df) or "custkey" in plan(df)
        assert rows(df.toPandas()) == rows(oracle(SF, SQL[name]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_odd_rows_of_line_items(spark, monkeypatch):
    """Unknown, absent and repeated suppliers, nations without a name, and days and prices that are null."""
    day = datetime.datetime(2000, 1, 3)
    tables = {
        "lineitem": spark.createDataFrame([(1, 2.0, 1.115, day), (1, None, 2.0, day), (2, 3.0, 1.0, day), (None, 1.0, 1.0, day), (9, 1.0, 1.0, day), (3, 1.0, 1.0, day), (1, 1.0, None, None), (4, 1.0, 5.0, day)], "l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
        "supplier": spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 7), (4, None), (None, 0)], "s_suppkey long, s_nationkey int"),
        "nation": spark.createDataFrame([(0, "a", 0), (1, "b", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string"),
    }
    monkeypatch.setattr(source, "table", lambda spark, d, name: tables[name])
    got = sorted(map(tuple, source._suppliers(spark, SF).select("ticker", "pos", "sector", "date", "cents", "volume").collect()), key=repr)
    assert got == sorted([("a", 0, "r", day.date(), 312, 2), ("a", 0, "r", None, None, 1), ("b", 1, "r", day.date(), 200, 6)], key=repr)


def test_policies_share_one_pass(spark):
    """Three policies read the signals once, with their places, and the performance once."""
    arms = backtest_queries._policy_arms(spark, SF)
    scans = [x for x in plan(arms).splitlines() if "FileScan" in x and "strategy#" in x]
    assert len(scans) == 2


def test_policies_pick_in_place_of_what_they_drop(spark, monkeypatch):
    """The arms of each policy, as picked in a loop from the signals: unknown states and regimes and more than five signals a date included."""
    days, out = [datetime.date(2000, 1, k) for k in (3, 4)], []
    signals = [(d, f"t{i}", s, i + 1, i % 2 == 0, ("1", "3", None, "2")[(i + k) % 4], ("down", None)[k]) for k, d in enumerate(days) for s in ("trend", "consensus_2star", "consensus_1star") for i in range(8) if s == "trend" or (i < 3) == (s == "consensus_2star")]
    every = spark.createDataFrame(signals, "eval_date date, ticker string, strategy string, rank int, relaxed boolean, state string, regime string")
    measured = [(d, t, s, 20, "out", 0.5) for d, t, s, *_ in signals if t != "t1"]
    perf = spark.createDataFrame(measured, "eval_date date, ticker string, strategy string, days int, sample string, excess double")
    monkeypatch.setattr(backtest_queries, "_signals_with_state", lambda spark, d: every)
    monkeypatch.setattr(backtest_queries, "_sampled", lambda spark, d, df: df.selectExpr("*", "'out' AS sample"))
    monkeypatch.setattr(backtest_queries, "_perf", lambda spark, d: perf)
    keeps = {
        "relax_off_in_downturn": (("trend",), lambda s: not (s[6] == "down" and s[4])),
        "twostar_only_in_downturn": (("consensus_2star", "consensus_1star"), lambda s: not (s[6] == "down" and s[2] == "consensus_1star")),
        "actionable_only_top5": (("trend",), lambda s: s[5] in ("1", "2")),
    }
    for name, (names, keep) in keeps.items():
        for d in days:
            pool = sorted((s for s in signals if s[0] == d and s[2] in names), key=lambda s: s[3])
            for arm, picked in (("policy", [s for s in pool if keep(s)][:5]), ("baseline", [s for s in pool if s[3] <= 5])):
                out += [(name, arm, d, s[1], s[2]) for s in picked if s[1] != "t1"]
    got = backtest_queries._policy_arms(spark, SF).select("policy", "arm", "eval_date", "ticker", "strategy").collect()
    assert sorted(map(tuple, got)) == sorted(out)
