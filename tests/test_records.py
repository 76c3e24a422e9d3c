from pyspark.sql import functions as F

from tickloom.operators import fundamentals, portfolio, reasons, validation

GOOD = '{"ticker": "A", "epsGrowthQoQ_yoy": 1.5, "epsAccelerating": true, "revenueGrowthQoQ_yoy": null, "marginImproving": null, "roe": 1, "quarters": [{"period": "2001-Q1", "eps": null, "revenue": 3, "operatingMargin": 0.5}], "missing": ["F1"]}'


def test_errors_name_each_path(spark):
    bad = GOOD.replace('"A"', '""').replace('"roe": 1, ', "").replace('"revenue": 3', '"revenue": "3"').replace('["F1"]', '["F1", "F9", 5]')
    records = spark.createDataFrame([("good", GOOD), ("bad", bad), ("lists", GOOD.replace('["F1"]', "7")), ("broken", "{"), ("null", None)], "id string, json string")
    found = {(r.id, r.path) for r in validation.fundamental_errors(records).collect()}
    assert found == {("bad", "ticker"), ("bad", "roe"), ("bad", "quarters[0].revenue"), ("bad", "missing[1]"), ("bad", "missing[2]"), ("lists", "missing"), ("broken", ""), ("null", "")}


def test_what_the_year_leaves_unknown_stays_unknown(spark):
    """Four quarters have no yearly growth: two of three conditions are unknown in each of them."""
    four = [("A", n, 8000 - n, 2.0 ** (5 - n), 2.0 ** (5 - n), 0.1, 0.3) for n in range(1, 5)]
    five = [("B", n, 8000 - n, 2.0 ** (5 - n), 2.0 ** (5 - n), 0.1, 0.3) for n in range(1, 6)]
    q = spark.createDataFrame([*four, *five, ("C", 1, 7999, 1.0, 1.0, 0.1, 0.3)], "ticker string, rn long, qn long, eps double, revenue double, operating_margin double, roe double")
    got = {(r.ticker, r.verdict) for r in fundamentals.history(q).collect()}
    assert got == {("A", "insufficientFundamentals"), ("B", "pass")}
    assert {r.ticker: ",".join(r.missing) for r in fundamentals.missing(fundamentals.metrics(q)).collect()} == {"A": "F1,F3", "B": ""}


def test_shares_after_a_wish(spark):
    picks = spark.createDataFrame([(1, "A", 250.0), (1, "B", None), (2, "A", None), (2, "B", None), (2, "C", None), (3, "A", 10.0), (4, "A", 40.0), (4, "B", None), (4, "C", None)], "eval_date int, ticker string, wanted double")
    got = {(r.eval_date, r.ticker): (r.equal, r.adjusted) for r in portfolio.rebalanced(picks).collect()}
    assert got == {(1, "A"): (50, 100), (1, "B"): (50, 0), (2, "A"): (33.3, 33.3), (2, "B"): (33.3, 33.3), (2, "C"): (33.3, 33.3), (3, "A"): (100, 100), (4, "A"): (33.3, 40), (4, "B"): (33.3, 30), (4, "C"): (33.3, 30)}


def test_positions_without_a_sound_price_go(spark):
    stored = spark.createDataFrame([("A", 1.0, ""), ("A", 0.0, "x"), ("A", float("nan"), "x"), ("A", float("inf"), "x"), ("A", None, "x"), ("B", 1.0, "x"), ("A", 2.0, "d")], "ticker string, entry_price double, entry_date string")
    kept = portfolio.kept_positions(stored, spark.createDataFrame([("A",)], "ticker string"))
    assert {tuple(r) for r in kept.collect()} == {("A", 1.0, None), ("A", 2.0, "d")}


def test_states_of_research(spark):
    research = spark.createDataFrame([("A", ["x"], None), ("B", [], "negative"), ("C", None, None)], "ticker string, flags array<string>, sentiment string")
    got = reasons.research_state(spark.createDataFrame([(t,) for t in "ABCD"], "ticker string"), research)
    assert {r.ticker: r.state for r in got.collect()} == {"A": "flagged", "B": "flagged", "C": "ok", "D": "none"}


def test_fundamental_reasons_sign_and_mark(spark):
    m = spark.createDataFrame([("A", -0.3, 25.4, 0.17), ("B", None, None, None)], "ticker string, eps_yoy double, revenue_yoy double, roe double")
    got = {r.ticker: r.reasons for r in reasons.fundamental_reasons(m).orderBy(F.col("ticker")).collect()}
    assert got == {"A": "EPS -0% ✗, 매출 +25% ✓, ROE 17% ✓", "B": "EPS 성장률 판정불가, 매출 성장률 판정불가, ROE 판정불가"}


NOTE = '{"ticker": "A", "sentiment": "neutral", "summary": "s", "catalysts": [], "risks": ["r"], "analystView": null, "origin": "userRequested", "sources": [{"title": "t", "url": "u", "date": "d"}], "riskFlags": []}'


def test_research_rules(spark):
    wrong = {
        "good": NOTE,
        "recommended": NOTE.replace("userRequested", "recommended"),
        "lists": NOTE.replace('["r"]', "[1]").replace('"riskFlags": []', '"riskFlags": [{"type": "other"}]'),
        "source": NOTE.replace('"url": "u"', '"url": "", "operatorProvided": 1'),
        "view": NOTE.replace('"analystView": null', '"analystView": 3, "signalPassed": null'),
    }
    got = {(r.id, r.path) for r in validation.research_errors(spark.createDataFrame(list(wrong.items()), "id string, json string")).collect()}
    assert got == {("recommended", "signalPassed"), ("lists", "risks"), ("lists", "riskFlags[0].description"), ("source", "sources[0].url"), ("source", "sources[0].operatorProvided"), ("view", "analystView"), ("view", "signalPassed")}
