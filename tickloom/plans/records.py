"""Queries on records of fundamentals and research, reasons in words, and shares of portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import PRESETS, STRATEGIES
from tickloom.functions.exprs import half_up
from tickloom.operators import fundamentals, portfolio, reasons, screening, validation
from tickloom.plans import queries
from tickloom.plans.queries import QUERY, _lists, _snapshot
from tickloom.sources.bars import bars, quarters, table


def _trend_reasons(preset: str) -> QUERY:
    def query(spark: SparkSession, d: str) -> DataFrame:
        s = _snapshot(spark, d)[1]
        return reasons.trend_reasons(screening.trend_recommend(s, PRESETS[preset]), s, PRESETS[preset])

    return query


def _template_reasons(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshot(spark, d)[1]
    return reasons.template_reasons(screening.template_recommend(s), s)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return fundamentals.missing(fundamentals.metrics(quarters(spark, d)))


def _missing(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("ticker", "quarters", F.concat_ws(",", "missing").alias("missing"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """id, json: a record a ticker, with a ROE in quotes, a quarter without its period, or an unknown code, by the length of its name."""
    odd = F.length("ticker") % 4
    period = F.concat(F.floor(F.col("qn") / 4).cast("string"), F.lit("-Q"), (F.col("qn") % 4 + 1).cast("string"))
    quarter = F.struct("rn", F.when((odd != 1) | (F.col("rn") != 1), period).alias("period"), "eps", "revenue", F.col("operating_margin").alias("operatingMargin"))
    listed = quarters(spark, d).groupBy("ticker").agg(F.array_sort(F.collect_list(quarter)).alias("quarters"))  # five at most
    m = _metrics(spark, d).drop("quarters").join(listed, "ticker")
    codes = F.when(odd == 2, F.array_append("missing", F.lit("F9"))).otherwise(F.col("missing"))

    def json(roe: Column) -> Column:
        named = {"epsGrowthQoQ_yoy": "eps_yoy", "epsAccelerating": "accelerating", "revenueGrowthQoQ_yoy": "revenue_yoy", "marginImproving": "margin_up"}
        return F.to_json(F.struct("ticker", *[F.col(c).alias(k) for k, c in named.items()], roe.alias("roe"), "quarters", codes.alias("missing")), {"ignoreNullFields": "false"})

    return m.select(F.col("ticker").alias("id"), F.when(odd == 0, json(F.col("roe").cast("string"))).otherwise(json(F.col("roe"))).alias("json"))


def _research(spark: SparkSession, d: str) -> DataFrame:
    """ticker, flags, sentiment by the balances of a nation's suppliers; every fourth nation isn't researched."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation").filter("n_nationkey % 4 <> 0"), F.col("s_nationkey") == F.col("n_nationkey"))
    low, high = F.min("s_acctbal") < -900, F.max("s_acctbal") > 9900
    flags = F.array_compact(F.array(F.when(low, "lowBalance"), F.when(high, "highBalance")))
    return s.groupBy(F.col("n_name").alias("ticker")).agg(flags.alias("flags"), F.when(F.avg("s_acctbal") < 3000, "negative").otherwise("neutral").alias("sentiment"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """id, json: a note of research a supplier; by its number an unknown sentiment, no source, no signal, an unknown risk, or nothing wrong."""
    k = F.col("s_suppkey") % 5
    source = F.struct(F.col("s_name").alias("title"), F.lit("https://example.org/").alias("url"), F.lit("2001-01-02").alias("date"))
    risk = F.struct(F.when(k == 4, "weather").otherwise("other").alias("type"), F.lit("balance").alias("description"))
    note = F.struct(
        F.col("s_name").alias("ticker"), F.when(k == 1, "mixed").otherwise("neutral").alias("sentiment"), F.lit("balance").alias("summary"), F.array(F.lit("a")).alias("catalysts"), F.array().cast("array<string>").alias("risks"),
        F.lit("recommended").alias("origin"), F.when(k != 3, True).alias("signalPassed"), F.when(k == 2, F.array().cast("array<struct<title:string,url:string,date:string>>")).otherwise(F.array(source)).alias("sources"), F.array(risk).alias("riskFlags"),
    )
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.to_json(note).alias("json"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Trend signals with the state of research; the flagged ones can be hidden."""
    signals = _lists(spark, d)[0].filter("signal").select("eval_date", "ticker")
    return reasons.research_state(signals, _research(spark, d)).withColumn("shown", F.col("state") != "flagged")


def _rebalance(spark: SparkSession, d: str) -> DataFrame:
    """The trend list, whose first ticker is to have one and a half times its score of 100."""
    trend = screening.trend_recommend(_snapshot(spark, d)[1], PRESETS["default"])
    return portfolio.rebalanced(trend.select("eval_date", "ticker", F.when(F.col("rank") == 1, F.col("score") * 1.5).alias("wanted")))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' balances as stored entry prices of their nation's ticker, or of their own name, which has no bars."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    stored = s.select(key.alias("line"), F.when(key % 7 == 3, F.col("s_name")).otherwise(F.col("n_name")).alias("ticker"), F.col("s_acctbal").alias("entry_price"), F.when(key % 3 == 0, "").otherwise("2000-01-03").alias("entry_date"))
    return portfolio.kept_positions(stored, bars(spark, d).select("ticker").distinct())


def _composition(spark: SparkSession, d: str) -> DataFrame:
    """How a sample's trend signals divide over the regimes, and what they made in 20 bars."""
    t = queries.QUERIES["regime_axis"](spark, d).filter(f"strategy = '{STRATEGIES[0]}' AND basis = 'allSignals' AND days = 20").select("sample", "regime", "signals", "avg_excess")
    totals = t.groupBy("sample").agg(F.sum("signals").alias("total"))
    return t.join(totals, "sample").select("sample", "regime", "signals", half_up(F.col("signals") / F.nullif("total", F.lit(0)), 4).alias("share"), "avg_excess")


QUERIES: dict[str, QUERY] = {
    "trend_reasons": _trend_reasons("default"),
    "template_reasons": _template_reasons,
    "fundamental_reasons": lambda spark, d: reasons.fundamental_reasons(_metrics(spark, d)),
    "fundamental_missing": _missing,
    "fundamental_errors": lambda spark, d: validation.fundamental_errors(_records(spark, d)),
    "research_errors": lambda spark, d: validation.research_errors(_notes(spark, d)),
    "research_check": _checked,
    "portfolio_rebalanced": _rebalance,
    "kept_positions": _positions,
    "regime_composition": _composition,
}
