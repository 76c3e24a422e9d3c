"""Backtest files made from the strategy table, and the values in them that break the published rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.backtest_file import backtest_errors
from tickloom.plans.queries import QUERY
from tickloom.plans.reports import _strategies
from tickloom.run import Run

FIGURES = {"winRate": "win_rate", "avgExcess": "avg_excess", "medianExcess": "median_excess", "avgReturn": "avg_return", "mdd": "mdd"}


def _files(spark: SparkSession, d: str | Run) -> DataFrame:
    """id and json: a file for each cell of the strategy table, some with a value that a file must not have."""
    t = _strategies(spark, d)
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))

    def an_object(**fields: Column) -> Column:
        parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]  # an absent field is a null column
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    days, quality, basis = F.col("days"), F.col("quality"), F.col("basis")
    when = lambda c, bad, good: F.when(c, F.lit(bad)).otherwise(good)
    held = an_object(days=number("days"), signals=number("signals"), **{k: when(days == 20, '"n/a"', number(c)) if k == "winRate" else number(c) for k, c in FIGURES.items()})
    strategy = an_object(
        key=text(F.col("strategy")), sample=text(F.col("sample")), basis=text(basis), relaxedShare=number("relaxed_share"), signalQuality=F.when(quality != "normal", text(quality)),
        byHolding=when((days == 60) & (basis == "top5"), '"none"', F.concat(F.lit("["), held, F.lit("]"))),
    )
    config = an_object(
        dataFrom=F.lit("null"), dataTo=F.lit('"2000-01-01"'), stepDays=when((F.col("sample") == "in") & (days == 5), "null", F.lit("5")), holdingDays=F.lit("[5,20,60]"), warmupDays=F.lit("252"),
        splitDate=F.lit("null"), benchmark=F.lit('"equal weight"'), topN=F.lit("5"), overlapFactor=when(days == 90, '{"20":4,"60":"12"}', F.lit('{"20":4}')),
    )
    regimes = an_object(strategyKey=text(F.col("strategy")), sample=text(F.col("sample")), regime=F.lit('"sideways"'), byHolding=F.lit("[]"))
    version = F.when(F.col("strategy") == "trend", "2").when(F.col("strategy") == "consensus_1star", "9").otherwise("4")
    whole = an_object(
        schemaVersion=version, generatedAt=F.lit('"2000-01-01"'), config=config, strategies=F.concat(F.lit("["), strategy, F.lit("]")),
        fundamentalAxis=F.when(quality == "relaxed", "null").when((basis == "allSignals") & (days == 5), '{"note":"","coveredFrom":null,"byVerdict":[{"verdict":"pass","byHolding":[{}]},7]}'),
        regimeAxis=F.when(days == 120, F.concat(F.lit("["), regimes, F.lit("]"))), hurdleIntersection=F.lit("null"),
    )
    return t.select(F.concat_ws("/", "strategy", "sample", "basis", "quality", "days").alias("id"), when((days == 90) & (quality == "relaxed"), "[", whole).alias("json"))


QUERIES: dict[str, QUERY] = {"backtest_file_errors": lambda spark, d: backtest_errors(_files(spark, d))}
