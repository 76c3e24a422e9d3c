"""Signals and their forward performance. Only this module looks at later bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import HORIZONS, STRATEGIES
from tickloom.functions.exprs import by, half_up
from tickloom.operators.paths import ahead


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """ticker, date, days, ret: close `days` bars later against close; rows only where that bar exists."""
    ahead = bars.select("ticker", "date", *[(F.lead("close", h).over(by()) / F.col("close") - 1).alias(f"r{h}") for h in horizons])
    cols = [F.struct(F.lit(h).alias("days"), F.col(f"r{h}").alias("ret")) for h in horizons]
    return ahead.select("ticker", "date", F.explode(F.array(*cols)).alias("x")).select("ticker", "date", "x.days", "x.ret").filter("ret IS NOT NULL")


def benchmark(forward: DataFrame) -> DataFrame:
    """date, days, bench: equal-weight mean over the tickers with a bar on that date."""
    return forward.groupBy("date", "days").agg(F.avg("ret").alias("bench"))


def drawdowns(bars: DataFrame, signals: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """eval_date, ticker, days, mdd: largest fall from a running peak on the path from signal to exit."""
    at = bars.select("ticker", F.col("date").alias("eval_date"), F.col("idx").alias("at"))
    path = ahead(signals.select("eval_date", "ticker").distinct().join(at, ["ticker", "eval_date"]), bars, "at", 0, max(horizons), ["close"])
    w = Window.partitionBy("eval_date", "ticker").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("top", F.max("a_close").over(w)).withColumn("mdd", F.max((F.col("top") - F.col("a_close")) / F.col("top")).over(w))
    return path.filter(F.col("offset").isin(*horizons)).select("eval_date", "ticker", F.col("offset").alias("days"), "mdd")


def signals(trend: DataFrame, template: DataFrame, both: DataFrame) -> DataFrame:
    """eval_date, ticker, strategy, rank, relaxed: passers only, ranked anew; the consensus is one list over both grades."""
    again = F.row_number().over(Window.partitionBy("eval_date").orderBy("rank"))
    t = trend.filter("signal").select("eval_date", "ticker", F.lit(STRATEGIES[0]).alias("strategy"), again.alias("rank"), (F.col("level") != "strict").alias("relaxed"))
    m = template.select("eval_date", "ticker", F.lit(STRATEGIES[1]).alias("strategy"), "rank", (F.col("level") != "strict").alias("relaxed"))
    grade = F.when(F.col("stars") == 2, STRATEGIES[2]).otherwise(STRATEGIES[3])
    return t.unionByName(m).unionByName(both.select("eval_date", "ticker", grade.alias("strategy"), "rank", "relaxed"))


def performance(s: DataFrame, forward: DataFrame, bench: DataFrame, falls: DataFrame) -> DataFrame:
    """s by length with ret, bench, excess and mdd."""
    j = s.join(forward.withColumnRenamed("date", "eval_date"), ["eval_date", "ticker"])
    j = j.join(bench.withColumnRenamed("date", "eval_date"), ["eval_date", "days"]).withColumn("excess", F.col("ret") - F.col("bench"))
    return j.join(falls, ["eval_date", "ticker", "days"])


def summarize(perf: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """signals, win_rate, avg_excess, median_excess, avg_return, mdd and more by keys."""
    r = lambda x: half_up(x, 4)
    return perf.groupBy(*keys).agg(
        F.count("*").alias("signals"),
        r(F.avg((F.col("excess") > 0).cast("int"))).alias("win_rate"),
        r(F.avg("excess")).alias("avg_excess"),
        r(F.expr("percentile(excess, 0.5)")).alias("median_excess"),
        r(F.avg("ret")).alias("avg_return"),
        r(F.avg("mdd")).alias("mdd"),
        *more,
    )


def with_empty_cells(summary: DataFrame, cells: dict[str, tuple]) -> DataFrame:
    """summary with a row of 0 signals for each combination of the given values that it lacks. cells: by key, its values."""
    lists = [F.array(*[F.lit(v) for v in values]) for values in cells.values()]
    grid = summary.sparkSession.range(1)
    for name, values in zip(cells, lists):
        grid = grid.withColumn(name, F.explode(values))
    full = F.broadcast(grid.drop("id")).join(summary, list(cells), "left")  # a few hundred rows, whatever the data
    return full.withColumn("signals", F.coalesce("signals", F.lit(0).cast("long")))
