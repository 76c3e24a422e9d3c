"""Portfolios, pie buckets, plans for open positions, and changes over chart windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import ATR_STOP, STOP
from tickloom.functions.exprs import half_up

SLICES, TRAIL_KEEP, BREAK_EVEN_R, PEAK_MIN, GIVEBACK = 8, 0.85, 2, 20, 0.5
CHARTS = (21, 63, 126)


def weighted(picks: DataFrame) -> DataFrame:
    """eval_date, tickers, weighted_return, weighted_volatility; null where the weights add up to nothing."""
    w = F.greatest(F.col("weight").cast("double"), F.lit(0.0))
    mean = lambda c: half_up(F.sum(w * F.col(c)) / F.when(F.sum(w) > 0, F.sum(w)))
    return picks.groupBy("eval_date").agg(F.count("*").alias("tickers"), mean("sim_return").alias("weighted_return"), mean("volatility").alias("weighted_volatility"))


def pie(picks: DataFrame) -> DataFrame:
    """eval_date, slice, pct: all tickers up to eight, else the first seven and the rest as 'other'."""
    day = Window.partitionBy("eval_date")
    p = picks.withColumns({"n": F.count("*").over(day), "rn": F.row_number().over(day.orderBy(F.desc("weight"), "ticker")), "share": F.col("weight") / F.nullif(F.sum("weight").over(day), F.lit(0.0)) * 100})
    name = F.when((F.col("n") <= SLICES) | (F.col("rn") < SLICES), F.col("ticker")).otherwise("other")
    return p.groupBy("eval_date", name.alias("slice")).agg(half_up(F.sum("share"), 4).alias("pct"))


def rebalanced(picks: DataFrame) -> DataFrame:
    """eval_date, ticker, equal, adjusted of picks (eval_date, ticker, wanted): shares of 100, to one digit.

    At most one pick a date has a wanted share; it gets it, within 0 to 100, and the others divide the rest evenly. A
    single pick has 100 whatever is wanted; where nothing is wanted, shares are equal.
    """
    day = Window.partitionBy("eval_date")
    n, own = F.count("*").over(day), F.when(F.col("wanted").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("wanted"))))
    p = picks.withColumns({"equal": half_up(100 / n, 1), "rest": half_up((100 - F.max(own).over(day)) / F.nullif(n - 1, F.lit(0)), 1)})
    adjusted = F.when(F.col("rest").isNull(), F.col("equal")).otherwise(F.coalesce(own, "rest"))
    return p.select("eval_date", "ticker", "equal", adjusted.alias("adjusted"))


def kept_positions(positions: DataFrame, known: DataFrame) -> DataFrame:
    """Stored positions (ticker, entry_price, entry_date, ...) of known tickers with a positive finite price; an empty date is null."""
    price = F.col("entry_price")
    sound = price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < F.lit(float("inf")))
    return positions.filter(sound).join(known.select("ticker"), "ticker", "left_semi").withColumn("entry_date", F.nullif("entry_date", F.lit("")))


def plan(positions: DataFrame, f: DataFrame) -> DataFrame:
    """Plan of each position (ticker, entry_price, entry_date): return, R multiple, stops and alerts at the last bar."""
    price = F.col("entry_price")
    last = f.groupBy("ticker").agg(F.max_by(F.struct("close", "atr14"), "idx").alias("now"))
    held = positions.join(f.select("ticker", "date", F.col("close").alias("c")), "ticker").filter(F.col("date") >= F.col("entry_date"))
    held = held.groupBy("ticker", "entry_price", "entry_date").agg(F.max("c").alias("max_close"))
    p = positions.join(held, ["ticker", "entry_price", "entry_date"], "left").join(last, "ticker")
    p = p.withColumns({"ret": (F.col("now.close") - price) / price * 100, "top": (F.col("max_close") - price) / price * 100})
    r = F.col("ret") / (STOP * 100)
    return p.select(
        "ticker",
        half_up(F.col("ret")).alias("return_pct"),
        half_up(r).alias("r_multiple"),
        (r >= BREAK_EVEN_R).alias("break_even"),
        half_up(price * (1 - STOP)).alias("stop_fixed"),
        half_up(price - ATR_STOP * F.col("now.atr14")).alias("stop_atr"),
        half_up(F.col("max_close") * TRAIL_KEEP).alias("trailing"),
        half_up(F.greatest(price * (1 - STOP), F.col("max_close") * TRAIL_KEEP)).alias("effective_stop"),
        ((F.col("top") >= PEAK_MIN) & (F.col("ret") <= F.col("top") * GIVEBACK)).alias("giveback_alert"),
    )


def sparkline(bars: DataFrame) -> DataFrame:
    """ticker, bars, change_pct over the last 21, 63 and 126 bars (all of them where there are fewer)."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("idx")))
    b = bars.select("ticker", "idx", "close", back.alias("back")).filter(F.col("back") <= max(CHARTS))
    b = b.withColumn("bars", F.explode(F.filter(F.array(*[F.lit(n) for n in CHARTS]), lambda n: F.col("back") <= n)))
    change = (F.max_by("close", "idx") / F.min_by("close", "idx") - 1) * 100
    return b.groupBy("ticker", "bars").agg(half_up(F.when(F.count("*") >= 2, change)).alias("change_pct"))
