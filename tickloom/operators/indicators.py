"""Per-bar indicators: trailing windows over (ticker, idx). Nothing here reads a later bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import BREAKOUT_RECENCY, BUFFER, CHASE, FAR, VOL_MULT
from tickloom.functions.exprs import bars_since, by, ema, guarded, last, mean, run, wilder


def indicators(bars: DataFrame) -> DataFrame:
    c, v, h, low, idx = (F.col(x) for x in ("close", "volume", "high", "low", "idx"))
    pc, ph, pl = F.lag("close").over(by()), F.lag("high").over(by()), F.lag("low").over(by())
    up, down = h - ph, pl - low
    ratio = lambda n, prior: (mean("volume", n) - mean("volume", prior, n)) / F.nullif(mean("volume", prior, n), F.lit(0.0)) * 100
    sd = lambda n, back=0: F.stddev_samp("ret").over(last(n, back))
    anchor = lambda n: (c / F.lag("close", n - 1).over(by()) - 1) * 100
    # Sums for means, and extremes of 63 bars, from which those of 126 and 252 follow by looking back.
    f = bars.withColumns({"close_run": F.sum("close").over(run()), "volume_run": F.sum(v.cast("double")).over(run()), "_high": F.max("high").over(last(63)), "_low": F.min("low").over(last(63)), "_top": F.max("close").over(last(63))})
    f = f.withColumns({"_high": F.greatest("_high", F.lag("_high", 63).over(by())), "_low": F.least("_low", F.lag("_low", 63).over(by()))})
    f = f.withColumns(
        {
            "ret": (c - pc) / pc,
            "diff": c - pc,
            "tr": F.greatest(h - low, F.abs(h - pc), F.abs(low - pc)),
            "pdm": F.when(idx > 0, F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "mdm": F.when(idx > 0, F.when((down > up) & (down > 0), down).otherwise(0.0)),
            **{f"sma{n}": mean("close", n) for n in (20, 50, 150, 200)},
            "vsma50": mean("volume", 50),
            "vol_trend": ratio(5, 20),
            "dryup": ratio(5, 50),
            "ema12": ema(c, 12),
            "ema26": ema(c, 26),
            "w52_high": guarded(252, F.greatest("_high", F.lag("_high", 126).over(by()))),
            "w52_low": guarded(252, F.least("_low", F.lag("_low", 126).over(by()))),
            "proximity": guarded(63, (F.col("_top") - c) / F.nullif("_top", F.lit(0.0)) * 100),
            "rs_raw": guarded(252, 2 * anchor(63) + anchor(126) + anchor(252)),
            "sim_return": guarded(63, anchor(63)),
            "fast_k": guarded(14, (c - F.min("low").over(last(14))) / F.nullif(F.max("high").over(last(14)) - F.min("low").over(last(14)), F.lit(0.0)) * 100),
            "high63": F.when(idx >= 63, F.lag("_top").over(by())),
            "ret10": F.when(idx >= 10, (c / F.lag("close", 10).over(by()) - 1) * 100),
            "boll_sd": guarded(20, F.stddev_samp("close").over(last(20))),
        }
    )
    gain, loss = F.greatest("diff", F.lit(0.0)), F.greatest(-F.col("diff"), F.lit(0.0))
    full = lambda x, n: F.when(F.count(x).over(last(n)) == n, F.avg(x).over(last(n)))
    f = f.withColumns(
        {
            "macd_line": F.col("ema12") - F.col("ema26"),
            "gain14": wilder(gain, 14, 1),
            "loss14": wilder(loss, 14, 1),
            "atr14": wilder(F.col("tr"), 14, 1),
            "tr14": wilder(F.col("tr"), 14, 1),
            "pdm14": wilder(F.col("pdm"), 14, 1),
            "mdm14": wilder(F.col("mdm"), 14, 1),
            "disparity": (c - F.col("sma20")) / F.nullif(F.col("sma20"), F.lit(0.0)) * 100,
            "volatility": guarded(63, sd(62)),
            "contraction": F.when(idx >= 50, sd(10) / F.nullif(sd(40, 10), F.lit(0.0))),
            "obv": F.sum(F.coalesce(F.signum("diff").cast("long") * v, F.lit(0).cast("long"))).over(run()),
            "slow_k": full("fast_k", 3),
            "boll_upper": F.col("sma20") + 2 * F.col("boll_sd"),
            "boll_lower": F.col("sma20") - 2 * F.col("boll_sd"),
            "breakout": F.coalesce((idx >= 64) & (c > F.col("high63")) & (pc <= F.lag("high63").over(by())), F.lit(False)),
        }
    )
    pdi, mdi = F.col("pdm14") / F.col("tr14") * 100, F.col("mdm14") / F.col("tr14") * 100
    dx = F.when(F.col("tr14") == 0, 0.0).when(pdi + mdi == 0, 0.0).otherwise(F.abs(pdi - mdi) / (pdi + mdi) * 100)
    f = f.withColumns(
        {
            "signal_line": ema(F.col("macd_line"), 9, 25),
            "rsi14": F.when(idx >= 14, F.when(F.col("loss14") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain14") / F.col("loss14")))),
            "atr_pct": F.col("atr14") / F.nullif(c, F.lit(0.0)) * 100,
            "dx": F.when(idx >= 14, dx),
            "slow_d": full("slow_k", 3),
            "since_breakout": bars_since(F.col("breakout")),
            "last_high": F.last(F.when(F.col("breakout"), F.col("high63")), ignorenulls=True).over(run()),
            "breakout_volume_ok": F.last(F.when(F.col("breakout"), F.coalesce(v >= VOL_MULT * F.col("vsma50"), F.lit(False))), ignorenulls=True).over(run()),
            "segment": F.sum(F.col("breakout").cast("long")).over(run()),
        }
    )
    prev_m, prev_s = F.lag("macd_line").over(by()), F.lag("signal_line").over(by())
    return f.withColumns(
        {
            "adx14": F.when(idx >= 28, wilder(F.col("dx"), 14, 14)),
            "since_cross": bars_since(F.coalesce((prev_m <= prev_s) & (F.col("macd_line") > F.col("signal_line")), F.lit(False))),
            "since_dead_cross": bars_since(F.coalesce((F.lag("ema26").over(by()) <= F.lag("ema12").over(by())) & (F.col("ema26") > F.col("ema12")), F.lit(False))),
        }
    ).drop("_high", "_low", "_top")


def entry_state(f: DataFrame) -> DataFrame:
    """pivot, state (0 to 3 or undetermined), derived prices."""
    c, high = F.col("close"), F.col("high63")
    recent = F.col("since_breakout") <= BREAKOUT_RECENCY
    over = c > high
    f = f.withColumn("pivot", F.when(F.col("idx") >= 63, F.when(~over, high).when(recent, F.col("last_high"))))
    state = (
        F.when(F.col("idx") < 63, "undetermined")
        .when(F.col("pivot").isNull(), "3")
        .when(~over, F.when(c < F.col("pivot") * (1 - FAR), "0").otherwise("1"))
        .when(c <= F.col("pivot") * (1 + CHASE), "2")
        .otherwise("3")
    )
    return f.withColumns({"state": state, "trigger": F.col("pivot") * (1 + BUFFER), "upper": F.col("pivot") * (1 + CHASE), "far_band": F.col("pivot") * (1 - FAR)})


def exit_signals(f: DataFrame) -> DataFrame:
    """x1, x2, x4, x5: nullable booleans per bar; x5_date and x5_ret of the worst day since the last breakout."""
    c, v = F.col("close"), F.col("volume")
    inside = Window.partitionBy("ticker", "segment").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    after = (F.col("segment") > 0) & (F.col("since_breakout") > 0)
    worst = F.min(F.when(after, F.struct("ret", "idx", "date", F.coalesce(v >= VOL_MULT * F.col("vsma50"), F.lit(False)).alias("ok")))).over(inside)
    return f.withColumns(
        {
            "x1": c < F.col("sma50"),
            "x1_strong": (c < F.col("sma50")) & (v >= 1.5 * F.col("vsma50")),
            "x2": F.when(F.col("ema26").isNotNull(), F.coalesce(F.col("since_dead_cross") < 5, F.lit(False))),
            "x4": F.when(F.col("sma50").isNotNull(), (F.col("ret10") >= 25) & ((c - F.col("sma50")) / F.col("sma50") * 100 >= 25)),
            "x5": F.when(after, (F.col("idx") - worst["idx"] <= 4) & worst["ok"]),
            "x5_date": F.when(after, worst["date"]),
            "x5_ret": F.when(after, worst["ret"]),
        }
    )
