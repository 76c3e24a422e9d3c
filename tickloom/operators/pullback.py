"""Pullbacks: the peak before a bar, the fall since, and volume before and after the peak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import DEPTH_MAX, DEPTH_MIN, PIVOT_LOOKBACK, RESUME_BARS
from tickloom.functions.exprs import by, last, run


LEVELS = PIVOT_LOOKBACK.bit_length()


def pullbacks(f: DataFrame) -> DataFrame:
    """f with depth_pct, p2, p3, p4, pullback_low and resume_trigger; null or false where no pivot is known.

    f: bars with sma200 and pivot. The peak is the earliest highest close of the 63 bars before. p4 compares mean
    volumes after the peak and over as many bars before it, from running sums. The low since the peak is a range
    minimum: a bar keeps the least closes of its last 1, 2, 4, ... 32 bars, and two such spans cover any range, one
    ending at the bar and one at a bar met by equality.
    """
    idx = F.col("idx")
    peak = F.max(F.struct("close", (-idx).alias("back"), "_sum", "volume")).over(last(PIVOT_LOOKBACK, 1))
    lows = F.array(*[F.min("close").over(last(1 << k)) for k in range(LEVELS)])
    f = f.withColumn("_sum", F.sum("volume").over(run()))
    f = f.withColumns({"_peak": F.when(idx >= PIVOT_LOOKBACK, peak), "_lows": lows})
    f = f.withColumns({"peak_idx": -F.col("_peak.back"), "_long": (idx + F.col("_peak.back")).cast("int")})
    level = sum((F.col("_long") >= 1 << k).cast("int") for k in range(1, LEVELS))
    f = f.withColumns({"_start": F.col("peak_idx") - F.col("_long"), "_level": level, "_end": F.col("peak_idx") + F.call_function("shiftleft", F.lit(1), level)})
    at = lambda key, *columns: f.select("ticker", key, *columns)
    f = f.join(at((idx + 1).alias("_start"), F.col("_sum").alias("_far")), ["ticker", "_start"], "left")
    f = f.join(at(idx.alias("_end"), F.col("_lows").alias("_early")), ["ticker", "_end"], "left")
    after = F.col("_sum") - F.col("_peak._sum")
    before = F.col("_peak._sum") - F.col("_peak.volume") - F.coalesce("_far", F.lit(0))
    depth = -(F.col("close") - F.col("pivot")) / F.col("pivot") * 100
    return f.withColumns(
        {
            "depth_pct": depth,
            "p2": depth.between(DEPTH_MIN, DEPTH_MAX),
            "p3": F.coalesce(F.col("close") > F.col("sma200"), F.lit(False)),
            "p4": F.coalesce((F.col("_start") >= 0) & (after < before), F.lit(False)),
            "pullback_low": F.when(F.col("pivot").isNotNull(), F.least(F.get("_lows", F.col("_level")), F.get("_early", F.col("_level")))),
            "resume_trigger": F.max("close").over(last(RESUME_BARS)),
            "next_open": F.lead("open").over(by()),
        }
    ).drop("_sum", "_peak", "_lows", "_early", "_long", "_far", "_start", "_end", "_level")
