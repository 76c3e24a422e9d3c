"""Screening filters as Columns; a toggle that is off is simply absent from the conjunction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import MIN_BARS


@dataclass(frozen=True)
class Filters:
    disparity_min: float | None = None
    volume_trend_min: float | None = None
    leading_only: bool = False
    rsi: str = "off"
    bollinger: str = "off"
    week52: str = "off"
    stochastic: str = "off"
    atr: str = "off"
    obv: str = "off"


TOGGLES: dict[str, Filters] = {
    "leading_sector": Filters(leading_only=True),
    "rsi_overheated": Filters(rsi="overheated"),
    "rsi_oversold": Filters(rsi="oversold"),
    "bollinger_lower": Filters(bollinger="lowerProximity"),
    "bollinger_upper": Filters(bollinger="upperBreakout"),
    "near_high": Filters(week52="nearHigh"),
    "near_low": Filters(week52="nearLow"),
    "stochastic_oversold": Filters(stochastic="oversold"),
    "stochastic_overbought": Filters(stochastic="overbought"),
    "atr_low": Filters(atr="low"),
    "atr_high": Filters(atr="high"),
    "obv_rising": Filters(obv="rising"),
    "obv_falling": Filters(obv="falling"),
}


def with_population(s: DataFrame) -> DataFrame:
    """atr_rank: percentile of atr_pct among all sufficient tickers of the date, before any filter."""
    rank = F.cume_dist().over(Window.partitionBy("eval_date", "sufficient", F.col("atr_pct").isNull()).orderBy("atr_pct")) * 100
    return s.withColumn("atr_rank", F.when(F.col("sufficient") & F.col("atr_pct").isNotNull(), rank))


def condition(f: Filters) -> Column:
    """Rows of sufficient tickers that pass every toggle that is on; an unknown value fails its toggle."""
    c = F.col("close")
    choices = {
        "rsi": {"overheated": F.col("rsi14") >= 70, "oversold": F.col("rsi14") <= 30},
        "bollinger": {"lowerProximity": c <= F.col("boll_lower") * 1.02, "upperBreakout": c >= F.col("boll_upper")},
        "week52": {"nearHigh": c >= F.col("w52_high") * 0.95, "nearLow": c <= F.col("w52_low") * 1.05},
        "stochastic": {"oversold": F.col("slow_k") <= 20, "overbought": F.col("slow_k") >= 80},
        "atr": {"low": F.col("atr_rank") <= 30, "high": F.col("atr_rank") >= 70},
        "obv": {"rising": F.col("obv") > F.col("obv20"), "falling": F.col("obv") < F.col("obv20")},
    }
    out = F.col("sufficient")
    if f.disparity_min is not None:
        out = out & (F.col("disparity") >= f.disparity_min)
    if f.volume_trend_min is not None:
        out = out & (F.col("vol_trend") >= f.volume_trend_min)
    if f.leading_only:
        out = out & F.col("leading")
    for name, options in choices.items():
        if getattr(f, name) != "off":
            out = out & options[getattr(f, name)]
    return out


def text_match(query: str, *columns: str) -> Column:
    """Any of the columns holds the query, ignoring case and outer blanks; a blank query matches all rows."""
    q = F.lower(F.trim(F.lit(query)))
    out = q == ""
    for c in columns:
        out = out | F.contains(F.lower(c), q)
    return out


def liquidity(bars: DataFrame, min_price: float = 10.0, min_dollars: float = 20e6, window: int = 20) -> DataFrame:
    """ticker, reason: the first guardrail that a ticker's last bar fails (price, then mean traded value), else null."""
    w = Window.partitionBy("ticker").orderBy("idx")
    b = bars.withColumns({"dollars": F.avg(F.col("close") * F.col("volume")).over(w.rowsBetween(1 - window, 0)), "_next": F.lead("idx").over(w)})
    reason = F.when(F.col("close") < min_price, "price").when(F.col("dollars") < min_dollars, "dollar volume")
    return b.filter("_next IS NULL").select("ticker", reason.alias("reason"))


def sufficiency(bars: DataFrame) -> DataFrame:
    """ticker, n_bars, sufficient, reason. Enough bars for the longest need also cover the other warm-ups."""
    n = bars.groupBy("ticker").agg(F.count("*").alias("n_bars"))
    return n.select("ticker", "n_bars", (F.col("n_bars") >= MIN_BARS).alias("sufficient"), F.when(F.col("n_bars") < MIN_BARS, f"fewer than {MIN_BARS} bars").alias("reason"))
