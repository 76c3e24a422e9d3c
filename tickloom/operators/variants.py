"""Scoring and gate variants beside the recommendations, and cohorts by the age of a signal's event."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import PRESETS, STRATEGIES, Preset
from tickloom.functions.exprs import bars_since, half_up
from tickloom.operators import screening

#: Thresholds of the variants (fixed values).
CONSENSUS_WEIGHTS = (0.5, 0.6, 0.4)
SWEET_LOW, SWEET_HIGH, OVERHEATED, ADX_MIN, OLDEST = 3.0, 8.0, 15.0, 20.0, 10


def _again(*order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy("eval_date").orderBy(*order))


def inverted_u(s: DataFrame, trend: DataFrame) -> DataFrame:
    """Trend signals scored anew: full marks for a disparity of 3 to 8 %, none from 15 %."""
    sectors = screening.sector_returns(s).filter("leading").select("eval_date", "sector", F.lit(True).alias("lead"))
    j = trend.filter("signal").drop("sector").join(s.select("eval_date", "ticker", "sector", "disparity", "vol_trend"), ["eval_date", "ticker"]).join(sectors, ["eval_date", "sector"], "left")
    d = F.coalesce("disparity", F.lit(0.0))
    shape = F.when(d < SWEET_LOW, F.greatest(F.lit(0.0), d / SWEET_LOW) * 60).when(d <= SWEET_HIGH, 60.0).otherwise(F.greatest(F.lit(0.0), (OVERHEATED - d) / (OVERHEATED - SWEET_HIGH)) * 60)
    volume = F.greatest(F.lit(0.0), F.least(F.coalesce("vol_trend", F.lit(0.0)), F.lit(50.0))) / 50 * 30
    j = j.withColumn("score", half_up(shape + volume + F.when(F.col("lead"), 10).otherwise(0), 1))
    return j.select("eval_date", "ticker", "score", _again(F.desc("score"), "rank").alias("rank"))


def adx_gate(s: DataFrame, preset: Preset) -> DataFrame:
    """Every passer of the level that the date's trend list uses, with ADX of 20 and more."""
    passed = screening.trend_stage1(s, preset).filter(F.col("signal") & (F.coalesce("adx14", F.lit(0.0)) >= ADX_MIN))
    return passed.select("eval_date", "ticker", "score", "level", _again(F.desc("score"), "pos").alias("rank"))


def weighted_consensus(both: DataFrame, trend_weight: float = 0.6) -> DataFrame:
    """The consensus ranked by a weighted mean of percentiles (a: trend, b: template)."""
    pct = F.when(F.col("stars") == 2, F.col("a") * trend_weight + F.col("b") * (1 - trend_weight)).otherwise(F.coalesce("a", "b"))
    return both.select("eval_date", "ticker", "stars", half_up(pct, 4).alias("pct"))


def weighted_rankings(both: DataFrame, weights: tuple[float, ...] = CONSENSUS_WEIGHTS) -> DataFrame:
    """trend_weight, eval_date, ticker, stars, pct, rank: the consensus ranked under each weight of the trend list, all in one pass."""
    each = both.withColumn("trend_weight", F.explode(F.array(*map(F.lit, weights))))
    w = F.col("trend_weight")
    each = each.withColumn("pct", half_up(F.when(F.col("stars") == 2, F.col("a") * w + F.col("b") * (1 - w)).otherwise(F.coalesce("a", "b")), 8))
    order = Window.partitionBy("trend_weight", "eval_date").orderBy(F.desc("stars"), F.desc("pct"), F.col("trend_rank").asc_nulls_last(), "template_rank")
    return each.select("trend_weight", "eval_date", "ticker", "stars", "pct", F.row_number().over(order).alias("rank"))


@dataclass(frozen=True)
class Lists:
    """What a variant starts from: the snapshot, the published lists without the regime's gate, and their consensus."""

    snapshot: DataFrame
    trend: DataFrame
    template: DataFrame

    def both(self) -> DataFrame:
        return screening.consensus(self.trend, self.template)


@dataclass(frozen=True)
class Variant:
    """apply: eval_date, ticker, rank of the changed list. baseline: the strategies that it is measured against."""

    name: str
    baseline: tuple[str, ...]
    apply: Callable[[Lists], DataFrame]


VARIANTS: dict[str, Variant] = {}


def register(variant: Variant) -> Variant:
    """Make a variant known to the evaluation; names are unique, and a baseline must name strategies."""
    if variant.name in VARIANTS or not variant.baseline or not set(variant.baseline) <= set(STRATEGIES):
        raise ValueError(f"not a new variant with a known baseline: {variant.name}, {variant.baseline}")
    VARIANTS[variant.name] = variant
    return variant


register(Variant("disparity_inverted_u", STRATEGIES[:1], lambda x: inverted_u(x.snapshot, x.trend)))
register(Variant("adx_gate", STRATEGIES[:1], lambda x: adx_gate(x.snapshot, PRESETS["default"])))
register(Variant("consensus_weighted", STRATEGIES[2:], lambda x: weighted_rankings(x.both(), (0.6,))))


def cohort(days: Column) -> Column:
    return F.when(days.isNull() | (days >= OLDEST), "no_recent_breakout").when(days == 0, "0d").when(days <= 2, "1-2d").when(days <= 4, "3-4d").otherwise("5d+")


def freshness(f: DataFrame) -> DataFrame:
    """ticker, date, cross_cohort (golden cross), pivot_cohort (close at its own 63-bar high)."""
    at_high = F.coalesce((F.col("idx") >= 62) & (F.col("proximity") == 0), F.lit(False))
    return f.select("ticker", "date", cohort(F.col("since_cross")).alias("cross_cohort"), cohort(bars_since(at_high)).alias("pivot_cohort"))
