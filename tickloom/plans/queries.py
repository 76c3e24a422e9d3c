"""Named queries over the order tables: each is (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import BASES, PRESETS, QUALITIES, REGIMES, SAMPLES, STRATEGIES
from tickloom.functions.exprs import by, half_up, mean, run
from tickloom.operators import backtest, fundamentals, pullback, screening
from tickloom.operators.indicators import entry_state, exit_signals, indicators
from tickloom.run import Run, run_of
from tickloom.sources.bars import bars, quarters
from tickloom.sources.stage import staged

QUERY = Callable[[SparkSession, str | Run], DataFrame]

#: Per-bar indicator queries: rounded doubles, and columns taken as they are.
INDICATORS: dict[str, tuple[list[str], list[str]]] = {
    "sma": (["sma20", "sma50", "sma150", "sma200"], []),
    "ema": (["ema12", "ema26"], []),
    "rsi": (["rsi14"], []),
    "macd": (["macd_line", "signal_line"], []),
    "golden_cross_windows": ([], ["since_cross", "since_dead_cross"]),
    "volume_trend": (["vol_trend"], []),
    "daily_returns_vol": (["ret", "volatility"], []),
    "bollinger": (["sma20", "boll_upper", "boll_lower"], []),
    "week52": (["w52_high", "w52_low"], []),
    "stochastic": (["slow_k", "slow_d"], []),
    "atr": (["atr14", "atr_pct"], []),
    "obv": ([], ["obv"]),
    "rs_raw": (["rs_raw"], []),
    "vol_contraction": (["contraction"], []),
    "volume_dryup": (["dryup"], []),
    "pivot_proximity": (["proximity"], []),
    "adx": (["adx14"], []),
    "disparity": (["disparity"], []),
    "preceding_high": (["high63"], []),
    "breakouts": (["last_high"], ["breakout", "since_breakout", "breakout_volume_ok"]),
    "simulation_return": (["sim_return", "ret10"], []),
}


#: Digits other than six: means of four-digit prices over 200 bars end in a 5 at the seventh.
DIGITS = {"sma": 8}


def _indicator(rounded: list[str], plain: list[str], digits: int) -> QUERY:
    return lambda spark, d: indicators(bars(spark, d)).select("ticker", "idx", *[half_up(F.col(c), digits).alias(c) for c in rounded], *plain)


def _state(spark: SparkSession, d: str) -> DataFrame:
    f = entry_state(indicators(bars(spark, d)))
    return f.select("ticker", "idx", "state", *[half_up(F.col(c)).alias(c) for c in ("pivot", "trigger", "upper", "far_band")])


def _exits(spark: SparkSession, d: str) -> DataFrame:
    return exit_signals(indicators(bars(spark, d))).select("ticker", "idx", "x1", "x1_strong", "x2", "x4", "x5")


def _exit_counts(spark: SparkSession, d: str) -> DataFrame:
    f = exit_signals(indicators(bars(spark, d)))
    return f.groupBy("ticker").agg(*[F.count_if(c).alias(c) for c in ("x1", "x2", "x4", "x5")])


#: Steps on the way to indicators, which nothing reads afterwards.
STEPS = ("diff", "tr", "pdm", "mdm", "gain14", "loss14", "tr14", "pdm14", "mdm14", "dx", "fast_k", "boll_sd", "close_run", "volume_run")


def _screened(spark: SparkSession, d: str) -> DataFrame:
    """Bars with all that screening looks at; computed once a session."""

    def make() -> DataFrame:
        f = entry_state(exit_signals(indicators(_priced(spark, d))))
        averages = F.when(F.col("idx") >= 19, F.avg("obv").over(by().rowsBetween(-19, 0)))
        return f.withColumns({"sma200_prior": F.lag("sma200", 22).over(by()), "obv20": averages}).drop(*STEPS)

    return staged(spark, d, "screened", make)


def _features(spark: SparkSession, d: str) -> DataFrame:
    """The same with pullbacks, which fills and exits look at."""
    return staged(spark, d, "features", lambda: pullback.pullbacks(_screened(spark, d)))


def _snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = _screened(spark, d)
    return f, staged(spark, d, "snapshot", lambda: screening.with_template(screening.snapshots(f, _dates(spark, d))))


def _dates(spark: SparkSession, d: str | Run) -> DataFrame:
    run = run_of(d)
    return screening.evaluation_dates(screening.trading_calendar(_priced(spark, d)), run.warmup, run.buffer, run.step)


def _priced(spark: SparkSession, d: str) -> DataFrame:
    """Bars alone; computed once a session."""
    return staged(spark, d, "bars", lambda: bars(spark, d))


def _regimes(spark: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        b = _priced(spark, d)
        averages = b.withColumn("close_run", F.sum("close").over(run())).select("ticker", "idx", "date", "close", mean("close", 200).alias("sma200"))
        return screening.regimes(screening.breadth(averages, screening.trading_calendar(b)))

    return staged(spark, d, "regimes", make)


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The gated trend and template lists."""
    _, s = _snapshot(spark, d)
    r = _regimes(spark, d)
    trend = staged(spark, d, "trend", lambda: screening.gate(screening.trend_recommend(s, PRESETS["default"]), r))
    return trend, staged(spark, d, "template", lambda: screening.gate(screening.template_recommend(s), r))


def _trend(preset: str) -> QUERY:
    return lambda spark, d: screening.trend_recommend(_snapshot(spark, d)[1], PRESETS[preset])


def _template(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshot(spark, d)[1]
    return s.select("eval_date", "ticker", half_up(F.col("rs_pct")).alias("rs_pct"), *[f"t{i}" for i in range(1, 9)], F.col("n_passed").cast("long").alias("n_passed"))


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    c = screening.consensus(*_lists(spark, d))
    return c.select("eval_date", "ticker", "stars", half_up(F.col("consensus_pct"), 4).alias("consensus_pct"), "trend_score", "template_score")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    trend, template = _lists(spark, d)
    return backtest.signals(trend, template, screening.consensus(trend, template))


def _split(spark: SparkSession, d: str) -> DataFrame:
    """split: the middle evaluation date; it and later ones are out of sample. One row."""
    return _dates(spark, d).agg(F.array_sort(F.collect_list("eval_date")).alias("a")).select(F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("split"))


def _sampled(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(_split(spark, d))).withColumn("sample", F.when(F.col("eval_date") >= F.col("split"), "out").otherwise("in")).drop("split")


def _basis(df: DataFrame) -> DataFrame:
    both, one = F.array(F.lit("allSignals"), F.lit("top5")), F.array(F.lit("allSignals"))
    return df.withColumn("basis", F.explode(F.when(F.col("rank") <= 5, both).otherwise(one)))


def _quality(df: DataFrame) -> DataFrame:
    return df.withColumn("quality", F.explode(F.array(F.lit("all"), F.when(F.col("relaxed"), "relaxed").otherwise("normal"))))


def _perf(spark: SparkSession, d: str) -> DataFrame:
    """All strategies' signals with forward performance, regime and sample."""

    def make() -> DataFrame:
        s, b = staged(spark, d, "signals", lambda: _signals(spark, d)), _priced(spark, d)
        forward = backtest.forward_returns(b, run_of(d).horizons)
        at = _regimes(spark, d).select(F.col("date").alias("eval_date"), "regime")
        perf = backtest.performance(s, forward, backtest.benchmark(forward), backtest.drawdowns(b, s, run_of(d).horizons))
        return _sampled(spark, d, perf.join(at, "eval_date", "left"))

    return staged(spark, d, "performance", make)


def _strategy_table(spark: SparkSession, d: str) -> DataFrame:
    """By strategy, sample, basis, quality and days, groups without signals included; the relaxed share is of all signals of the group."""
    keys = ["strategy", "sample", "basis", "quality"]
    s = _quality(_basis(_sampled(spark, d, staged(spark, d, "signals", lambda: _signals(spark, d)))))
    share = s.groupBy(*keys).agg(half_up(F.avg(F.col("relaxed").cast("int")), 4).alias("relaxed_share"))
    table = backtest.summarize(_quality(_basis(_perf(spark, d))), [*keys, "days"])
    whole = backtest.with_empty_cells(table, {"strategy": STRATEGIES, "sample": SAMPLES, "basis": BASES, "quality": QUALITIES, "days": run_of(d).horizons})
    return whole.join(share, keys, "left")


def _regime_axis(spark: SparkSession, d: str) -> DataFrame:
    table = backtest.summarize(_basis(_perf(spark, d).filter("regime IS NOT NULL")), ["strategy", "sample", "basis", "regime", "days"])
    return backtest.with_empty_cells(table, {"strategy": STRATEGIES, "sample": SAMPLES, "basis": BASES, "regime": REGIMES, "days": run_of(d).horizons})


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    b = backtest.benchmark(backtest.forward_returns(bars(spark, d)))
    return b.select("date", "days", half_up(F.col("bench")).alias("bench"))


def _drawdown(spark: SparkSession, d: str) -> DataFrame:
    trend = screening.trend_recommend(_snapshot(spark, d)[1], PRESETS["default"])
    return backtest.drawdowns(_priced(spark, d), trend).select("eval_date", "ticker", "days", half_up(F.col("mdd")).alias("mdd"))


QUERIES: dict[str, QUERY] = {
    "bars": lambda spark, d: bars(spark, d).drop("pos", "block"),
    "quarters": quarters,
    **{k: _indicator(*v, DIGITS.get(k, 6)) for k, v in INDICATORS.items()},
    "entry_state": _state,
    "exit_signals": _exits,
    "exit_signal_counts": _exit_counts,
    "trading_calendar": lambda spark, d: screening.trading_calendar(bars(spark, d)),
    "evaluation_dates": _dates,
    "asof_snapshot": lambda spark, d: _snapshot(spark, d)[1].select("eval_date", "ticker", "date", "idx", "close", "sufficient", "full_year"),
    "trend_template": _template,
    "sector_returns": lambda spark, d: screening.sector_returns(_snapshot(spark, d)[1]).select("eval_date", "sector", half_up(F.col("avg_return")).alias("avg_return"), "members", "leading"),
    "regime_series": lambda spark, d: _regimes(spark, d).withColumn("breadth", half_up(F.col("breadth"))),
    **{f"trend_recommend_{p}": _trend(p) for p in PRESETS},
    "template_recommend": lambda spark, d: screening.template_recommend(_snapshot(spark, d)[1]),
    "consensus_ranking": _consensus,
    "signals": _signals,
    "benchmark_returns": _benchmark,
    "max_drawdown": _drawdown,
    "strategy_table": _strategy_table,
    "regime_axis": _regime_axis,
    "fundamental_history": lambda spark, d: fundamentals.history(quarters(spark, d)),
}
