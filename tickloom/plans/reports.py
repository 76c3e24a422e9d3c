"""Report queries: comparisons and summaries over the backtest's tables, checks of them, and universe files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.config import ATR_STOP, MIN_BARS, PRESETS, REGIMES, SAMPLES, STEP, STOP, STRATEGIES, YEAR, custom_preset
from tickloom.functions.exprs import by, guarded, half_up, last
from tickloom.operators import backtest, filters, fundamentals, paths, reasons, screening, variants
from tickloom.operators.indicators import entry_state, indicators
from tickloom.plans import backtest_queries, queries
from tickloom.plans.queries import QUERY, _perf, _priced, _regimes, _sampled, _signals, _snapshot
from tickloom.sources import universe
from tickloom.run import run_of
from tickloom.sources.bars import bars, table
from tickloom.sources.stage import shared_folder, staged

#: Least missing template conditions of X3, samples of a badge, and samples of a scoring variant (fixed values).
X3_MISSING, BADGE_SAMPLE, VARIANT_SAMPLE = 3, 50, 100
#: Name of the exit that ends half of a position (fixed value).
PARTIAL = "exit_climax_partial"
HURDLE_GROUPS = ("pass", "partial", "partialOrBetter", "fail")


def _with_x3(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshot(spark, d)[1].withColumn("missing", F.when(F.col("full_year"), 8 - F.col("n_passed").cast("long")))
    x3 = F.col("missing") >= X3_MISSING
    return s.withColumns({"x3": x3, "x3_strong": x3 & ~(F.col("t1") & F.col("t5"))})


def _breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _with_x3(spark, d).select("eval_date", "ticker", "missing", "x3", "x3_strong")


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    """All exit signals of a ticker on a date: the codes that fired, how many, and how many could be judged."""
    checks = {f"X{k}": F.col(f"x{k}") for k in range(1, 6)}
    fired = F.concat_ws(",", *[F.when(x, code) for code, x in checks.items()])
    count = lambda of: sum((of(x).cast("long") for x in checks.values()), F.lit(0).cast("long"))
    return _with_x3(spark, d).select("eval_date", "ticker", fired.alias("codes"), count(lambda x: F.coalesce(x, F.lit(False))).alias("fired"), count(lambda x: x.isNotNull()).alias("judged"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return reasons.exit_evidence(_with_x3(spark, d))


def _universe_stats(spark: SparkSession, d: str) -> DataFrame:
    n = bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_BARS)
    short = F.count_if(F.col("n") < YEAR)
    return n.agg(F.count("*").alias("tickers"), short.alias("short_history"), half_up(short / F.nullif(F.count("*"), F.lit(0)), 4).alias("short_ratio"))


def _effective(spark: SparkSession, d: str) -> DataFrame:
    """Signals of overlapping holding periods, divided by how often they overlap."""
    t = _strategies(spark, d).filter("quality = 'all'")
    factor = half_up(F.col("days") / F.lit(float(STEP)), 4)
    return t.select("strategy", "sample", "basis", "days", "signals", factor.alias("overlap_factor"), half_up(F.col("signals") / factor, 4).alias("effective"))


def _strategies(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "strategies", lambda: queries.QUERIES["strategy_table"](spark, d))


def _current_regime(spark: SparkSession, d: str) -> DataFrame:
    latest = _regimes(spark, d).filter("breadth IS NOT NULL").agg(F.max_by(F.struct("date", "breadth", "regime", "transition_date"), "date").alias("r")).select("r.*")
    return latest.withColumn("breadth", half_up(F.col("breadth")))


def _simulation(spark: SparkSession, d: str) -> DataFrame:
    anchor = F.lag("close", 62).over(by())
    b = bars(spark, d).select("ticker", "idx", "close", guarded(63, anchor).alias("anchor_close"), guarded(63, F.max("high").over(last(63))).alias("period_high"), guarded(63, F.min("low").over(last(63))).alias("period_low"))
    return b.select("ticker", "idx", "anchor_close", "period_high", "period_low", half_up((F.col("close") / F.col("anchor_close") - 1) * 100).alias("return_pct"))


def _derived_prices(spark: SparkSession, d: str) -> DataFrame:
    f = entry_state(indicators(bars(spark, d))).filter("pivot IS NOT NULL")
    prices = {"trigger": F.col("trigger"), "upper": F.col("upper"), "far_band": F.col("far_band"), "stop_fixed": F.col("close") * (1 - STOP), "stop_atr": F.col("close") - ATR_STOP * F.col("atr14")}
    return f.select("ticker", "idx", *[half_up(x).alias(n) for n, x in prices.items()])


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    """The top five trend signals out of sample, held for 60 bars. One row."""
    t = _strategies(spark, d).filter(f"strategy = '{STRATEGIES[0]}' AND sample = 'out' AND basis = 'top5' AND quality = 'all' AND days = 60")
    return F.broadcast(t.select(*[F.col(c).alias(f"base_{c}") for c in ("signals", "win_rate", "avg_excess", "median_excess")]))


def _exit_deltas(spark: SparkSession, d: str) -> DataFrame:
    partial = backtest.summarize(backtest_queries._climax_positions(spark, d).withColumn("rule", F.lit(PARTIAL)), ["rule"])
    figures = ["rule", "signals", "avg_excess", "win_rate"]
    both = backtest_queries.QUERIES["exit_variants"](spark, d).select(*figures).unionByName(partial.select(*figures))
    j = both.crossJoin(_baseline(spark, d))
    return j.select("rule", "signals", "base_signals", *[half_up(F.col(c) - F.col(f"base_{c}"), 4).alias(f"{c}_delta") for c in ("avg_excess", "win_rate")])


def _exit_regime_baseline(spark: SparkSession, d: str) -> DataFrame:
    detail = backtest_queries.QUERIES["exit_regime_detail"](spark, d).select("rule", "regime", "signals", "win_rate", "avg_excess", "median_excess", "mdd", "stop_rate", "avg_days")
    more = (half_up(F.avg(F.col("triggered").cast("int")), 4).alias("stop_rate"), half_up(F.avg("held"), 4).alias("avg_days"))
    partial = backtest_queries._climax_positions(spark, d).filter("regime IS NOT NULL").withColumn("rule", F.lit(PARTIAL))
    detail = detail.unionByName(backtest.summarize(partial, ["rule", "regime"], *more).select(*detail.columns))
    whole = backtest.with_empty_cells(detail, {"rule": (*paths.EXITS, PARTIAL), "regime": REGIMES})
    held = queries.QUERIES["regime_axis"](spark, d).filter(f"strategy = '{STRATEGIES[0]}' AND sample = 'out' AND basis = 'top5' AND days = 60")
    return whole.join(held.select("regime", *[F.col(c).alias(f"base_{c}") for c in ("signals", "win_rate", "avg_excess", "median_excess", "mdd")]), "regime")


def _climax_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Holding 60 bars, ending at a climax, and ending half of the position there."""
    some = backtest_queries.QUERIES["climax_partial"](spark, d).agg(F.count("*").alias("signals"), half_up(F.avg("excess"), 4).alias("avg_excess"), half_up(F.expr("percentile(excess, 0.5)"), 4).alias("median_excess"))
    full = backtest_queries.QUERIES["exit_variants"](spark, d).filter("rule = 'exit_climax'").select("signals", "avg_excess", "median_excess")
    none = _baseline(spark, d).toDF("signals", "win_rate", "avg_excess", "median_excess").drop("win_rate")
    named = [x.select(F.lit(n).alias("arm"), "signals", "avg_excess", "median_excess") for n, x in (("noExit", none), ("fullClimaxExit", full), ("partialClimaxExit", some))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _intersection(spark: SparkSession, d: str) -> DataFrame:
    """Two-star signals by sample, regime and verdict as of their date."""
    s = _signals(spark, d).filter(F.col("strategy") == STRATEGIES[2]).select("eval_date", "ticker", "rank")
    verdicts = fundamentals.as_of(s, queries.QUERIES["fundamental_history"](spark, d)).select("eval_date", "ticker", "verdict")
    p = _perf(spark, d).filter((F.col("strategy") == STRATEGIES[2]) & F.col("regime").isNotNull()).join(verdicts, ["eval_date", "ticker"])
    groups = F.when(F.col("verdict").isin("pass", "partial"), F.array("verdict", F.lit("partialOrBetter"))).when(F.col("verdict") == "fail", F.array("verdict"))
    table_ = backtest.summarize(p.withColumn("hurdle", F.explode(groups)), ["sample", "regime", "hurdle", "days"])
    return backtest.with_empty_cells(table_, {"sample": SAMPLES, "regime": REGIMES, "hurdle": HURDLE_GROUPS, "days": run_of(d).horizons})


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Top five of each scoring variant out of sample, 20 bars on, against the published lists."""
    s, trend, template = backtest_queries._ungated(spark, d)
    start = variants.Lists(s, trend, template)
    lists = {v.name: (v.apply(start), v.baseline) for v in variants.VARIANTS.values()}
    b = _priced(spark, d)
    forward = backtest.forward_returns(b, (20,))
    bench, now, out = backtest.benchmark(forward), _perf(spark, d).filter("rank <= 5 AND sample = 'out' AND days = 20"), None
    for name, (listed, base) in lists.items():
        picked = _sampled(spark, d, listed.filter("rank <= 5").select("eval_date", "ticker")).filter("sample = 'out'")
        measured = picked.join(forward.withColumnRenamed("date", "eval_date"), ["eval_date", "ticker"]).join(bench.withColumnRenamed("date", "eval_date"), ["eval_date", "days"])
        arms = measured.select(F.lit("variant").alias("arm"), (F.col("ret") - F.col("bench")).alias("excess")).unionByName(now.filter(F.col("strategy").isin(*base)).select(F.lit("base").alias("arm"), "excess"))
        one = arms.withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    of = lambda arm, x: F.when(F.col("arm") == arm, x)
    mean = lambda arm, x: half_up(F.avg(of(arm, x)), 4)
    won = (F.col("excess") > 0).cast("int")
    t = out.groupBy("variant").agg(
        F.count(of("variant", F.lit(1))).alias("signals"), F.count(of("base", F.lit(1))).alias("base_signals"),
        half_up(mean("variant", F.col("excess")) - mean("base", F.col("excess")), 4).alias("excess_delta"), half_up(mean("variant", won) - mean("base", won), 4).alias("win_rate_delta"),
    )
    t = backtest.with_empty_cells(t, {"variant": tuple(lists)}).withColumn("base_signals", F.coalesce("base_signals", F.lit(0).cast("long")))
    enough = (F.col("signals") >= VARIANT_SAMPLE) & (F.col("base_signals") >= VARIANT_SAMPLE)
    return t.withColumns({"sufficient_sample": enough, "meets_criteria": enough & F.coalesce((F.col("excess_delta") > 0) & (F.col("win_rate_delta") > 0), F.lit(False))})


def _weight_grid(spark: SparkSession, d: str) -> DataFrame:
    """The consensus under each weight of the grid, ranked."""
    return variants.weighted_rankings(variants.Lists(*backtest_queries._ungated(spark, d)).both())


def _weights(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the trend list as shares of a portfolio; null where they add up to nothing."""
    trend = screening.trend_recommend(_snapshot(spark, d)[1], PRESETS["default"])
    total = F.sum("score").over(Window.partitionBy("eval_date"))
    return trend.select("eval_date", "ticker", half_up(F.when(total > 0, F.col("score") / total)).alias("weight"))


def _spark_points(spark: SparkSession, d: str) -> DataFrame:
    """The last 63 closes of each ticker between their least (0) and greatest (1); a half where all are equal."""
    b = bars(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("idx")))).filter("back <= 63")
    w = Window.partitionBy("ticker")
    low, high = F.min("close").over(w), F.max("close").over(w)
    return b.select("ticker", "idx", half_up(F.when(high > low, (F.col("close") - low) / (high - low)).otherwise(0.5)).alias("y"))


def _confidence(spark: SparkSession, d: str) -> DataFrame:
    """By mode, the published figures at 20 and 60 bars: out of sample, top five; the consensus is shown by its two stars."""
    t = _strategies(spark, d).filter("sample = 'out' AND basis = 'top5' AND quality = 'all'")
    of = lambda n, c: F.max(F.when(F.col("days") == n, F.col(c)))
    mode = F.when(F.col("strategy") == STRATEGIES[2], "consensus").otherwise(F.col("strategy"))
    got = t.filter(F.col("strategy") != STRATEGIES[3]).groupBy(mode.alias("mode")).agg(*[of(n, c).alias(f"{c}_{n}") for n in (20, 60) for c in ("signals", "win_rate", "avg_excess")])
    lacks = lambda n: (F.col(f"signals_{n}") == 0) | F.col(f"win_rate_{n}").isNull() | F.col(f"avg_excess_{n}").isNull()
    return got.withColumns({"insufficient_20": lacks(20), "insufficient_60": lacks(60), "effective_60": half_up(F.col("signals_60") / F.lit(60.0 / STEP), 4)})


def _badges(spark: SparkSession, d: str) -> DataFrame:
    t = queries.QUERIES["regime_axis"](spark, d).filter(f"strategy = '{STRATEGIES[2]}' AND sample = 'out' AND basis = 'allSignals' AND days = 20")
    shown = F.col("signals") >= BADGE_SAMPLE
    return t.select("regime", "signals", shown.alias("sufficient"), *[F.when(shown, F.col(c)).alias(c) for c in ("win_rate", "avg_excess")])


def _invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the strategy table must keep: how many cells each was checked on, and how many break it."""
    t = _strategies(spark, d)
    n = lambda q: F.sum(F.when(F.col("quality") == q, F.col("signals")))
    sums = t.groupBy("strategy", "sample", "basis", "days").agg((n("all") == n("normal") + n("relaxed")).alias("ok")).select(F.lit("qualitiesAddUp").alias("rule"), "ok")
    top = t.groupBy("strategy", "sample", "quality", "days").agg((F.sum(F.when(F.col("basis") == "top5", F.col("signals"))) <= F.sum(F.when(F.col("basis") == "allSignals", F.col("signals")))).alias("ok"))
    figures = ("win_rate", "avg_excess", "median_excess", "avg_return", "mdd")
    rules: dict[str, Column] = {
        "ratesWithinUnit": F.coalesce(F.col("win_rate").between(0, 1), F.lit(True)) & F.coalesce(F.col("relaxed_share").between(0, 1), F.lit(True)),
        "fallsWithinUnit": F.coalesce(F.col("mdd").between(0, 1), F.lit(True)),
        "emptyMeansNull": F.exists(F.array(*[F.col(c).isNull() for c in figures]), lambda x: x) == (F.col("signals") == 0),
        "normalIsNotRelaxed": (F.col("quality") != "normal") | (F.coalesce("relaxed_share", F.lit(0.0)) == 0),
    }
    each = t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("ok")) for k, v in rules.items()])).alias("x")).select("x.*")
    every = each.unionByName(sums).unionByName(top.select(F.lit("topIsPartOfAll").alias("rule"), "ok"))
    return every.groupBy("rule").agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("broken"))


def _custom(spark: SparkSession, d: str) -> DataFrame:
    """The trend list under a user's own parameters, of which one is out of range and falls back."""
    return screening.trend_recommend(_snapshot(spark, d)[1], custom_preset({"rsiMin": 48, "goldenCrossWindow": 99, "highScoreThreshold": 75}))


def _universe_file(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as a universe file and read back."""

    def make() -> DataFrame:
        path = f"{shared_folder(spark)}/tickloom-{uuid.uuid4().hex}/universe"
        universe.write_universe(_priced(spark, d), path)
        return universe.read_universe(spark, path, lines=True)

    return staged(spark, d, "universe", make).drop("pos")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as lines of a list of holdings: their nation's ticker, with blanks and cases as they occur in such lists."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    exchange = F.when(key % 5 == 0, "NYSE ARCA").when(key % 5 == 1, F.lit(None)).when(key % 5 == 2, " nasdaq gs ").otherwise("NASDAQ")
    note = F.when(key % 11 == 0, " (W/I) *").when(key % 11 == 1, "**").when(key % 11 == 2, ".b").otherwise("")
    bare = F.when(key % 19 == 3, "(w/i)").otherwise(F.concat(F.lit(" "), F.lower("n_name"), note))
    empty = lambda n, c: F.when(key % n != 0, F.col(c)).otherwise("")
    return s.select(key.alias("line"), F.when(key % 7 != 0, bare).alias("ticker"), empty(13, "s_name").alias("name"), empty(17, "r_name").alias("sector"), exchange.alias("exchange"))


def _constituents(spark: SparkSession, d: str) -> DataFrame:
    return universe.constituents(_lines(spark, d))[0]


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    return universe.constituents(_lines(spark, d))[1]


def _frame(spark: SparkSession, d: str) -> DataFrame:
    """Bars with gaps: every 50th without any field, the one before it without a volume."""
    gap = lambda c: F.when(F.col("idx") % 50 != 49, F.col(c)).alias(c)
    return bars(spark, d).select("ticker", "date", *[gap(c) for c in universe.FIELDS[:-1]], F.when(F.col("idx") % 50 < 48, F.col("volume")).alias("volume"))


def _clean_log(spark: SparkSession, d: str) -> DataFrame:
    return universe.cleaned(_frame(spark, d))[1]


def _clean_bars(spark: SparkSession, d: str) -> DataFrame:
    return universe.cleaned(_frame(spark, d))[0]


def _admission(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's nation and name asked for as tickers."""
    asked = _lines(spark, d).select(F.explode(F.array(universe.normalised(F.col("ticker")), "name")).alias("ticker")).filter("ticker IS NOT NULL").distinct()
    return universe.admitted(asked, filters.sufficiency(bars(spark, d)))


QUERIES: dict[str, QUERY] = {
    "template_breakdown": _breakdown,
    "exit_signal_bundle": _bundle,
    "exit_evidence": _evidence,
    "universe_stats": _universe_stats,
    "effective_samples": _effective,
    "current_regime": _current_regime,
    "simulation_window": _simulation,
    "derived_prices": _derived_prices,
    "exit_deltas": _exit_deltas,
    "exit_regime_baseline": _exit_regime_baseline,
    "climax_comparison": _climax_comparison,
    "hurdle_intersection": _intersection,
    "variant_evaluation": _variants,
    "consensus_weight_grid": _weight_grid,
    "portfolio_weights": _weights,
    "sparkline_points": _spark_points,
    "confidence_summary": _confidence,
    "regime_badges": _badges,
    "result_invariants": _invariants,
    "trend_recommend_custom": _custom,
    "universe_file": _universe_file,
    "constituents": _constituents,
    "excluded_lines": _excluded,
    "cleaned_bars": _clean_bars,
    "cleaning_log": _clean_log,
    "ticker_admission": _admission,
}
