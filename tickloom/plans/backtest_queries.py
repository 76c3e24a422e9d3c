"""Named backtest queries: entry fills, exit walks, axes, policies, scoring variants, filters and plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.config import BASES, COHORTS, PRESETS, REGIMES, SAMPLES, STATES, STRATEGIES
from tickloom.functions.exprs import half_up
from tickloom.operators import backtest, filters, fundamentals, paths, portfolio, screening, variants
from tickloom.plans.queries import QUERY, _basis, _features, _lists, _perf, _regimes, _sampled, _screened, _signals, _snapshot
from tickloom.run import run_of
from tickloom.sources.bars import bars, quarters
from tickloom.sources.stage import staged

#: Pairs of rules that are published (fixed values), named by both.
COMBOS = {
    f"{entry}+{rule}": (entry, rule)
    for entry, rule in (
        ("entry_pivot_confirm2", "exit_stop_atr"),
        ("entry_pivot_trigger_vol", "exit_sma50_break"),
        ("entry_pivot_confirm2", "exit_sma50_break"),
        ("pullback_resume_vol", "exit_structural"),
        ("entry_close", "exit_regime_conditional"),
    )
}


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Gated trend signals ranked anew, with sample, regime and p1."""
    trend, _ = _lists(spark, d)
    p1 = _snapshot(spark, d)[1].select("eval_date", "ticker", F.coalesce(F.col("n_passed") == 8, F.lit(False)).alias("p1"))
    again = F.row_number().over(Window.partitionBy("eval_date").orderBy("rank"))
    r = trend.filter("signal").select("eval_date", "ticker", again.alias("rank"), (F.col("level") != "strict").alias("relaxed"), "regime")
    return staged(spark, d, "records", lambda: _sampled(spark, d, r.join(p1, ["eval_date", "ticker"])))


def _out_top5(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter("rank <= 5 AND sample = 'out'")


def _filled(spark: SparkSession, d: str, name: str, records: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    f = _features(spark, d)
    return paths.fills(paths.at_signal(_records(spark, d) if records is None else records, f), f, name), f


def _fill(name: str) -> QUERY:
    def query(spark: SparkSession, d: str) -> DataFrame:
        s, _ = _filled(spark, d, name)
        return s.select("eval_date", "ticker", (F.col("fill_idx") - F.col("at")).alias("wait"), half_up(F.col("price")).alias("price"))

    return query


def _walked(spark: SparkSession, d: str, entry: str, rules: list[str], records: DataFrame | None = None) -> DataFrame:
    s, f = _filled(spark, d, entry, records)
    regimes = _regimes(spark, d) if "exit_regime_flip" in rules else None
    return paths.with_benchmark(paths.exits(s, f, rules, regimes), f)


def _exit(rule: str) -> QUERY:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _walked(spark, d, "entry_close", [rule]).select("eval_date", "ticker", "days", "stop_hit", *[half_up(F.col(c)).alias(c) for c in ("ret", "excess", "mdd")])

    return query


def _exit_variants(spark: SparkSession, d: str) -> DataFrame:
    got = _walked(spark, d, "entry_close", list(paths.EXITS), _out_top5(spark, d))
    return backtest.summarize(got, ["rule"], half_up(F.avg("days"), 4).alias("avg_days"), half_up(F.avg(F.col("stop_hit").cast("int")), 4).alias("stop_rate"))


def _exit_regime_detail(spark: SparkSession, d: str) -> DataFrame:
    got = _walked(spark, d, "entry_close", list(paths.EXITS), _out_top5(spark, d)).filter("regime IS NOT NULL")
    return backtest.summarize(got, ["rule", "regime"], half_up(F.avg("days"), 4).alias("avg_days"), half_up(F.avg(F.col("stop_hit").cast("int")), 4).alias("stop_rate"))


def _combos(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, (entry, rule) in COMBOS.items():
        one = _walked(spark, d, entry, [rule], _out_top5(spark, d)).withColumn("combo", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return backtest.summarize(out, ["combo"], half_up(F.avg("days"), 4).alias("avg_days"))


def _by_entry(spark: SparkSession, d: str, kind: str, records: DataFrame) -> DataFrame:
    """A row for each rule of a kind, signal and length: filled, and what was measured of it. All rules share one walk and one benchmark."""
    f, rules = _features(spark, d), None
    s = paths.at_signal(records, f)
    for name in [n for n, e in paths.ENTRIES.items() if e.kind == kind]:
        one = paths.fills(s, f, name).withColumn("rule", F.lit(name))
        rules = one if rules is None else rules.unionByName(one)
    key = [*paths.KEY, "rule"]
    perf = paths.with_benchmark(paths.held(rules, f, run_of(d).horizons, "rule"), f).select(*key, "days", "excess", "ret", "mdd")
    every = rules.withColumns({"filled": F.col("fill_idx").isNotNull().cast("int"), "days": F.explode(F.array(*[F.lit(h) for h in run_of(d).horizons]))})
    return every.join(perf, [*key, "days"], "left")


def _entry_summary(every: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: fill rate, and figures of the measured signals and of all signals, of which unmeasured ones count as nothing."""
    r, zero = (lambda x: half_up(x, 4)), (lambda c: F.coalesce(c, F.lit(0.0)))
    middle = lambda x: r(F.percentile(x, F.lit(0.5)))
    return every.groupBy(*keys).agg(
        F.count("*").alias("signals"), r(F.avg("filled")).alias("fill_rate"), F.count("excess").alias("measured"),
        r(F.avg((F.col("excess") > 0).cast("int"))).alias("win_rate"), r(F.avg("excess")).alias("avg_excess"), middle(F.col("excess")).alias("median_excess"), r(F.avg("ret")).alias("avg_return"), r(F.avg("mdd")).alias("mdd"),
        r(F.avg((zero("excess") > 0).cast("int"))).alias("opportunity_win_rate"), r(F.avg(zero("excess"))).alias("opportunity_excess"), middle(zero("excess")).alias("opportunity_median"),
        r(F.avg(zero("ret"))).alias("opportunity_return"), r(F.avg(zero("mdd"))).alias("opportunity_mdd"),
    )


def _entry_variants(spark: SparkSession, d: str) -> DataFrame:
    """Breakout entries of the top five trend signals out of sample, by rule and length."""
    return _entry_summary(_by_entry(spark, d, "breakout", _out_top5(spark, d)), ["rule", "days"])


def _climax_positions(spark: SparkSession, d: str) -> DataFrame:
    """Top five trend signals out of sample of which half ends at the first climax."""

    def make() -> DataFrame:
        s, f = _filled(spark, d, "entry_close", _out_top5(spark, d))
        legs = paths.with_benchmark(paths.legged(s, f, paths.climax_legs(s, f)), f)
        return paths.joined_legs(legs, "regime").withColumn("triggered", F.col("n_legs") > 1)

    return staged(spark, d, "climax_positions", make)


def _three_legs(spark: SparkSession, d: str) -> DataFrame:
    """Trend signals of which a quarter ends after 10 bars, a third after 40, and the rest after 60."""
    s, f = _filled(spark, d, "entry_close")
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("days"), F.lit(r).alias("ratio")) for n, r in ((10, 0.25), (40, 1 / 3))])).alias("x")
    legs = s.select(*paths.KEY, parts).select(*paths.KEY, "x.days", "x.ratio")
    got = paths.joined_legs(paths.with_benchmark(paths.legged(s, f, legs), f))
    return got.select(*paths.KEY, "n_legs", *[half_up(F.col(c)).alias(c) for c in ("held", "ret", "excess", "mdd")])


def _climax(spark: SparkSession, d: str) -> DataFrame:
    return _climax_positions(spark, d).select("eval_date", "ticker", "triggered", "held", *[half_up(F.col(c)).alias(c) for c in ("ret", "excess", "mdd")])


def _pullback_checks(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return f.filter("pivot IS NOT NULL").select("ticker", "idx", "peak_idx", "p2", "p3", "p4", *[half_up(F.col(c)).alias(c) for c in ("depth_pct", "pullback_low", "resume_trigger")])


def _funnel(spark: SparkSession, d: str) -> DataFrame:
    s = _basis(paths.at_signal(_records(spark, d), _features(spark, d))).filter("regime IS NOT NULL")
    ok, steps = F.col("pivot").isNotNull(), [F.col(c) for c in ("p1", "p2", "p3", "p4")]
    counts = [F.count_if(F.coalesce(ok & _all(steps[:k]), F.lit(False))).alias(n) for k, n in ((1, "p1"), (2, "p1p2"), (3, "p1p2p3"), (4, "observed"))]
    return s.groupBy("sample", "basis", "regime").agg(F.count("*").alias("signals"), F.count_if(~ok).alias("insufficient"), *counts)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _pullback_axis(spark: SparkSession, d: str) -> DataFrame:
    """Pullback entries of trend signals by rule, sample, basis, regime and length, groups without signals included."""
    keys = ["rule", "sample", "basis", "regime", "days"]
    every = _basis(_by_entry(spark, d, "pullback", _records(spark, d).filter("regime IS NOT NULL")))
    rules = tuple(n for n, e in paths.ENTRIES.items() if e.kind == "pullback")
    cells = {"rule": rules, "sample": SAMPLES, "basis": BASES, "regime": REGIMES, "days": run_of(d).horizons}
    whole = backtest.with_empty_cells(_entry_summary(every, keys), cells)
    return whole.withColumn("measured", F.coalesce("measured", F.lit(0).cast("long")))


def _signal_performance(spark: SparkSession, d: str) -> DataFrame:
    return _perf(spark, d).select("eval_date", "ticker", "strategy", "days", "sample", "regime", half_up(F.col("ret")).alias("ret"), half_up(F.col("excess")).alias("excess"), half_up(F.col("mdd")).alias("mdd"))


def _stated(spark: SparkSession, d: str) -> DataFrame:
    state = _screened(spark, d).select("ticker", F.col("date").alias("eval_date"), "state").filter("state <> 'undetermined'")
    return _perf(spark, d).join(state, ["eval_date", "ticker"])


def _state_axis(spark: SparkSession, d: str) -> DataFrame:
    table = backtest.summarize(_stated(spark, d), ["strategy", "sample", "state", "days"])
    return backtest.with_empty_cells(table, {"strategy": STRATEGIES, "sample": SAMPLES, "state": STATES, "days": run_of(d).horizons})


def _state_regime_axis(spark: SparkSession, d: str) -> DataFrame:
    table = backtest.summarize(_stated(spark, d).filter("regime IS NOT NULL"), ["strategy", "sample", "state", "regime", "days"])
    return backtest.with_empty_cells(table, {"strategy": STRATEGIES, "sample": SAMPLES, "state": STATES, "regime": REGIMES, "days": run_of(d).horizons})


def _freshness_axis(spark: SparkSession, d: str) -> DataFrame:
    fresh = variants.freshness(_screened(spark, d)).withColumnRenamed("date", "eval_date")
    j = _perf(spark, d).filter(F.col("strategy").isin(*STRATEGIES[:2])).join(fresh, ["eval_date", "ticker"])
    j = j.withColumn("cohort", F.when(F.col("strategy") == STRATEGIES[0], F.col("cross_cohort")).otherwise(F.col("pivot_cohort")))
    table = backtest.summarize(j, ["strategy", "sample", "cohort", "days"])
    return backtest.with_empty_cells(table, {"strategy": STRATEGIES[:2], "sample": SAMPLES, "cohort": COHORTS, "days": run_of(d).horizons})


#: By policy: the signals that it picks from, what it keeps of them, and the least sample to judge it on (fixed values).
POLICIES: dict[str, tuple[tuple[str, ...], Callable[[], Column], int]] = {
    "relax_off_in_downturn": (STRATEGIES[:1], lambda: ~(F.col("regime").eqNullSafe("down") & F.col("relaxed")), 50),
    "twostar_only_in_downturn": (STRATEGIES[2:], lambda: ~(F.col("regime").eqNullSafe("down") & (F.col("strategy") == STRATEGIES[3])), 50),
    "actionable_only_top5": (STRATEGIES[:1], lambda: F.col("state").isin("1", "2"), 100),
}


def _policy_arms(spark: SparkSession, d: str) -> DataFrame:
    """Top five out of sample re-picked under each policy, and the top five as they are; 20 bars. All policies share one pass over the signals."""
    p = _perf(spark, d).filter("sample = 'out' AND days = 20").drop("rank", "relaxed", "regime", "sample")
    # Five survive of all signals of a date, before it is known which of them have a bar 20 days on.
    every = _sampled(spark, d, _signals_with_state(spark, d)).filter("sample = 'out'")
    judged = [F.when(F.col("strategy").isin(*names), F.struct(F.lit(name).alias("policy"), F.coalesce(keep(), F.lit(False)).alias("kept"))) for name, (names, keep, _) in POLICIES.items()]
    pool = every.withColumn("x", F.explode(F.array_compact(F.array(*judged)))).select("eval_date", "ticker", "strategy", "rank", "x.policy", "x.kept")
    place = F.row_number().over(Window.partitionBy("policy", "eval_date").orderBy(F.desc("kept"), "rank"))
    arms = F.array_compact(F.array(F.when(F.col("kept") & (F.col("place") <= 5), "policy"), F.when(F.col("rank") <= 5, "baseline")))
    picked = pool.withColumn("place", place).select("eval_date", "ticker", "strategy", "policy", F.explode(arms).alias("arm"))
    return picked.join(p, ["eval_date", "ticker", "strategy"])


def _policies(spark: SparkSession, d: str) -> DataFrame:
    return backtest.with_empty_cells(backtest.summarize(_policy_arms(spark, d), ["policy", "arm"]), {"policy": tuple(POLICIES), "arm": ("policy", "baseline")})


def _policy_deltas(spark: SparkSession, d: str) -> DataFrame:
    """By policy: differences to the top five as they are, and whether a large enough sample is no worse."""
    s = _policies(spark, d)
    side = lambda arm: s.filter(F.col("arm") == arm).select("policy", *[F.col(c).alias(f"{arm}_{c}") for c in ("signals", "avg_excess", "win_rate")])
    delta = lambda c: half_up(F.col(f"policy_{c}") - F.col(f"baseline_{c}"), 4)
    least = F.create_map(*[F.lit(x) for name, (_, _, n) in POLICIES.items() for x in (name, n)])[F.col("policy")]
    j = side("policy").join(side("baseline"), "policy").select("policy", "policy_signals", "baseline_signals", delta("avg_excess").alias("excess_delta"), delta("win_rate").alias("win_rate_delta"), least.alias("least_signals"))
    enough = F.col("policy_signals") >= F.col("least_signals")
    meets = enough & F.coalesce((F.col("excess_delta") >= 0) & (F.col("win_rate_delta") >= 0), F.lit(False))
    return j.withColumns({"sufficient_sample": enough, "meets_criteria": meets})


def _signals_with_state(spark: SparkSession, d: str) -> DataFrame:
    state = _screened(spark, d).select("ticker", F.col("date").alias("eval_date"), "state")
    at = _regimes(spark, d).select(F.col("date").alias("eval_date"), "regime")
    signals = staged(spark, d, "signals", lambda: _signals(spark, d))
    return signals.join(state, ["eval_date", "ticker"], "left").join(at, "eval_date", "left")


def _ungated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = _snapshot(spark, d)[1]
    return s, screening.trend_recommend(s, PRESETS["default"]), screening.template_recommend(s)


def _inverted(spark: SparkSession, d: str) -> DataFrame:
    s, trend, _ = _ungated(spark, d)
    return variants.inverted_u(s, trend)


def _adx_gate(spark: SparkSession, d: str) -> DataFrame:
    return variants.adx_gate(_snapshot(spark, d)[1], PRESETS["default"])


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    _, trend, template = _ungated(spark, d)
    return variants.weighted_consensus(screening.consensus(trend, template))


def _combo_filter(spark: SparkSession, d: str) -> DataFrame:
    s = _flagged(spark, d)
    chosen = filters.Filters(disparity_min=0.0, volume_trend_min=-20.0, week52="nearHigh", stochastic="overbought", obv="rising")
    return s.filter(filters.condition(chosen)).select("eval_date", "ticker")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    s = filters.with_population(_snapshot(spark, d)[1])
    sectors = screening.sector_returns(s).filter("leading").select("eval_date", "sector", F.lit(True).alias("lead"))
    return s.join(sectors, ["eval_date", "sector"], "left").withColumn("leading", F.coalesce("lead", F.lit(False))).drop("lead")


def _filter_counts(spark: SparkSession, d: str) -> DataFrame:
    """By date, how many tickers pass each toggle."""
    s = _flagged(spark, d)
    passed = [F.count_if(F.coalesce(filters.condition(x), F.lit(False))).alias(n) for n, x in filters.TOGGLES.items()]
    return s.groupBy("eval_date").agg(*passed, F.count_if(F.col("sufficient") & F.col("w52_high").isNull()).alias("week52_excluded"))


def _atr_percentile(spark: SparkSession, d: str) -> DataFrame:
    s = _flagged(spark, d).filter("sufficient")
    return s.select("eval_date", "ticker", half_up(F.col("atr_rank"), 4).alias("atr_rank"), (F.col("atr_rank") <= 30).alias("low"), (F.col("atr_rank") >= 70).alias("high"))


def _guardrail(spark: SparkSession, d: str) -> DataFrame:
    # volumes here are unit counts, so the floor of traded value is lower than the default
    return filters.liquidity(bars(spark, d), min_dollars=50_000.0)


def _sufficiency(spark: SparkSession, d: str) -> DataFrame:
    return filters.sufficiency(bars(spark, d))


def _text(spark: SparkSession, d: str) -> DataFrame:
    """Tickers with bars whose name or sector holds the text, ignoring case and outer blanks, and how many bars they have."""
    found = bars(spark, d).filter(filters.text_match(" _1", "ticker", "sector"))
    return found.groupBy("ticker", "sector").agg(F.count("*").alias("bars"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    m = fundamentals.metrics(quarters(spark, d))
    return m.select("ticker", *[half_up(F.col(c), 4).alias(c) for c in ("eps_yoy", "revenue_yoy")], "roe", "margin_up", "accelerating")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return fundamentals.hurdle(fundamentals.metrics(quarters(spark, d))).select("ticker", "verdict")


def _with_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    from tickloom.plans.queries import QUERIES

    trend, _ = _lists(spark, d)
    history = QUERIES["fundamental_history"](spark, d)
    return fundamentals.as_of(trend.filter("signal").select("eval_date", "ticker", "rank"), history)


def _fundamental_axis(spark: SparkSession, d: str) -> DataFrame:
    p = _perf(spark, d).filter(F.col("strategy") == STRATEGIES[0])
    v = _with_fundamentals(spark, d).filter("verdict IN ('pass', 'partial', 'fail')").select("eval_date", "ticker", "verdict")
    return backtest.summarize(p.join(v, ["eval_date", "ticker"]), ["verdict", "days"])


def _split_visible(spark: SparkSession, d: str) -> DataFrame:
    """Trend signals of every date with the latest verdict; only a failed one hides a ticker."""
    trend, _ = _lists(spark, d)
    v = _verdicts(spark, d)  # one row a ticker
    return trend.filter("signal").join(v, "ticker", "left").select("eval_date", "ticker", "verdict", (~F.col("verdict").eqNullSafe("fail")).alias("visible"))


def _portfolio(spark: SparkSession, d: str) -> DataFrame:
    trend = screening.trend_recommend(_snapshot(spark, d)[1], PRESETS["default"])
    s = _snapshot(spark, d)[1].select("eval_date", "ticker", "sim_return", "volatility")
    picks = trend.join(s, ["eval_date", "ticker"]).withColumn("weight", F.col("score"))
    return portfolio.weighted(picks)


def _pie(spark: SparkSession, d: str) -> DataFrame:
    trend = screening.trend_recommend(_snapshot(spark, d)[1], PRESETS["default"])
    return portfolio.pie(trend.select("eval_date", "ticker", F.col("score").alias("weight")))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Plans of positions opened at each ticker's bar 200, at that close."""
    f = _features(spark, d)
    opened = f.filter("idx = 200").select("ticker", F.col("close").alias("entry_price"), F.col("date").alias("entry_date"))
    return portfolio.plan(opened, f)


def _sparkline(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.sparkline(bars(spark, d))


QUERIES: dict[str, QUERY] = {
    **{f"fill_{n}": _fill(n) for n in paths.ENTRIES},
    **{n: _exit(n) for n in paths.EXITS},
    "exit_variants": _exit_variants,
    "exit_regime_detail": _exit_regime_detail,
    "combos": _combos,
    "entry_variants_axis": _entry_variants,
    "climax_partial": _climax,
    "three_leg_positions": _three_legs,
    "pullback_checks": _pullback_checks,
    "pullback_funnel": _funnel,
    "pullback_axis": _pullback_axis,
    "signal_performance": _signal_performance,
    "state_axis": _state_axis,
    "state_regime_axis": _state_regime_axis,
    "freshness_axis": _freshness_axis,
    "policy_variants": _policies,
    "policy_deltas": _policy_deltas,
    "variant_inverted_u": _inverted,
    "variant_adx_gate": _adx_gate,
    "variant_consensus_weighted": _weighted,
    "filter_combo": _combo_filter,
    "filter_counts": _filter_counts,
    "atr_percentile_filter": _atr_percentile,
    "bars_liquidity_guardrail": _guardrail,
    "ticker_sufficiency": _sufficiency,
    "text_search": _text,
    "fundamental_metrics": _metrics,
    "fundamental_hurdle": _verdicts,
    "fundamental_asof": _with_fundamentals,
    "fundamental_axis": _fundamental_axis,
    "recommend_fundamental_split": _split_visible,
    "portfolio_weighted": _portfolio,
    "pie_buckets": _pie,
    "position_plan": _positions,
    "sparkline_change": _sparkline,
}
