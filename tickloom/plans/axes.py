"""All axes of a backtest in one pass over its performance, and a check that nothing looks ahead."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import STATES, STRATEGIES
from tickloom.functions.exprs import half_up
from tickloom.operators import backtest, screening, variants
from tickloom.plans import queries
from tickloom.plans.queries import QUERY, _basis, _dates, _features, _perf, _quality, _screened
from tickloom.run import Run, run_of
from tickloom.sources.stage import staged

KEYS = ["strategy", "sample", "basis", "quality", "regime", "state", "cohort", "days"]
#: By axis, the keys beside those of every axis, and the rows that it is of.
AXES = {
    "strategies": ([], "true"),
    "regimes": (["regime"], "regime IS NOT NULL AND quality = 'all'"),
    "states": (["state"], f"state IN {STATES} AND quality = 'all' AND basis = 'allSignals'"),
    "statesByRegime": (["state", "regime"], f"state IN {STATES} AND regime IS NOT NULL AND quality = 'all' AND basis = 'allSignals'"),
    "freshness": (["cohort"], "cohort IS NOT NULL AND quality = 'all' AND basis = 'allSignals'"),
}
ALWAYS = ["strategy", "sample", "basis", "quality", "days"]


def _cohorts(spark: SparkSession, d: str | Run) -> DataFrame:
    return variants.freshness(_screened(spark, d)).withColumnRenamed("date", "eval_date")


def _axes(spark: SparkSession, d: str | Run) -> DataFrame:
    """Every axis that signals fall into, from one scan of performance: grouping sets in place of a query for each axis.

    A set is told by which keys it leaves out, so an unknown regime isn't taken for the total over all regimes.
    """
    state = _screened(spark, d).select("ticker", F.col("date").alias("eval_date"), "state")
    p = _perf(spark, d).join(state, ["eval_date", "ticker"]).join(_cohorts(spark, d), ["eval_date", "ticker"])
    cohort = F.when(F.col("strategy") == STRATEGIES[0], F.col("cross_cohort")).when(F.col("strategy") == STRATEGIES[1], F.col("pivot_cohort"))
    rows = _quality(_basis(p.withColumn("cohort", cohort)))
    left_out = lambda own: sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in ALWAYS and k not in own)
    sets = [[*ALWAYS, *own] for own, _ in AXES.values()]
    r = lambda x: half_up(x, 4)
    got = rows.groupingSets([[F.col(c) for c in s] for s in sets], *KEYS).agg(
        F.grouping_id().alias("set"), F.count("*").alias("signals"), r(F.avg((F.col("excess") > 0).cast("int"))).alias("win_rate"), r(F.avg("excess")).alias("avg_excess"),
        r(F.percentile("excess", F.lit(0.5))).alias("median_excess"), r(F.avg("ret")).alias("avg_return"), r(F.avg("mdd")).alias("mdd"),
    )
    axis = F.coalesce(*[F.when(F.col("set") == left_out(own), name) for name, (own, _) in AXES.items()])
    of = F.coalesce(*[F.when(F.col("set") == left_out(own), F.expr(rows_)) for own, rows_ in AXES.values()])
    return got.filter(of).select(axis.alias("axis"), *KEYS, "signals", "win_rate", "avg_excess", "median_excess", "avg_return", "mdd")


def _lists(spark: SparkSession, run: Run) -> dict[str, DataFrame]:
    """What is known on a date, by part: rows with a column `date`."""
    s, f = queries._snapshot(spark, run)[1], _features(spark, run)
    six = lambda *columns: [half_up(F.col(c)).alias(c) for c in columns]
    named = lambda df: df.withColumnRenamed("eval_date", "date")
    return {
        "indicators": f.select("date", "ticker", "since_cross", "breakout", *six("ema26", "signal_line", "rsi14", "atr14", "adx14", "w52_high", "obv20")),
        "entries": f.select("date", "ticker", "state", "peak_idx", "p2", "p4", *six("pivot", "pullback_low", "resume_trigger")),
        "exits": f.select("date", "ticker", "x1", "x2", "x4", "x5"),
        "template": named(screening.template_recommend(s).drop("pos")),
        "trend": named(screening.trend_recommend(s, queries.PRESETS["default"]).drop("pos")),
        "regimes": queries._regimes(spark, run).withColumn("breadth", half_up(F.col("breadth"))),
    }


def _look_ahead(spark: SparkSession, d: str | Run) -> DataFrame:
    """By part, rows up to the middle evaluation date, and how many of them differ if no later bar is known.

    A list of a date must not change when later bars come. Dates that only one of the runs evaluates are left out, as the
    last dates are for want of bars ahead; a row that is in one of them alone counts as different.
    """
    whole = run_of(d)
    middle = _dates(spark, whole).agg(F.array_sort(F.collect_list("eval_date")).alias("a")).select(F.get("a", F.floor(F.size("a") / 2).cast("int"))).first()[0]
    empty = spark.createDataFrame([], "part string, checked long, differing long")
    if middle is None:
        return empty
    cut, out = dataclasses.replace(whole, until=middle.isoformat(), buffer=0), empty
    full, early = _lists(spark, whole), _lists(spark, cut)
    dates = _dates(spark, whole).intersect(_dates(spark, cut)).withColumnRenamed("eval_date", "date")
    for part in full:
        a, b = (x[part].filter(F.col("date") <= F.lit(middle)) for x in (full, early))
        if part in ("template", "trend"):
            a, b = a.join(dates, "date", "left_semi"), b.join(dates, "date", "left_semi")
        hashed = lambda df, sign: df.select(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]).alias("h"), F.lit(sign).alias("n"))
        odd = hashed(a, 1).unionByName(hashed(b, -1)).groupBy("h").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("differing"))
        out = out.unionByName(a.agg(F.count("*").alias("checked")).crossJoin(odd).select(F.lit(part).alias("part"), "checked", "differing"))
    return out


QUERIES: dict[str, QUERY] = {
    "backtest_axes": lambda spark, d: staged(spark, d, "axes", lambda: _axes(spark, d)),
    "look_ahead_check": _look_ahead,
}
