"""Cross-sections by evaluation date: snapshots, ranks, regimes, recommendations, consensus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import BUFFER_BARS, DOWN_ENTER, DOWN_EXIT, MAX_RESULTS, MIN_BARS, MIN_RESULTS, STEP, UP_ENTER, UP_EXIT, WARMUP, YEAR, Preset
from tickloom.functions.exprs import by, half_up


def trading_calendar(bars: DataFrame) -> DataFrame:
    """date, n of the ticker with most bars (first position on a tie)."""
    best = bars.groupBy("ticker").agg(F.count("*").alias("k"), F.min("pos").alias("pos")).agg(F.max_by("ticker", F.struct("k", -F.col("pos"))).alias("ticker"))
    return bars.join(F.broadcast(best), "ticker", "left_semi").select("date", F.col("idx").alias("n"))


def evaluation_dates(calendar: DataFrame, warmup: int = WARMUP, buffer: int = BUFFER_BARS, step: int = STEP) -> DataFrame:
    size = calendar.agg(F.count("*").alias("size"))
    grid = calendar.crossJoin(F.broadcast(size)).filter((F.col("n") >= warmup) & (F.col("n") < F.col("size") - buffer) & ((F.col("n") - warmup) % step == 0))
    return grid.select(F.col("date").alias("eval_date"))


def snapshots(f: DataFrame, dates: DataFrame) -> DataFrame:
    """The last bar of every ticker at or before each date (eval_date): equi-joins on days and on bars.

    A bar is current until the day before the ticker's next bar, the last one until the last date. These few days are
    spelled out for the bars' keys alone and met with the dates; of what is left the columns are fetched by ticker and bar.
    """
    keys = f.select("ticker", "block", "idx", "date").withColumn("_next", F.lead("date").over(by())).crossJoin(F.broadcast(dates.agg(F.max("eval_date").alias("_last"))))
    end = F.least(F.date_sub("_next", 1), "_last")
    days = keys.filter(end >= F.col("date")).select("ticker", "idx", F.explode(F.sequence("date", end)).alias("eval_date"))
    return f.join(days.join(dates, "eval_date"), ["ticker", "idx"]).select(*f.columns, "eval_date")


def with_template(s: DataFrame) -> DataFrame:
    """Sufficiency, RS percentile, t1 to t8, n_passed."""
    c, s50, s150, s200 = (F.col(x) for x in ("close", "sma50", "sma150", "sma200"))
    full = F.col("idx") + 1 >= YEAR
    rs = F.cume_dist().over(Window.partitionBy("eval_date", full).orderBy("rs_raw")) * 100
    s = s.withColumns({"sufficient": F.col("idx") + 1 >= MIN_BARS, "full_year": full, "rs_pct": F.when(full, rs)})
    no = lambda x: F.coalesce(x, F.lit(False))
    checks = {
        "t1": (c > s150) & (c > s200),
        "t2": s150 > s200,
        "t3": s200 > F.col("sma200_prior"),
        "t4": (s50 > s150) & (s150 > s200),
        "t5": c > s50,
        "t6": c >= F.col("w52_low") * 1.3,
        "t7": c >= F.col("w52_high") * 0.75,
        "t8": F.col("rs_pct") >= 70,
    }
    s = s.withColumns({k: F.when(F.col("full_year"), no(x)) for k, x in checks.items()})
    return s.withColumn("n_passed", F.when(F.col("full_year"), sum((F.col(k).cast("int") for k in checks), F.lit(0))))


def sector_returns(s: DataFrame) -> DataFrame:
    """eval_date, sector, avg_return, members, leading (best three of those with two members or more)."""
    got = s.filter("sufficient").groupBy("eval_date", "sector").agg(F.avg("sim_return").alias("avg_return"), F.count("*").alias("members"), F.min("pos").alias("first")).filter("members >= 2")
    rank = F.row_number().over(Window.partitionBy("eval_date").orderBy(F.desc(half_up(F.col("avg_return"), 8)), "first"))
    return got.select("eval_date", "sector", "avg_return", "members", (rank <= 3).alias("leading"))


def breadth(f: DataFrame, calendar: DataFrame) -> DataFrame:
    """n, date, breadth: share of tickers above their 200-bar average, null without any. f: ticker, idx, date, close, sma200."""
    enough = F.count("*").over(Window.partitionBy("ticker")) >= MIN_BARS
    above = f.withColumn("ok", enough).filter("ok").groupBy("date").agg(F.avg((F.col("close") > F.col("sma200")).cast("int")).alias("breadth"))
    return calendar.join(above, "date", "left").select("n", "date", "breadth")


STATES = (None, "up", "neutral", "down")
#: Days folded at once: in a block, and blocks in a group.
FOLDED = 256


def _turned(state: Column, v: Column) -> Column:
    """The state after a day of breadth v."""
    first = F.when(v >= UP_EXIT, "up").when(v < DOWN_ENTER, "down").otherwise("neutral")
    return (
        F.when(v.isNull(), state)
        .when(state.isNull(), first)
        .when((state == "up") & (v < UP_EXIT), "neutral")
        .when((state == "neutral") & (v > UP_ENTER), "up")
        .when((state == "neutral") & (v < DOWN_ENTER), "down")
        .when((state == "down") & (v > DOWN_EXIT), "neutral")
        .otherwise(state)
    )


def _known(state: Column, since: Column) -> Column:
    return F.struct(state.cast("string").alias("state"), since.cast("date").alias("since"))


def _follow(into: Column, to: Column) -> Column:
    """What a map (to: by state at the start) makes of a state and the day since when it holds."""
    return F.coalesce(*[F.when(into["state"].eqNullSafe(F.lit(s)), _known(to[k]["state"], F.coalesce(to[k]["since"], into["since"]))) for k, s in enumerate(STATES)])


def _starts(maps: Column, into: Column, key: str) -> Column:
    """key and into of each map in a sorted array: what it starts from, if the first one starts from `into`."""
    zero = F.struct(into.alias("into"), F.array().cast(f"array<struct<{key}:bigint,into:struct<state:string,since:date>>>").alias("out"))
    row = lambda acc, x: F.struct(x[key].alias(key), acc["into"].alias("into"))
    return F.aggregate(maps, zero, lambda acc, x: F.struct(_follow(acc["into"], x["map"]).alias("into"), F.concat(acc["out"], F.array(row(acc, x))).alias("out")))["out"]


def _composed(days: Column, step: Callable[[Column, Column], Column]) -> Column:
    """By state at the start, what a sorted array ends in: a map of states to states (since null where nothing changes)."""
    return F.array(*[F.aggregate(days, _known(F.lit(s), F.lit(None)), step) for s in STATES])


def regimes(b: DataFrame) -> DataFrame:
    """date, breadth, regime, transition_date of b (n, date, breadth): the state with hysteresis, as a scan of maps.

    A day turns each state into one; so does a block of days, and a group of blocks. Blocks are folded for all states
    at once, in parallel, then groups; what each group and block starts from follows from the maps before it, and each block is
    gone through again from there. Only the groups' maps, one for 65,536 days, are folded in one task.
    """
    turn = lambda acc, x: _known(_turned(acc["state"], x["breadth"]), F.when(_turned(acc["state"], x["breadth"]).eqNullSafe(acc["state"]), acc["since"]).otherwise(x["date"]))
    block = F.floor(F.col("n") / FOLDED)
    days = b.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "date", "breadth"))).alias("days"))
    maps = days.select("block", F.floor(F.col("block") / FOLDED).alias("group"), _composed(F.col("days"), turn).alias("map"))
    gathered = lambda key: F.array_sort(F.collect_list(F.struct(key, "map")))
    groups = maps.groupBy("group").agg(gathered("block").alias("blocks"))
    of_groups = groups.select("group", _composed(F.col("blocks"), lambda acc, x: _follow(acc, x["map"])).alias("map")).agg(gathered("group").alias("all"))
    of_groups = of_groups.select(F.inline(_starts(F.col("all"), _known(F.lit(None), F.lit(None)), "group")))
    of_blocks = groups.join(of_groups, "group").select(F.inline(_starts(F.col("blocks"), F.col("into"), "block")))
    row = "struct<date:date,breadth:double,regime:string,transition_date:date>"

    def write(acc: Column, x: Column) -> Column:
        now, seen = turn(acc["now"], x), x["breadth"].isNotNull()
        one = F.struct(x["date"].alias("date"), x["breadth"].alias("breadth"), F.when(seen, now["state"]).alias("regime"), F.when(seen, now["since"]).alias("transition_date")).cast(row)
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(one)).alias("out"))

    last_ = F.aggregate("days", F.struct(F.col("into").alias("now"), F.array().cast(f"array<{row}>").alias("out")), write)
    return days.join(of_blocks, "block").select(F.inline(last_["out"]))


def trend_score(leading: Column) -> Column:
    part = lambda x, top, points: F.greatest(F.lit(0.0), F.least(F.coalesce(F.col(x), F.lit(0.0)), F.lit(float(top)))) / top * points
    return half_up(part("disparity", 15, 60) + part("vol_trend", 50, 30) + F.when(leading, 10).otherwise(0), 1)


def trend_stage1(s: DataFrame, preset: Preset) -> DataFrame:
    """Sufficient tickers with score, level (the first relaxation level with five passers) and signal."""
    sectors = sector_returns(s).filter("leading").select("eval_date", "sector", F.lit(True).alias("leading"))
    s = s.filter("sufficient").join(sectors, ["eval_date", "sector"], "left").withColumn("score", trend_score(F.coalesce("leading", F.lit(False))))
    base = (F.col("rsi14") >= preset.rsi_min) & (F.col("macd_line") > 0)
    within = lambda n: F.coalesce(F.col("since_cross") < n, F.lit(False))
    s = s.withColumns({"p0": base & within(preset.cross_window), "p1": base & within(preset.relaxed_window), "p2": base})
    day = Window.partitionBy("eval_date")
    n = lambda c: F.sum(F.col(c).cast("int")).over(day)
    s = s.withColumn("level", F.when(n("p0") >= MIN_RESULTS, "strict").when(n("p1") >= MIN_RESULTS, "relaxed10d").otherwise("rsiMacdOnly"))
    return s.withColumn("signal", F.when(F.col("level") == "strict", F.col("p0")).when(F.col("level") == "relaxed10d", F.col("p1")).otherwise(F.col("p2")))


def trend_recommend(s: DataFrame, preset: Preset) -> DataFrame:
    """Up to ten tickers a date: passers of the date's level, then high scores without a signal."""
    s = trend_stage1(s, preset).filter(F.col("signal") | (F.col("score") >= preset.high_score))
    rank = F.row_number().over(Window.partitionBy("eval_date").orderBy(F.desc("score"), F.desc("signal"), "pos"))
    return s.withColumn("rank", rank).filter(F.col("rank") <= MAX_RESULTS).select("eval_date", "ticker", "sector", "pos", "score", "signal", "level", "rank")


def vcp_score() -> Column:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    rs = unit((F.coalesce("rs_pct", F.lit(0.0)) - 70) / 30) * 40
    tight = F.coalesce(unit((1 - F.least("contraction", F.lit(1.0))) / 0.5) * 25, F.lit(0.0))
    tight = F.when(F.col("contraction").isNull(), 0.0).otherwise(tight)
    dry = F.when(F.col("dryup").isNull() | (F.col("dryup") > 0), 0.0).otherwise(F.least(F.abs("dryup"), F.lit(30.0)) / 30 * 15)
    near = F.when(F.col("proximity").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (10 - F.least("proximity", F.lit(10.0))) / 10) * 20)
    return half_up(rs + tight + dry + near, 1)


def template_recommend(s: DataFrame) -> DataFrame:
    """Every ticker that passes the trend template (8 of 8; 7 of 8 where fewer than five do), by VCP score."""
    day = Window.partitionBy("eval_date")
    s = s.filter("full_year").withColumn("strict", F.sum((F.col("n_passed") == 8).cast("int")).over(day) >= MIN_RESULTS)
    s = s.filter(F.col("n_passed") >= F.when(F.col("strict"), 8).otherwise(7)).withColumn("score", vcp_score())
    rank = F.row_number().over(day.orderBy(F.desc("score"), "pos"))
    return s.select("eval_date", "ticker", "sector", "pos", "score", F.when(F.col("strict"), "strict").otherwise("relaxed7of8").alias("level"), rank.alias("rank"))


def gate(listed: DataFrame, regime: DataFrame) -> DataFrame:
    """In a downturn relaxed lists are dropped."""
    at = regime.select(F.col("date").alias("eval_date"), "regime")
    return listed.join(F.broadcast(at), "eval_date", "left").filter(~((F.coalesce("regime", F.lit("")) == "down") & (F.col("level") != "strict")))


def consensus(trend: DataFrame, template: DataFrame) -> DataFrame:
    """Both lists as one: two stars where a ticker is on both; rank runs over the whole date, two stars first."""
    pct = F.cume_dist().over(Window.partitionBy("eval_date").orderBy("score")) * 100
    a = trend.select("eval_date", "ticker", F.col("rank").alias("trend_rank"), F.col("score").alias("trend_score"), F.col("level").alias("trend_level"), pct.alias("a"))
    b = template.select("eval_date", "ticker", F.col("rank").alias("template_rank"), F.col("score").alias("template_score"), F.col("level").alias("template_level"), pct.alias("b"))
    j = a.join(b, ["eval_date", "ticker"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    j = j.withColumns({"stars": F.when(both, 2).otherwise(1), "consensus_pct": F.when(both, (F.col("a") + F.col("b")) / 2).otherwise(F.coalesce("a", "b"))})
    order = Window.partitionBy("eval_date").orderBy(F.desc("stars"), F.desc(half_up(F.col("consensus_pct"), 8)), F.col("trend_rank").asc_nulls_last(), "template_rank")
    relaxed = F.coalesce("trend_level", "template_level") != "strict"
    return j.withColumn("rank", F.row_number().over(order)).withColumn("relaxed", relaxed)
