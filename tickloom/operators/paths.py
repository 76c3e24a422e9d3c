"""Walks from a signal over later bars: fills by entry rule, exits by exit rule, and their performance.

A walk is one row for each signal and bar ahead, met by an equi-join on ticker and index, so a signal never meets all
bars of its ticker. A rule is a Column over that row; the first bar where it holds is a minimum over structs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import ATR_STOP, HOLD, PIVOT_STOP, PULLBACK_STOP, RESUME_WINDOW, STOP, TRAIL, TRIGGER_WINDOW, VOL_MULT

KEY = ["eval_date", "ticker"]


@dataclass(frozen=True)
class Entry:
    """hit: where a bar ahead (a_...) fills; None: filled at the signal's close. observed: needs p1 to p4."""

    window: int
    hit: Callable[[], Column] | None
    price: Callable[[], Column] | None
    kind: str = "breakout"
    observed: bool = False
    delay: int = 0


def _loud() -> Column:
    return F.coalesce(F.col("a_volume") >= VOL_MULT * F.col("a_vsma50"), F.lit(False))


def _trigger() -> Column:
    return F.col("a_high") >= F.col("trigger")


def _resumed() -> Column:
    return F.col("a_close") > F.col("resume_trigger")


ENTRIES: dict[str, Entry] = {
    "entry_close": Entry(0, None, None),
    "entry_pivot_trigger": Entry(TRIGGER_WINDOW, _trigger, lambda: F.greatest("trigger", "a_open")),
    "entry_pivot_trigger_vol": Entry(TRIGGER_WINDOW, lambda: _trigger() & _loud(), lambda: F.greatest("trigger", "a_open")),
    "entry_pivot_confirm2": Entry(TRIGGER_WINDOW, lambda: (F.col("offset") >= 2) & (F.col("a_close") > F.col("pivot")) & (F.col("a_before") > F.col("pivot")), lambda: F.col("a_next_open"), delay=1),
    "pullback_immediate": Entry(0, None, None, "pullback", True),
    "pullback_resume": Entry(RESUME_WINDOW, _resumed, lambda: F.greatest("resume_trigger", "a_open"), "pullback", True),
    "pullback_resume_vol": Entry(RESUME_WINDOW, lambda: _resumed() & _loud(), lambda: F.greatest("resume_trigger", "a_open"), "pullback", True),
}

#: Whether a position ends on a bar ahead: a Column over price, peak, a_... and the features of the bar of entry.
EXITS: dict[str, Callable[[], Column]] = {
    "exit_stop8_time60": lambda: F.col("a_close") <= F.col("price") * (1 - STOP),
    "exit_stop8_trail15": lambda: (F.col("a_close") <= F.col("price") * (1 - STOP)) | (F.col("a_close") <= F.col("peak") * (1 - TRAIL)),
    "exit_stop_atr": lambda: F.col("a_close") <= F.col("price") - ATR_STOP * F.col("e_atr14"),
    "exit_sma50_break": lambda: F.col("a_x1"),
    "exit_climax": lambda: F.col("a_x4"),
    "exit_regime_conditional": lambda: ~F.col("regime").eqNullSafe("up") & (F.col("a_close") <= F.col("price") - ATR_STOP * F.col("e_atr14")),
    "exit_regime_flip": lambda: F.col("a_flip"),
    "exit_structural": lambda: F.col("a_close") <= F.when(F.col("kind") == "breakout", F.col("e_pivot") * PIVOT_STOP).otherwise(F.col("e_pullback_low") * PULLBACK_STOP),
}


def at_signal(signals: DataFrame, f: DataFrame) -> DataFrame:
    """Signals on the exact date of a bar, with what their bar knows; others are dropped."""
    known = f.select("ticker", F.col("date").alias("eval_date"), F.col("idx").alias("at"), "close", "pivot", "trigger", "resume_trigger", "p2", "p3", "p4")
    return signals.join(known, KEY)


def ahead(starts: DataFrame, f: DataFrame, at: str, first: int, last: int | Column, columns: list[str]) -> DataFrame:
    """starts by offset first to last from bar `at`, with the columns of the bar there as a_...; an equi-join on ticker and bar."""
    steps = starts.withColumn("offset", F.explode(F.sequence(F.lit(first), last if isinstance(last, Column) else F.lit(last))))
    steps = steps.withColumn("a_idx", F.col(at) + F.col("offset"))
    return steps.join(f.select("ticker", F.col("idx").alias("a_idx"), *[F.col(c).alias(f"a_{c}") for c in columns]), ["ticker", "a_idx"])


def fills(s: DataFrame, f: DataFrame, name: str) -> DataFrame:
    """s (of at_signal) with fill_idx and price, null where the rule doesn't fill within its window."""
    rule = ENTRIES[name]
    allowed = F.col("pivot").isNotNull() & F.col("p1") & F.col("p2") & F.col("p3") & F.col("p4") if rule.observed else F.lit(True)
    s = s.withColumn("kind", F.lit(rule.kind))
    if rule.hit is None:
        return s.withColumns({"fill_idx": F.when(allowed, F.col("at")), "price": F.when(allowed, F.col("close"))})
    bars_ = f.withColumn("before", F.lag("close").over(Window.partitionBy("ticker").orderBy("idx")))
    walk = ahead(s.filter(allowed), bars_, "at", 1, rule.window, ["open", "high", "close", "volume", "vsma50", "before", "next_open"])
    first = walk.filter(rule.hit()).groupBy(*KEY).agg(F.min(F.struct("offset", rule.price().alias("price"))).alias("hit"))
    s = s.join(first, KEY, "left")
    ok = F.col("hit.price").isNotNull()
    return s.withColumns({"fill_idx": F.when(ok, F.col("at") + F.col("hit.offset") + rule.delay), "price": F.col("hit.price")}).drop("hit")


def exits(filled: DataFrame, f: DataFrame, rules: list[str], regimes: DataFrame | None = None) -> DataFrame:
    """A row for each position and rule: rule, days, exit_close, stop_hit, mdd. All rules share one walk.

    A path that leaves the data before any stop is dropped; an earlier stop is kept.
    """
    start = f.select("ticker", F.col("idx").alias("fill_idx"), F.col("date").alias("fill_date"), F.col("atr14").alias("e_atr14"), F.col("pivot").alias("e_pivot"), F.col("pullback_low").alias("e_pullback_low"))
    flip = F.lit(False)
    if regimes is not None:  # one row a calendar day
        days = regimes.filter("regime = 'down' AND transition_date = date").select("date", F.lit(True).alias("flip"))
        f, flip = f.join(F.broadcast(days), "date", "left"), F.coalesce("flip", F.lit(False))
    f = f.withColumn("flip", flip)
    walk = ahead(filled.filter("fill_idx IS NOT NULL").join(start, ["ticker", "fill_idx"]), f, "fill_idx", 0, HOLD, ["close", "x1", "x4", "flip"])
    w = Window.partitionBy(*KEY).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    later = F.col("offset") >= 1
    walk = walk.withColumns({"top": F.max("a_close").over(w), "peak": F.greatest("price", F.max(F.when(later, F.col("a_close"))).over(w))})
    walk = walk.withColumn("mdd", F.max((F.col("top") - F.col("a_close")) / F.col("top")).over(w))
    end = F.struct("offset", "a_close", "mdd")
    stops = [F.min(F.when(later & EXITS[r](), end)).alias(r) for r in rules]
    keep = [F.first(c).alias(c) for c in filled.columns + ["fill_date"] if c not in KEY]
    got = walk.groupBy(*KEY).agg(*stops, F.max(F.when(F.col("offset") == HOLD, end)).alias("_time"), *keep)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(r, "_time").alias("end"), F.col(r).isNotNull().alias("stop_hit")) for r in rules])).alias("x")
    got = got.select("*", each).filter("x.end IS NOT NULL")
    return got.select(*filled.columns, "fill_date", "x.rule", "x.stop_hit", F.col("x.end.offset").alias("days"), F.col("x.end.a_close").alias("exit_close"), F.col("x.end.mdd").alias("mdd"))


def held(filled: DataFrame, f: DataFrame, horizons: tuple[int, ...], *more: str) -> DataFrame:
    """A row for each filled position and horizon whose exit bar exists: days, exit_close, mdd. more: columns that tell positions of one signal apart."""
    start = f.select("ticker", F.col("idx").alias("fill_idx"), F.col("date").alias("fill_date"))
    walk = ahead(filled.filter("fill_idx IS NOT NULL").join(start, ["ticker", "fill_idx"]), f, "fill_idx", 0, max(horizons), ["close"])
    w = Window.partitionBy(*KEY, *more).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    walk = walk.withColumn("top", F.max("a_close").over(w)).withColumn("mdd", F.max((F.col("top") - F.col("a_close")) / F.col("top")).over(w))
    return walk.filter(F.col("offset").isin(*horizons)).select(*filled.columns, "fill_date", F.col("offset").alias("days"), F.col("a_close").alias("exit_close"), "mdd")


def with_benchmark(ended: DataFrame, bars: DataFrame) -> DataFrame:
    """ended with ret, bench and excess; the benchmark is computed once for each date and length that occurs."""
    wanted = ended.select(F.col("fill_date").alias("date"), "days").distinct()
    base = wanted.join(bars.select("date", "ticker", "idx", F.col("close").alias("c0")), "date").withColumn("end_idx", F.col("idx") + F.col("days"))
    bench = base.join(bars.select("ticker", F.col("idx").alias("end_idx"), F.col("close").alias("c1")), ["ticker", "end_idx"])
    bench = bench.groupBy(F.col("date").alias("fill_date"), "days").agg(F.avg(F.col("c1") / F.col("c0") - 1).alias("bench"))
    got = ended.withColumn("ret", F.col("exit_close") / F.col("price") - 1).join(bench, ["fill_date", "days"])
    return got.withColumn("excess", F.col("ret") - F.col("bench"))


#: Ratios of a position's legs may add up to 1, but for errors of rounding.
WHOLE = 1 + 1e-9


def legged(filled: DataFrame, bars: DataFrame, legs: DataFrame, last: int = HOLD) -> DataFrame:
    """A row for each leg of each filled position: days, weight, exit_close, and of the position mdd, n_legs and held.

    legs: eval_date, ticker, days (bars after the fill) and ratio, any number a position. What is left of a position
    ends after `last` bars. A position is dropped if its ratios add up to less than 0 or more than 1, if a leg ends at or
    before the fill, or if a leg leaves the data. The fall is that of the whole position's value, in which an ended leg stays at
    its last price. A position's closes are one array of at most as many values as its longest leg has bars.
    """
    each = F.collect_list(F.struct(F.col("days").cast("int").alias("days"), F.col("ratio").cast("double").alias("weight")))
    given = legs.groupBy(*KEY).agg(F.array_sort(each).alias("legs"))
    none = F.array().cast("array<struct<days:int,weight:double>>")
    s = filled.filter("fill_idx IS NOT NULL").join(given, KEY, "left").withColumn("legs", F.coalesce("legs", none))
    s = s.withColumn("_ratio", F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["weight"]))
    s = s.filter((F.col("_ratio") >= 0) & (F.col("_ratio") <= WHOLE) & ~F.exists("legs", lambda x: x["days"].isNull() | (x["days"] < 1)))
    rest = F.greatest(F.lit(0.0), 1 - F.col("_ratio"))
    s = s.withColumn("legs", F.concat("legs", F.when(rest > 1e-9, F.array(F.struct(F.lit(last).alias("days"), rest.alias("weight")))).otherwise(none)))
    s = s.withColumn("_last", F.array_max(F.transform("legs", lambda x: x["days"]))).filter("_last IS NOT NULL")
    start = bars.select("ticker", F.col("idx").alias("fill_idx"), F.col("date").alias("fill_date"))
    keep = [c for c in filled.columns if c not in KEY] + ["fill_date", "legs", "_last"]
    walk = ahead(s.join(start, ["ticker", "fill_idx"]), bars, "fill_idx", 0, F.col("_last"), ["close"])
    path = F.transform(F.array_sort(F.collect_list(F.struct("offset", "a_close"))), lambda x: x["a_close"])
    got = walk.groupBy(*KEY).agg(path.alias("_closes"), *[F.first(c).alias(c) for c in keep]).filter(F.size("_closes") == F.col("_last") + 1)
    value = lambda t: F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["weight"] * F.get("_closes", F.least(t, x["days"])) / F.col("price"))
    fall = F.aggregate(
        F.transform(F.sequence(F.lit(0), "_last"), value),
        F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("fall")),
        lambda a, v: F.struct(F.greatest(a["top"], v).alias("top"), F.greatest(a["fall"], (F.greatest(a["top"], v) - v) / F.greatest(a["top"], v)).alias("fall")),
    )["fall"]
    held = F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["weight"] * x["days"])
    got = got.withColumns({"mdd": fall, "n_legs": F.size("legs"), "held": held})
    return got.select(*filled.columns, "fill_date", "mdd", "n_legs", "held", "_closes", F.explode("legs").alias("leg")).select(
        *filled.columns, "fill_date", "mdd", "n_legs", "held", "leg.days", "leg.weight", F.get("_closes", F.col("leg.days")).alias("exit_close")
    )


def joined_legs(perf: DataFrame, *keep: str) -> DataFrame:
    """One row a position from its legs (ret, bench, weight), each against a benchmark of its own length; with the columns `keep`.

    A position of which a leg has no benchmark is dropped.
    """
    got = perf.groupBy(*KEY, "mdd", "n_legs", "held", *keep).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("ret", "bench")], F.count("*").alias("_met"))
    return got.filter(F.col("_met") == F.col("n_legs")).drop("_met").withColumn("excess", F.col("ret") - F.col("bench"))


def climax_legs(filled: DataFrame, f: DataFrame) -> DataFrame:
    """eval_date, ticker, days, ratio: half of a position ends on the first climax bar within 60 bars, if there is one."""
    walk = ahead(filled.filter("fill_idx IS NOT NULL"), f, "fill_idx", 1, HOLD, ["x4"]).filter("a_x4")
    return walk.groupBy(*KEY).agg(F.min("offset").alias("days")).withColumn("ratio", F.lit(0.5))
