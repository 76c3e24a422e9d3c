"""Scans and range minima against loops: the regime over a million days, the low since a peak, means from running sums."""

import datetime
import math
import random

from pyspark.sql import functions as F

from tickloom.functions.exprs import mean, run, with_blocks
from tickloom.operators import screening
from tickloom.operators.indicators import entry_state, indicators
from tickloom.operators.pullback import pullbacks

DAYS = 1_000_000


def followed(values):
    state = since = None
    for k, v in enumerate(values):
        if v is None:
            yield None, None
            continue
        if state is None:
            now = "up" if v >= 0.55 else "down" if v < 0.40 else "neutral"
        elif state == "up":
            now = "neutral" if v < 0.55 else "up"
        elif state == "neutral":
            now = "up" if v > 0.65 else "down" if v < 0.40 else "neutral"
        else:
            now = "neutral" if v > 0.50 else "down"
        since = since if now == state else k
        state = now
        yield state, since


def test_regimes_of_a_million_days(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 - 0.5
    level = 0.52 + 0.2 * F.sin(F.col("id") / 700.0) + 0.1 * F.sin(F.col("id") / 90000.0) + 0.08 * noise
    seen = (F.col("id") >= 300) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(17)) != 0)
    days = spark.range(DAYS).select(F.col("id").alias("n"), F.date_add(F.lit(datetime.date(1000, 1, 1)), F.col("id").cast("int")).alias("date"), F.when(seen, level).alias("breadth"))
    day = lambda c: F.date_diff(c, F.lit(datetime.date(1000, 1, 1)))
    got = screening.regimes(days).select(day("date").alias("n"), "breadth", "regime", day("transition_date").alias("since")).orderBy("n").toPandas()
    assert got.n.tolist() == list(range(DAYS))
    values = [None if math.isnan(x) else x for x in got.breadth.tolist()]
    since = [None if math.isnan(x) else int(x) for x in got.since.tolist()]
    regime = [x if isinstance(x, str) else None for x in got.regime.tolist()]
    assert list(zip(regime, since)) == list(followed(values))
    assert len(set(since)) > 500 and {"up", "neutral", "down"} <= set(regime)


def test_regimes_without_days_or_values(spark):
    none = spark.createDataFrame([], "n long, date date, breadth double")
    assert screening.regimes(none).count() == 0
    rows = [(k, datetime.date(2020, 1, 1) + datetime.timedelta(k), None) for k in range(600)]
    got = screening.regimes(spark.createDataFrame(rows, "n long, date date, breadth double")).collect()
    assert len(got) == 600 and {(r["regime"], r["transition_date"]) for r in got} == {(None, None)}


def walk(seed: int, n: int) -> list[float]:
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= math.exp(rng.choice((0, 0, 1, -1)) * 0.01)
        out.append(round(x, 2))
    return out


def test_low_since_the_peak_and_means(spark):
    series = {t: walk(k, n) for k, (t, n) in enumerate((("a", 900), ("b", 70), ("c", 40), ("d", 1300)))}
    rows = [(t, "s", 0, datetime.date(2000, 1, 1) + datetime.timedelta(i), i, c, c, c, c, 100 + i % 7) for t, x in series.items() for i, c in enumerate(x)]
    bars = with_blocks(spark.createDataFrame(rows, "ticker string, sector string, pos long, date date, idx long, open double, high double, low double, close double, volume long"))
    f = pullbacks(entry_state(indicators(bars)))
    got = {(r["ticker"], r["idx"]): r for r in f.select("ticker", "idx", "peak_idx", "pivot", "pullback_low", "w52_high", "w52_low", "sma20", "sma200", "vsma50").collect()}
    assert len(got) == len(rows)
    seen = 0
    for t, x in series.items():
        for i in range(len(x)):
            r = got[t, i]
            peak = max(range(i - 63, i), key=lambda k: (x[k], -k)) if i >= 63 else None
            assert r["peak_idx"] == peak
            low = min(x[peak + 1 : i + 1]) if r["pivot"] is not None else None
            assert r["pullback_low"] == low
            seen += low is not None
            for c, n, fn in (("w52_high", 252, max), ("w52_low", 252, min)):
                assert r[c] == (fn(x[i - n + 1 : i + 1]) if i >= n - 1 else None)
            for c, n, v in (("sma20", 20, x), ("sma200", 200, x), ("vsma50", 50, [100 + k % 7 for k in range(len(x))])):
                want = sum(v[i - n + 1 : i + 1]) / n if i >= n - 1 else None
                assert r[c] is want is None or abs(r[c] - want) < 1e-9
    assert seen > 1500


def test_mean_of_earlier_bars(spark):
    x = walk(9, 700)
    bars = with_blocks(spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "ticker string, idx long, close double"))
    got = [r["m"] for r in bars.withColumn("close_run", F.sum("close").over(run())).select("idx", mean("close", 20, 5).alias("m")).orderBy("idx").collect()]
    for i, m in enumerate(got):
        assert m is None if i < 24 else abs(m - sum(x[i - 24 : i - 4]) / 20) < 1e-9
