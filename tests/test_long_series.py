"""Recursive averages over series longer than any block, against a loop bar by bar."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.exprs import ema, wilder, with_blocks

BARS = 10_000


def series() -> list[float]:
    rng = random.Random(7)
    return [100 * math.exp(0.3 * math.sin(i / 500) + rng.gauss(0, 0.02)) for i in range(BARS)]


def followed(x: list[float], n: int, first: int, alpha: float) -> list[float | None]:
    out: list[float | None] = [None] * (first + n - 1)
    now = sum(x[first : first + n]) / n
    out.append(now)
    for v in x[first + n :]:
        now = now + alpha * (v - now)
        out.append(now)
    return out


@pytest.mark.parametrize("n", [9, 12, 26, 200])
def test_exponential_average(spark, n):
    x = series()
    bars = with_blocks(spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", i, v) for i, v in enumerate(x[:50])], "ticker string, idx long, close double"))
    got = {(r["ticker"], r["idx"]): r["e"] for r in bars.select("ticker", "idx", ema(F.col("close"), n, 3).alias("e")).collect()}
    for ticker, values in (("a", x), ("b", x[:50])):
        for i, want in enumerate(followed(values, n, 3, 2 / (n + 1)) if len(values) > n + 3 else [None] * 50):
            assert got[ticker, i] is want is None or abs(got[ticker, i] / want - 1) < 1e-9


def test_wilder_average(spark):
    x = series()
    bars = with_blocks(spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "ticker string, idx long, close double"))
    got = [r["e"] for r in bars.select("idx", wilder(F.col("close"), 14, 1).alias("e")).orderBy("idx").collect()]
    want = followed(x, 14, 1, 1 / 14)
    assert all(a is b is None or abs(a / b - 1) < 1e-9 for a, b in zip(got, want)) and len(got) == len(want)
