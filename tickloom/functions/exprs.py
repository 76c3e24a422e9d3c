"""Column building blocks: rounding, guarded trailing windows, recursive averages in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Bars of a block: a column of bars by which windows are sorted, so that sums within a block and over a whole ticker
#: share one order. What is older than a whole block weighs less than 1e-19 for all averages of up to 26 bars (14 after
#: Wilder), and a power over one block stays far from overflow.
BLOCK = 600


def with_blocks(bars: DataFrame) -> DataFrame:
    return bars.withColumn("block", F.floor(F.col("idx") / BLOCK))


def by() -> WindowSpec:
    """Bars of a ticker in order; made when called, as a window needs a session."""
    return Window.partitionBy("ticker").orderBy("block", "idx")


def run() -> WindowSpec:
    return by().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy("ticker")


def half_up(x: Column, digits: int = 6) -> Column:
    """Round half toward positive infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def last(n: int, back: int = 0):
    """Frame of n bars ending `back` bars ago; trailing only."""
    return by().rowsBetween(-(n - 1) - back, -back)


def guarded(n: int, x: Column) -> Column:
    """x once n bars exist, else null: frames are never partial."""
    return F.when(F.col("idx") >= n - 1, x)


def mean(x: str, n: int, back: int = 0) -> Column:
    """Mean of x over n bars ending `back` bars ago, from `{x}_run`, its running sum: two look-ups instead of n values a bar.

    Null while fewer than n bars exist.
    """
    total = F.col(f"{x}_run")
    end = F.lag(total, back).over(by()) if back else total
    return F.when(F.col("idx") >= n - 1 + back, (end - F.coalesce(F.lag(total, n + back).over(by()), F.lit(0.0))) / n)


def smooth(x: Column, n: int, first: int, alpha: float) -> Column:
    """Recursive average seeded by the mean of x at bars first .. first + n - 1, of series of any length.

    y = q y' + alpha x is an affine map of the value before, so a block of bars is one too: its factor is a power of q
    and its offset the sum of what the block adds. Powers are anchored anew in each block; a bar adds up its own block so far, the
    offset of the block before it, and the seed, each under its own power. All windows follow the bars' one order.
    """
    q, seed_at, size = 1.0 - alpha, first + n - 1, math.ceil(44 / -math.log(1.0 - alpha))
    i, block = F.col("idx"), F.col("block")
    if size > BLOCK:  # a slower average has blocks of its own, and so a second order
        block = F.floor(i / size)
    size = max(BLOCK, size)
    at = i - block * size
    power = lambda k: F.pow(F.lit(q), k)
    part = F.when(i > seed_at, alpha * x * power(-at))
    seed = F.sum(F.when(i.between(first, seed_at), x / n)).over(run())  # complete where it is read
    own = F.sum(part).over(Window.partitionBy("ticker", block).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum(part).over(Window.partitionBy("ticker").orderBy(block).rangeBetween(-1, -1))
    tail = power(at) * (F.coalesce(own, F.lit(0.0)) + q**size * F.coalesce(before, F.lit(0.0)))
    return F.when(i >= seed_at, power(i - seed_at) * seed + tail)


def ema(x: Column, n: int, first: int = 0) -> Column:
    return smooth(x, n, first, 2.0 / (n + 1))


def wilder(x: Column, n: int, first: int) -> Column:
    return smooth(x, n, first, 1.0 / n)


def bars_since(event: Column) -> Column:
    """Bars since the last bar with the event, null before the first."""
    return F.col("idx") - F.last(F.when(event, F.col("idx")), ignorenulls=True).over(run())
