"""Growth measures from the newest five quarters, the three-part hurdle, and verdicts as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import half_up

#: Least number of quarters of a ticker, and the least growth (%) and ROE of the hurdle (fixed values).
MIN_QUARTERS, GROWTH, ROE = 2, 20, 0.17


def metrics(quarters: DataFrame) -> DataFrame:
    """A row a ticker of at least two quarters: yearly growth of EPS and revenue (%), roe, and whether margin and EPS rose on the quarter."""
    at = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    growth = lambda c: half_up((at(c, 1) / F.nullif(at(c, 5), F.lit(0.0)) - 1) * 100, 2)
    return quarters.groupBy("ticker").agg(
        growth("eps").alias("eps_yoy"),
        growth("revenue").alias("revenue_yoy"),
        at("roe", 1).alias("roe"),
        (at("operating_margin", 1) >= at("operating_margin", 2)).alias("margin_up"),
        (at("eps", 1) > at("eps", 2)).alias("accelerating"),
        F.count("*").alias("quarters"),
    ).filter(F.col("quarters") >= MIN_QUARTERS)


def missing(m: DataFrame) -> DataFrame:
    """metrics with missing: the codes of what can't be judged, in order."""
    known = {"F1": "eps_yoy", "F2": "accelerating", "F3": "revenue_yoy", "F4": "margin_up", "F5": "roe"}
    return m.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(c).isNull(), code) for code, c in known.items()])))


def verdict(core: list[Column]) -> Column:
    """insufficientFundamentals where two or more of the conditions are unknown, else pass, partial or fail."""
    unknown = sum((x.isNull().cast("int") for x in core), F.lit(0))
    passed = sum((F.coalesce(x, F.lit(False)).cast("int") for x in core), F.lit(0))
    return F.when(unknown >= 2, "insufficientFundamentals").when(passed == len(core), "pass").when(passed >= 1, "partial").otherwise("fail")


def hurdle(m: DataFrame) -> DataFrame:
    return m.withColumn("verdict", verdict([F.col("eps_yoy") >= GROWTH, F.col("revenue_yoy") >= GROWTH, F.col("roe") >= ROE]))


def history(quarters: DataFrame) -> DataFrame:
    """ticker, qn, as_of, eps_growth, revenue_growth, verdict: each quarter against the one before it, as known 45 days after it ended.

    What the yearly figures of today leave unknown stays unknown in every quarter, and ROE is today's.
    """
    w, whole = Window.partitionBy("ticker").orderBy("rn"), Window.partitionBy("ticker")
    at = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c))).over(whole)
    yearly = lambda c: at(c, 1) / F.nullif(at(c, 5), F.lit(0.0))
    growth = lambda c: (F.col(c) - F.lead(c).over(w)) / F.nullif(F.abs(F.lead(c).over(w)), F.lit(0.0)) * 100
    q = quarters.select(
        "ticker", "qn", growth("eps").alias("eps_growth"), growth("revenue").alias("revenue_growth"), F.lead("qn").over(w).alias("prior"),
        yearly("eps").isNotNull().alias("f1"), yearly("revenue").isNotNull().alias("f3"), at("roe", 1).alias("roe"),
    )
    core = [F.when(F.col("f1"), F.col("eps_growth") >= GROWTH), F.when(F.col("f3"), F.col("revenue_growth") >= GROWTH), F.col("roe") >= ROE]
    year, quarter = F.floor(F.col("qn") / 4).cast("int"), (F.col("qn") % 4 + 1).cast("int")
    report = F.date_add(F.last_day(F.make_date(year, quarter * 3, F.lit(1))), 45)
    return q.filter("prior IS NOT NULL").select("ticker", "qn", report.alias("as_of"), *[half_up(F.col(c), 4).alias(c) for c in ("eps_growth", "revenue_growth")], verdict(core).alias("verdict"))


def as_of(records: DataFrame, history: DataFrame) -> DataFrame:
    """records (eval_date, ticker, ...) with the verdict of the last report on or before eval_date, null before any.

    Reports and records are unioned and the last verdict carried forward: one shuffle by ticker, no range join.
    """
    reports = history.groupBy("ticker", F.col("as_of").alias("eval_date")).agg(F.max_by("verdict", "qn").alias("_v"))
    both = records.withColumns({"_v": F.lit(None).cast("string"), "_own": F.lit(1)}).unionByName(reports.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("eval_date", "_own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("verdict", F.last("_v", ignorenulls=True).over(w)).filter("_own = 1").drop("_v", "_own")
