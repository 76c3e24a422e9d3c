"""Daily bars and quarters derived from the order tables by exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import half_up, with_blocks
from tickloom.run import UNIVERSES, Run, run_of
from tickloom.sources.universe import read_universe


def table(spark: SparkSession, d: str | Run, name: str) -> DataFrame:
    return spark.read.parquet(f"{run_of(d).folder}/{name}.parquet")


def bars(spark: SparkSession, d: str | Run) -> DataFrame:
    """ticker, sector, pos, date, idx, open, high, low, close, volume, block of the run's universe."""
    run = run_of(d)
    known = lambda df: df if run.until is None else df.filter(F.col("date") <= F.lit(run.until).cast("date"))
    if run.universe not in UNIVERSES:
        return known(with_blocks(read_universe(spark, run.universe, lines=True))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ticker")
    return _walk(spark, known(_suppliers(spark, d) if run.universe == UNIVERSES[0] else _customers(spark, d)))


#: Suppliers or customers whose keys are broadcast, at most; beyond that Spark chooses the join (fixed value).
BROADCAST_KEYS = 2_000_000


def _owned(rows: DataFrame, owners: DataFrame, key: str, nation: str) -> DataFrame:
    """rows with the nation (number) of the supplier or customer named by key. They stay where they are while its keys are few."""
    of = owners.select(key, F.col(nation).alias("nation"))
    return rows.join(F.broadcast(of) if owners.count() <= BROADCAST_KEYS else of, key)


def _nations(spark: SparkSession, d: str | Run) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _named(spark: SparkSession, d: str | Run, rows: DataFrame) -> DataFrame:
    """cents and volume by nation (ticker, pos), region (sector) and date.

    A supplier has few line items a day, so sums by supplier would be about as many rows as there are line items. Sums by
    nation and day are few in each task, and only they are shuffled and named.
    """
    both = [F.sum("cents").alias("cents"), F.sum("volume").alias("volume")]
    names = _nations(spark, d).withColumnRenamed("n_nationkey", "nation")
    named = [F.col("n_name").alias("ticker"), F.col("nation").cast("long").alias("pos"), F.col("r_name").alias("sector")]
    return rows.groupBy("nation", "date").agg(*both).join(names, "nation").groupBy(*named, "date").agg(*both)


def _customers(spark: SparkSession, d: str | Run) -> DataFrame:
    """The second universe: orders by the customers' nations, their price in cents and their number."""
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.lit(1).cast("long").alias("volume")
    )
    return _named(spark, d, _owned(orders, table(spark, d, "customer"), "c_custkey", "c_nationkey"))


def _suppliers(spark: SparkSession, d: str | Run) -> DataFrame:
    """Line items by the suppliers' nations, their price in cents and their quantity."""
    line = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("volume")
    )
    return _named(spark, d, _owned(line, table(spark, d, "supplier"), "s_suppkey", "s_nationkey"))


def _walk(spark: SparkSession, day: DataFrame) -> DataFrame:
    """Bars of a price walk whose daily steps follow from each nation's cents."""
    # Windows over a ticker cost far more time than bytes, so they must not be dealt out by bytes: a stated number of
    # partitions isn't joined at run time, and serves all later windows by ticker.
    day = day.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ticker")
    w = Window.partitionBy("ticker").orderBy("date")
    pos, cents = F.col("pos"), F.col("cents")
    step = ((cents % 401) - 200) * (1 + pos % 3) + (pos * 7) % 13 - 4
    px = day.select("*", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("lp"))
    px = px.withColumn("close", half_up(100 * F.exp(F.col("lp") / 10000), 4))
    px = px.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    return with_blocks(px).select(
        "ticker", "sector", "pos", "date", "idx", "open",
        half_up(F.greatest("open", "close") * (1 + (cents % 97).cast("double") / 10000), 4).alias("high"),
        half_up(F.least("open", "close") * (1 - (cents % 89).cast("double") / 10000), 4).alias("low"),
        "close", "volume", "block",
    )


def quarters(spark: SparkSession, d: str | Run) -> DataFrame:
    """ticker, rn (1 is the newest of five), qn, eps, revenue, operating_margin, roe."""
    orders = table(spark, d, "orders").filter("o_orderdate < TIMESTAMP '2001-07-01 00:00:00'")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = orders.select(
        F.col("o_custkey").alias("c_custkey"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("qn"), cents.alias("rc"), F.when(F.col("o_orderstatus") == "F", cents).otherwise(0).alias("fc")
    )
    sums = _owned(o, table(spark, d, "customer"), "c_custkey", "c_nationkey").groupBy("nation", "qn").agg(F.sum("rc").alias("rc"), F.count("*").alias("cnt"), F.sum("fc").alias("fc"))
    names = table(spark, d, "nation").withColumnRenamed("n_nationkey", "nation")
    q = sums.join(names, "nation").groupBy(F.col("n_name").alias("ticker"), F.col("nation").alias("nk"), "qn").agg(*[F.sum(c).cast("double").alias(c) for c in ("rc", "cnt", "fc")])
    q = q.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("qn")))).filter("rn <= 5")
    known = F.col("nk") % 11 != 7
    return q.select(
        "ticker", F.col("rn").cast("long").alias("rn"), "qn",
        F.when(known, half_up(F.col("rc") / F.col("cnt") / 100, 4)).alias("eps"),
        (F.col("rc") / 100).alias("revenue"),
        half_up(F.col("fc") / F.col("rc"), 4).alias("operating_margin"),
        F.when(known, ((F.col("nk") * 37) % 40).cast("double") / 100).alias("roe"),
    )
