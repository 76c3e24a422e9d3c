"""Two universes side by side, runs other than the usual, and the engine on universe files."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.exprs import half_up
from tickloom.plans import queries
from tickloom.plans.queries import QUERY
from tickloom.run import UNIVERSES, Run, run_of
from tickloom.sources import universe
from tickloom.sources.bars import bars
from tickloom.sources.stage import shared_folder, staged

FIGURES = ("win_rate", "avg_excess", "median_excess", "avg_return", "mdd")


def in_universe(d: str | Run, name: str) -> Run:
    """The same run on another universe; it shares no table with the first."""
    return dataclasses.replace(run_of(d), universe=name)


def compared(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Two tables of figures met by their keys: signals and figures of each, and the second's less the first's.

    Each universe has its own calendar, split, ranks and benchmark; only finished tables meet, in one full outer join, so a
    cell that one of them lacks keeps the other's figures.
    """
    sides = [t.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in ("signals", *FIGURES)]) for name, t in tables.items()]
    first, second = tables
    both = sides[0].join(sides[1], keys, "full_outer")
    deltas = [half_up(F.col(f"{c}_{second}") - F.col(f"{c}_{first}"), 4).alias(f"{c}_delta") for c in FIGURES]
    return both.select("*", *deltas)


def _axis(name: str, keys: list[str]) -> QUERY:
    def query(spark: SparkSession, d: str | Run) -> DataFrame:
        tables = {u: staged(spark, in_universe(d, u), name, lambda u=u: queries.QUERIES[name](spark, in_universe(d, u))) for u in UNIVERSES}
        return compared(tables, keys)

    return query


def _two_star(spark: SparkSession, d: str | Run) -> DataFrame:
    """By universe, the two-star consensus out of sample: its top five, 20 bars on; whether there is a sample to judge by."""
    out = None
    for u in UNIVERSES:
        run = in_universe(d, u)
        t = staged(spark, run, "strategy_table", lambda run=run: queries.QUERIES["strategy_table"](spark, run))
        one = t.filter("strategy = 'consensus_2star' AND sample = 'out' AND basis = 'top5' AND quality = 'all' AND days = 20")
        one = one.select(F.lit(u).alias("universe"), "signals", "win_rate", "avg_excess", (F.col("signals") == 0).alias("insufficient"))
        out = one if out is None else out.unionByName(one)
    return out


def _second_bars(spark: SparkSession, d: str | Run) -> DataFrame:
    return bars(spark, in_universe(d, "customers")).drop("pos", "block")


def _from_file(spark: SparkSession, d: str | Run) -> DataFrame:
    """The trend recommendations of a universe file, written from the run's bars; nothing but the file is read for them."""
    path = f"{shared_folder(spark)}/tickloom-{uuid.uuid4().hex}/universe"
    universe.write_universe(queries._priced(spark, d), path)
    return queries.QUERIES["trend_recommend_default"](spark, in_universe(d, path))


def _daily_dates(spark: SparkSession, d: str | Run) -> DataFrame:
    """Evaluation dates of a run that evaluates every bar."""
    return queries.QUERIES["evaluation_dates"](spark, dataclasses.replace(run_of(d), step=1))


def _short_run(spark: SparkSession, d: str | Run) -> DataFrame:
    """Template lists of a run with its own warm-up, buffer and step."""
    return queries.QUERIES["template_recommend"](spark, dataclasses.replace(run_of(d), step=10, warmup=300, buffer=60))


QUERIES: dict[str, QUERY] = {
    "second_universe_bars": _second_bars,
    "universe_comparison": _axis("strategy_table", ["strategy", "sample", "basis", "quality", "days"]),
    "universe_comparison_regimes": _axis("regime_axis", ["strategy", "sample", "basis", "regime", "days"]),
    "universe_two_star": _two_star,
    "trend_recommend_from_file": _from_file,
    "evaluation_dates_daily": _daily_dates,
    "template_recommend_short_run": _short_run,
}
