"""Tables that many plans share, written once a session to the shared folder and read back.

A backtest meets the bars' features several times over; written once, they are computed once and each plan that reads
them stays small. A lost executor costs nothing that is written. The input tables are taken as unchanged while a
session lasts, and are kept by the whole run that they belong to; forget() drops what is known of a session. The tables are written while a plan is built, and their folders stay,
as the plans handed out read them; whoever set the shared folder clears it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.run import Run, run_of

_known: dict[tuple[str, Run, str], DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where a local session has none, as in tests, a folder of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or "/tmp/checkpoints/tickloom").rstrip("/")


def staged(spark: SparkSession, d: str | Run, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, run_of(d), name)
    if key not in _known:
        df, path = make(), f"{shared_folder(spark)}/tickloom-{uuid.uuid4().hex}/{name}"
        df.write.parquet(path)
        _known[key] = spark.read.schema(df.schema).parquet(path)
    return _known[key]


def forget() -> None:
    _known.clear()
