"""Results that replace one another whole: written beside, checked, and moved in place by a rename.

A reader sees the old folder or the new one. A job that dies leaves the old one; what it wrote lies beside under a name
of its own. Between the two renames there is a moment without a folder, and a loader then finds the old one beside.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, *names: str) -> list:
    return [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n) for n in names]


def publish(df: DataFrame, path: str, broken: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write df as Parquet and move it to path. broken: the rows of what was written that break a rule; any stops it."""
    spark, path = df.sparkSession, path.rstrip("/")
    beside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    df.write.parquet(beside)
    if broken is not None and (first := broken(spark.read.parquet(beside)).first()) is not None:
        raise ValueError(f"not published, as a rule is broken, first by {first}; see {beside}")
    to, new, was = _paths(spark, path, beside, old)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        fs.delete(was, True)
        if not fs.rename(to, was):
            raise OSError(f"{path} can't be moved aside")
    else:
        fs.mkdirs(to.getParent())
    if not fs.rename(new, to):
        raise OSError(f"{beside} can't be moved to {path}")
    fs.delete(was, True)


def published(spark: SparkSession, path: str, schema: str, broken: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What lies at path, with the columns of schema; no rows where nothing is there, it can't be read as such, or it breaks a rule."""
    empty = spark.createDataFrame([], schema)
    for name in (path.rstrip("/"), f"{path.rstrip('/')}.old"):
        try:
            found = spark.read.parquet(name)
            kinds = {f.name: f.dataType for f in found.schema}
            if any(kinds.get(f.name) != f.dataType for f in empty.schema):
                return empty
            found = found.select(*empty.columns)
            return empty if broken is not None and broken(found).first() is not None else found
        except (AnalysisException, SparkRuntimeException):
            continue
    return empty


def stale(spark: SparkSession, path: str, days: int, today: str | None = None) -> DataFrame:
    """One row: date (when path was last written, if it is there), stale (longer ago than so many days, or never)."""
    (where,) = _paths(spark, path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = fs.getFileStatus(where).getModificationTime() // 1000 if fs.exists(where) else None
    now = F.lit(today).cast("date") if today else F.current_date()
    date = F.to_date(F.timestamp_seconds(F.lit(at)))
    return spark.range(1).select(date.alias("date"), F.coalesce(F.date_diff(now, date) > days, F.lit(True)).alias("stale"))
