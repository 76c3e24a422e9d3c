"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every other code point belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows handed to a Python worker at a time: keeps a batch of long texts within a worker's memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local session that has none, as in tests, gets one of our own; on a cluster a missing setting is an error,
    since a folder of one machine isn't seen by the others.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints/tickloom"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}/{tag}"


class _Open(threading.local):
    """Folders written inside each open `temporary` block of a driver's thread, innermost last."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_open = _Open()


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    Inside a `temporary` block the folder goes when the block ends; with keep, when the block around it does.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    if len(_open.blocks) > keep:
        _open.blocks[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that fresh_path named, in whatever file system it lies."""
    jvm, parent = spark.sparkContext._jvm, path.rsplit("/", 1)[0]
    where = jvm.org.apache.hadoop.fs.Path(parent)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are removed at the end; what is read later must be kept."""
    _open.blocks.append([])
    try:
        yield
    finally:
        for path in _open.blocks.pop():
            delete_folder(spark, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until it differs from every column of df, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on texts in tasks: bound the batches, and make this package importable there.

    The session's batch size is lowered, never raised, and stays so: results run later, when the caller reads them.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH_ROWS:
        spark.conf.set(size, BATCH_ROWS)
    importable(spark)


def importable(spark: SparkSession) -> None:
    """Ship this package to the workers, unless they find it themselves."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tickloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "tickloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "tickloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._tickloom_shipped = True


def if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Hint a broadcast only where the counted rows stay under the limit; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def if_light(df: DataFrame, size: int, limit: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only where the measured bytes stay under the limit; otherwise Spark shuffles."""
    return F.broadcast(df) if size <= limit else df
