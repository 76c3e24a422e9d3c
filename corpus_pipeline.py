"""A corpus pipeline of five stages; counted as part of the corpus subpackage.

Language ID drops documents without a recognisable language; SimHash keeps one document of each group of
near-copies; decontamination drops documents that hold a benchmark item; mixing keeps a calibrated sample; sharding
deals what is left into eight shards and adds `shard` and `slot`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, language, mixing, near_copies, sharding
from tickloom.llm.common import delete_folder, fresh_path, table, unused


def _own(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous."""
    (found,) = unused(docs, "found")
    return _own(language.identify(docs, name=found).filter(f"{found}.lang <> 'und' AND NOT {found}.ambiguous"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: SimHash candidates, verified on five-word shingles at 0.8."""
    return near_copies.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _own(mixing.mix(docs).filter("sampled"), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(docs, 8, stored=True)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = fresh_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # read for the last time by the stage just written
            delete_folder(spark, before)
        before = path
    return docs
