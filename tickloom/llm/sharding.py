"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each source partition go to each target block is drawn first, exactly, from the multivariate
hypergeometric law. A task then permutes the targets of its own partition's rows, rows are exchanged once by them, and
permuted again within their target block; the result is a uniform permutation cut into shards whose sizes differ by one
at most. Source blocks are partitions as they are read, so equal rows, however many, spread like any others.

The driver holds row counts by partition and the matrix (at most SOURCES x TARGETS counts, 16 MB as sent to tasks),
never rows. Beyond SOURCES partitions several share a row of the matrix, and each task halves that row by the same law
and the same seeds until its own share is left.

The counts and the exchange read df twice, so its partitions must be the same both times, as they are for a table
read from files. Any other df is written to the shared folder first (stored=False). A task that meets another number of
rows than was counted fails rather than misplace one.

Defined results: an empty table gives an empty result; repeated rows each get a slot of their own; rows with a null in
any column, ties and very long texts are placed like others, as placing looks at no value; existing columns named shard
or slot are replaced, and no other name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tickloom.llm.common import materialize, small_batches, table, unused

ROWS_PER_BLOCK = 50_000
SOURCES, TARGETS = 1_024, 2_048
#: Deviations from the mode within which the law is summed: what lies beyond has less weight than 1e-30.
SPAN = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One exact variate for a population of any size, by inversion: weights relative to the mode follow from ratios of
    neighbours, are summed outwards until they vanish, and a uniform number picks among them."""
    low, high = max(0, sample - bad), min(good, sample)
    if low >= high:
        return low
    total = good + bad
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    spread = (sample * (good / total) * (bad / total) * (total - sample) / max(1, total - 1)) ** 0.5
    reach = int(SPAN * spread) + 4 * SPAN
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    more = np.cumsum(np.log((good - up) * (sample - up)) - np.log((up + 1) * (bad - sample + up + 1)))
    less = np.cumsum(np.log(down * (bad - sample + down)) - np.log((good - down + 1) * (sample - down + 1)))
    weight = np.cumsum(np.exp(np.concatenate((less[::-1], [0.0], more))))
    return mode - len(down) + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def split(rng: np.random.Generator, rooms: list[int], take: int) -> list[int]:
    """How many of `take` rows drawn without replacement from a pool of `rooms` fall into each room."""
    pool, out = sum(rooms), []
    for room in rooms:
        k = hypergeometric(rng, room, pool - room, take)
        out.append(k)
        pool, take = pool - room, take - k
    return out


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Counts[source, target] with the given margins, as a uniform shuffle would produce them."""
    rng, left = np.random.default_rng(seed), list(map(int, targets))
    out = np.zeros((len(sources), len(targets)), dtype=np.int64)
    for i, n in enumerate(sources):
        out[i] = own = split(rng, left, int(n))
        left = [a - b for a, b in zip(left, own)]
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def own_share(matrix: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Rows of partition `part` for each target: its share of the matrix row that partitions part, part + SOURCES, ... have.

    Those partitions are halved until one is left; the first half's share is drawn with a seed of its own, so every task that
    comes by draws the same, and a task draws as often as its partitions can be halved.
    """
    line, lines = part % len(matrix), len(matrix)
    row, own = matrix[line].tolist(), sizes[line::lines]
    low, high, at = 0, len(own), part // lines
    while high - low > 1:
        half = (low + high) // 2
        first = split(np.random.default_rng((seed, 1, line, low, high)), row, int(own[low:half].sum()))
        if at < half:
            row, high = first, half
        else:
            row, low = [a - b for a, b in zip(row, first)], half
    return np.array(row, dtype=np.int64)


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 17, stored: bool = False) -> DataFrame:
    """df with `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard)."""
    spark = df.sparkSession
    small_batches(spark)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    if not stored:
        df = materialize(df, "to-shard")
    counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    sizes = np.zeros(max([r["p"] for r in counts], default=-1) + 1, dtype=np.int64)
    for r in counts:
        sizes[r["p"]] = r["n"]
    rows, lines = int(sizes.sum()), max(1, min(SOURCES, len(sizes)))
    sources = [int(sizes[i::lines].sum()) for i in range(lines)]
    cut = max(1, min(TARGETS // shards, -(-rows // (ROWS_PER_BLOCK * shards))))
    places = [(s, n) for s, size in enumerate(shard_sizes(rows, shards)) for n in shard_sizes(size, cut)]
    matrix = communication_matrix(sources, [n for _, n in places], seed)
    shard_of = np.array([s for s, _ in places], dtype=np.int32)
    length = np.array([n for _, n in places], dtype=np.int64)
    before = np.cumsum(length) - length
    before -= before[np.searchsorted(shard_of, shard_of)]
    dice, at = unused(df, "dice", "at")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        rng = np.random.default_rng((seed, 2, part))
        mine = own_share(matrix, sizes, part, seed) if part < len(sizes) else np.zeros(len(places), np.int64)
        order = rng.permutation(np.repeat(np.arange(len(places), dtype=np.int32), mine))
        for b in batches:
            to = order[done : done + b.num_rows]
            done += b.num_rows
            if done > len(order):
                break
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(shard_of[to]), pa.array(before[to]), pa.array(rng.integers(0, 1 << 63, len(to)))], names=[*b.schema.names, "shard", at, dice]
            )
        if done != len(order):
            raise RuntimeError("a partition has other rows than were counted; pass stored=False")

    dealt = df.mapInArrow(deal, StructType([*df.schema.fields, StructField("shard", IntegerType()), StructField(at, LongType()), StructField(dice, LongType())]))
    again = Window.partitionBy("shard", at).orderBy(dice)
    return dealt.select(*[F.col(f"`{c}`") for c in df.columns], "shard", (F.col(at) + F.row_number().over(again) - 1).alias("slot"))


def op9_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    light = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return shuffle_into_shards(light, 8, stored=True).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
