"""How filters interact: what each removes in every order, counted by a stream that retracts what it said too early.

Five filters judge a document. Four look at its text alone. The fifth, exact duplicates, asks whether a smaller id has
the same text, which no document can tell by itself: files arrive in any order, and the smallest id of a text may come
last. So all files go through a stream of available-now micro-batches. Its state, keyed by text, holds the smallest id met so
far and how its documents fail the other filters. A smaller id takes over: the masks counted for the earlier one are
retracted from the counters of their part and counted again as duplicates. Counters of parts are sums of these changes.

Texts are 256-bit digests, dealt into buckets of some TEXTS_A_BUCKET; one state value holds the texts of a bucket, so a
micro-batch is merged into it as a table and not text by text. Before the shuffle every batch of rows is cut down to the smallest
ids of its texts and to counters of all others, so a text that a third of all rows share costs one row a batch of rows. A
micro-batch's changes are written under its number, so a repeated one writes the same again; state and progress lie
in the shared folder.

The 120 orders need no further pass: what a filter removes at a step depends on the set of filters before it alone, and
32 counters of masks by part give all 80 such pairs.

Defined results: a null text is empty, and equal to other empty ones; a null source is an empty string; a null
doc_id is neither smaller than any other nor a duplicate; rows of one doc_id and text are neither smaller, so all stay;
several labels of one doc_id count if one of them does; a very long text is one row; other columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations, permutations
from math import ceil, factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.llm.common import delete_folder, fresh_path, importable, materialize, table, temporary

FILTERS = "ABCDE"
#: Bit of the duplicate filter; the others are the bits before it.
SAME = 1 << FILTERS.index("E")
#: Texts that one state value holds: some 300 KB.
TEXTS_A_BUCKET = 4000
#: Micro-batches that the files are dealt into, unless the caller says how many files one takes.
BATCHES = 4
LAST = (1 << 63) - 1
FILE_MANAGER = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
COUNTED = ["part", "mask", "good", "toxic"]
ROWS_SCHEMA = "bucket long, text_key binary, doc_id long, part string, mask int, good int, toxic int, n long"
STATE = pa.schema([("text_key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])


def judged(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, part, the bits of the filters A to D that a text fails, and the text's key and bucket."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    d = d.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    fails = [
        F.col("n_words") < 200,
        100 * F.col("n_distinct").cast("long") < 50 * F.col("n_words").cast("long"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 2 * F.length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum(F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails))
    d = d.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("text_key"))
    return d.withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets)))


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch of rows the smallest ids of every text, and counters (without a key) of the others."""
    for rows in frames:
        if rows.empty:
            continue
        rows["n"] = 1
        named = rows.named
        first = named & (rows.doc_id == rows.doc_id.where(named, LAST).groupby(rows.text_key).transform("min"))
        others = rows[~first].copy()
        others.loc[named[~first], "mask"] |= SAME
        others = others.groupby(COUNTED, as_index=False).agg(bucket=("bucket", "min"), n=("n", "sum"))
        rows = rows[first].groupby(["bucket", "text_key", "doc_id", *COUNTED], as_index=False).agg(n=("n", "sum"))
        yield pd.concat([rows, others.assign(text_key=None, doc_id=0)]) if len(others) else rows


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STATE) as out:
        out.write_table(pa.Table.from_pandas(rows, STATE, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def retract(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The state after new rows have come, and the changes of counters: documents that are no longer first move."""
    rows = pd.concat([held.assign(held=True), new[STATE.names].assign(held=False)], ignore_index=True)
    first = rows.doc_id == rows.groupby("text_key").doc_id.transform("min")
    came, gone = rows[~rows.held], rows[rows.held & ~first]
    changes = [came.assign(mask=came["mask"] | (~first[~rows.held]) * SAME), gone.assign(n=-gone.n), gone.assign(mask=gone["mask"] | SAME)]
    kept = rows[first].groupby(STATE.names[:-1], as_index=False).agg(n=("n", "sum"))
    return kept, pd.concat(changes)[[*COUNTED, "n"]]


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge a bucket's rows into its state and return the changes of the part counters."""
    held = _unpacked(state.get[0]) if state.exists else STATE.empty_table().to_pandas()
    for rows in frames:
        counters = rows[rows.text_key.isna()][[*COUNTED, "n"]]
        held, changes = retract(held, rows[rows.text_key.notna()])
        yield pd.concat([counters, changes]).groupby(COUNTED, as_index=False).agg(n=("n", "sum"))
    state.update((_packed(held),))


@contextmanager
def _few_processes(spark: SparkSession, folder: str) -> Iterator[None]:
    """Settings for a stream that starts inside: on a plain local or mounted file system Hadoop starts a process (chmod,
    readlink) for each state file and checksum file, which counts an executor's memory again while it starts. There, state
    is written through the plain file system, whose rename is atomic, and without files of checksums.
    """
    wanted = {}
    if "://" not in folder or folder.startswith("file:"):
        wanted = {"spark.sql.streaming.checkpoint.fileChecksum.enabled": "false", "spark.sql.streaming.checkpointFileManagerClass": FILE_MANAGER}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def masks_by_part(spark: SparkSession, path: str, labels: DataFrame, files_a_batch: int | None = None) -> DataFrame:
    """part, mask of failed filters, n documents, of these good and toxic: the sums of all changes of the stream.

    path: Parquet files of documents; labels: doc_id, quality, toxic.
    """
    importable(spark)
    whole = spark.read.parquet(path)
    files = files_a_batch or max(1, ceil(len(whole.inputFiles()) / BATCHES))
    buckets = max(64, ceil(whole.count() / TEXTS_A_BUCKET))
    changes, progress = fresh_path(spark, "changes"), fresh_path(spark, "progress")
    with temporary(spark):
        flags = materialize(
            labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
                F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
            ),
            "labels",
        )
        # As a pattern (its last character in brackets), since a stream takes a single file only by a pattern.
        pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
        stream = judged(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files).parquet(pattern), buckets)
        stream = stream.join(flags, F.col("doc_id") == F.col("labelled"), "left")
        # Ids without nulls: pandas would turn a column with nulls into floating-point numbers.
        ids = (F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"))
        stream = stream.select("bucket", "text_key", *ids, "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        moved = stream.mapInPandas(_combine, ROWS_SCHEMA).groupBy("bucket").applyInPandasWithState(
            _update, "part string, mask int, good int, toxic int, n long", "texts binary", "update", GroupStateTimeout.NoTimeout
        )

        def write(df: DataFrame, number: int) -> None:
            df.groupBy(*COUNTED).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{changes}/batch={number}")

        with _few_processes(spark, progress):
            query = moved.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        delete_folder(spark, progress)
    if not query.lastProgress:  # no file, so no batch
        return spark.createDataFrame([], "part string, mask int, n long, good long, toxic long")
    moved = spark.read.schema("part string, mask int, good int, toxic int, n long").option("recursiveFileLookup", True).parquet(changes)
    n = F.sum("n")
    return moved.groupBy("part", "mask").agg(n.alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(masks: DataFrame) -> DataFrame:
    """One row by part, order of the filters and step, from documents counted by part and mask."""
    bits = [1 << k for k in range(len(FILTERS))]
    places = [(b, sum(before)) for b in bits for k in range(len(bits)) for before in combinations([x for x in bits if x != b], k)]
    orders = []
    for order in permutations(range(len(FILTERS))):
        for step, k in enumerate(order):
            orders.append({"filter_order": "".join(FILTERS[j] for j in order), "step": step + 1, "own": bits[k], "before": sum(bits[j] for j in order[:step])})
    m = F.col("mask")
    own, before = F.col("at.own"), F.col("at.before")
    rows = masks.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("own"), F.lit(p).alias("before")) for b, p in places])).alias("at"))
    fails, earlier = m.bitwiseAND(own) != 0, m.bitwiseAND(before) != 0
    total = lambda x, where: F.sum(F.when(where, F.col(x)).otherwise(0)).cast("long")
    by_place = rows.groupBy("part", own.alias("own"), before.alias("before")).agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", m == own).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), F.bit_count("before") + 1)
    by_place = by_place.withColumn("shapley", F.sum(F.col("removed") * times).over(Window.partitionBy("part", "own")))
    # 600 rows, made without Python workers, whose memory executors hold beside that of the state.
    steps = masks.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order:string,step:int,own:int,before:int>>")))
    return by_place.join(F.broadcast(steps), ["own", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op12_retraction_stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(masks_by_part(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
  FROM d
), fails AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    list_sum([CASE WHEN contains(substr(filter_order, 1, step - 1), x) THEN 1 << (ascii(x) - 65) ELSE 0 END FOR x IN ['A', 'B', 'C', 'D', 'E']])::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), here AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, n, good, toxic, failed & bit > 0 AS hit, failed & before > 0 AS earlier, failed = bit AS one FROM fails, steps
), sums AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND one), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM here GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums
"""
