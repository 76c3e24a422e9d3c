"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Fingerprints within RADIUS bits
are linked. The 64 bits are dealt into groups of correlated bits; every group i gets a threshold t_i of its own, or
none, with the sum of (t_i + 1) equal to RADIUS + 1: two fingerprints within RADIUS then agree in some group to
within its threshold. A dynamic programme picks the thresholds of least estimated cost (keys written and candidate
pairs expected, from pairs of sampled fingerprints and the bits' frequencies over all). A group with threshold t is probed under every
mask of t of its bits, so that close values meet in a bucket.

Buckets are compared inside tasks and yield a spanning forest of their links, never all pairs. A bucket of more
than CHUNK fingerprints is dealt into chunks and each two chunks meet in a task of their own, so nothing is capped
and no task holds more than two chunks at a time. Equal fingerprints are one node throughout.

Defined results: a null text has no words (fingerprint zero); fewer words than a shingle make one shingle; repeated
rows are each answered; a null doc_id takes part, but never names a component unless all of it have none; a very long text
is fingerprinted whole, one text of a batch at a time; a bit set in exactly half of the hashes is 0, and of equal ids and
fingerprints either stands for the others; other columns are left out; an empty table gives an empty result. A bucket's
fingerprints are dealt into chunks and copied once for each two of them, n^2 / 1,024 for n different ones.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import if_small, materialize, small_batches, table, temporary, unused
from tickloom.llm.graph import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
CHUNK = 1_024
#: Estimated cost of one key (written, sorted, read) in units of one comparison.
KEY_COST = 200.0
#: Fingerprints whose pairs show how often the bits of a group agree; they only steer the cost of a plan.
SAMPLE = 2_048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1]
    hash_ = xxhash.xxh64_intdigest
    h = np.array([hash_(joined[a:z], SEED) for a, z in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """counts[i, j] of fingerprints with bits i and j set, over all rows of fps (column fp)."""
    small_batches(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], names=["c"])

    sums = fps.select("fp").mapInArrow(run, "c array<long>").select(F.posexplode("c")).groupBy("pos").agg(F.sum("col").alias("n"))
    out = np.zeros(BITS * BITS)
    for r in sums.collect():  # 4096 rows at most
        out[r["pos"]] = r["n"]
    return out.reshape(BITS, BITS)


def correlated_groups(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal width, each bit beside those it goes with most."""
    p = np.diag(counts) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = set(range(BITS)), []
    for g in range(m):
        width = len(left) // (m - g)
        own = [max(left, key=lambda b: (near[b, sorted(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (near[b, own].sum(), -b)))
            left.discard(own[-1])
        groups.append(sorted(own))
    return groups


def sampled_prints(fps: DataFrame) -> np.ndarray:
    """At most SAMPLE fingerprints, those of least hash: a uniform sample of distinct ones for estimates of cost alone."""
    rows = fps.select("fp").orderBy(F.xxhash64(F.lit("sample"), "fp"), "fp").limit(SAMPLE).collect()
    return np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)


def close_share(group: list[int], agree: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """By t: estimated share of pairs that differ in at most t bits of the group.

    The bits of a group go together, so pairs of sampled fingerprints are compared as they are; where the sample is too
    small to show a pair, the share that independent bits would have stands in as the least value.
    """
    d = np.zeros(RADIUS + 2)
    d[0] = 1.0
    for a in agree[group]:
        d[1:] = d[1:] * a + d[:-1] * (1 - a)
        d[0] *= a
    alone = np.cumsum(d)
    if len(sample) < 2:
        return alone
    own = sample & np.uint64(sum(1 << b for b in group))
    seen = np.zeros(RADIUS + 2)
    for lag in range(1, len(own)):
        seen += np.bincount(np.minimum(np.bitwise_count(own[lag:] ^ own[:-lag]), RADIUS + 1), minlength=RADIUS + 2)
    return np.maximum(alone, np.cumsum(seen) / seen.sum())


def allocate(groups: list[list[int]], agree: np.ndarray, n: int, sample: np.ndarray) -> tuple[float, list[int]]:
    """Least cost and thresholds (-1: not probed) with the sum of (t + 1) equal to RADIUS + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        share, step = close_share(g, agree, sample), {}
        for spent, (cost, ts) in best.items():
            for t in range(-1, RADIUS + 1 - spent):
                keys = 0 if t < 0 else math.comb(len(g), t)
                c = cost + (0.0 if t < 0 else KEY_COST * n * keys + n * n / 2 * share[t] * min(keys, t + 1))
                if t <= len(g) and (spent + t + 1 not in step or c < step[spent + t + 1][0]):
                    step[spent + t + 1] = (c, [*ts, t])
        best = step
    return best[RADIUS + 1]


def plan_probes(counts: np.ndarray, n: int, sample: np.ndarray) -> list[int]:
    """Masks under which fingerprints are bucketed; any two within RADIUS bits agree under one of them."""
    p = np.diag(counts) / max(n, 1)
    agree = p * p + (1 - p) ** 2
    plans = []
    for m in range(1, 7):
        groups = correlated_groups(counts, n, m)
        cost, ts = allocate(groups, agree, max(n, 1), sample)
        if sum(math.comb(len(g), t) for g, t in zip(groups, ts) if t >= 0) <= 4_096:
            plans.append((cost, m, groups, ts))
    _, _, groups, ts = min(plans, key=lambda x: x[:2])
    return [sum(1 << b for b in g if b not in off) for g, t in zip(groups, ts) if t >= 0 for off in itertools.combinations(g, t)]


def _forest(key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of each run of equal keys: positions of fingerprints within RADIUS bits."""
    n = len(fp)
    parent, flat, links = list(range(n)), np.arange(n), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    at, lag = np.flatnonzero(key[1:] == key[:-1]), 1
    while len(at):
        close = at[(np.bitwise_count(fp[at] ^ fp[at + lag]) <= RADIUS) & (flat[at] != flat[at + lag])]
        for i in close.tolist():
            a, b = root(i), root(i + lag)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, i + lag))
        if len(close):
            flat = np.array(parent)
            while (up := flat[flat]).tolist() != flat.tolist():
                flat = up
        lag += 1
        at = at[at + lag < n]
        at = at[key[at] == key[at + lag]]
    return links


def links(fps: DataFrame, n: int) -> DataFrame:
    """u, v: enough links of distinct fingerprints within RADIUS bits to connect all that are linked."""
    spark = fps.sparkSession
    small_batches(spark)
    masks = plan_probes(bit_counts(fps), n, sampled_prints(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(masks)])).alias("key"))
    sizes = keys.groupBy("key").count().filter("count > 1")
    chunks = F.ceil(F.col("count") / CHUNK).cast("int")
    met = keys.join(sizes, "key").select("key", "fp", chunks.alias("k"), F.pmod(F.xxhash64(F.lit("chunk"), "fp"), chunks).cast("int").alias("c"))
    met = met.select("key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    met = met.select("fp", F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            pairs = np.array(_forest(k, f.view(np.uint64)), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(f[pairs[:, 0]]), pa.array(f[pairs[:, 1]])], names=["u", "v"])

        for b in batches:
            key, fp = np.concatenate((key, b.column(0).to_numpy())), np.concatenate((fp, b.column(1).to_numpy()))
            if len(key) >= 1 << 15 and (cut := int(np.searchsorted(key, key[-1]))):  # the last run may go on
                yield out(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield out(key, fp)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp, component_id, root of docs (doc_id, text)."""
    with temporary(docs.sparkSession):
        prints = materialize(fingerprints(docs, shingle), "fingerprints")
        nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
        roots = components(links(nodes, nodes.count()))
        named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        return materialize(prints.join(named.join(least, "root").select("fp", "root", "component_id"), "fp"), "near-duplicates", keep=True)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without near-copies: the row of least doc_id (then text) of each component stays; columns as they are."""
    return first_of_each(docs, materialize(near_duplicates(docs).select("doc_id", "text_hash", "root"), "near-duplicates"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of least doc_id (then text) of each root stays. found: doc_id, text_hash, root of every row of docs.

    A row with a null doc_id stays only where its root has no other; of those the least text hash does.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = found.groupBy("root").agg(F.min(order).alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    best = materialize(best, "classes", keep=True)  # of one row there is nothing to choose
    stay = F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("text_hash") == F.col("b.text_hash"))
    i, g, h = unused(docs, "own_id", "own_hash", "text_hash")
    light = found.join(if_small(best, best.count()), "root").select(F.col("doc_id").alias(i), F.col("text_hash").alias(g), stay.alias("stay"))
    gone = materialize(light.filter(~F.col("stay")).select(i, g).distinct(), "copies", keep=True)
    twice = materialize(light.filter("stay").groupBy(i, g).count().filter("count > 1").drop("count"), "repeated", keep=True)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(g))
    rows = docs.withColumn(h, F.xxhash64("text")).join(if_small(gone, gone.count()), same, "left_anti")
    again = if_small(twice, twice.count())
    once = rows.join(again, same, "left_anti")
    return once.unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", h])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
