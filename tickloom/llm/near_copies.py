"""Near-copies at a stated similarity: SimHash candidates, each verified on the texts' whole sets of shingles.

Two texts are linked where their sets of five-word shingles have a Jaccard similarity of SIMILARITY or more; classes
are the connected components. At 0.8, fingerprints of 64 bits lie about 10 bits apart and up to 20, where the bit
groups of `simhash` would need hundreds of keys. They still give the first candidates, at their radius of three bits.
The rest come from the same principle applied to groups of shingles: shingles are dealt by hash into more groups than
shingles can differ at SIMILARITY, so some group is the same in both texts, and so is its fingerprint. How many can
differ depends on the number of shingles, so texts are keyed at two levels of length; every two texts that can be
similar share one. Of a level's groups the first KEYS are used: texts of about 90 shingles have no more, and for longer
ones each group is untouched with a chance of 0.4 or more, so a pair exactly at 0.8 is missed at most 5 times in 100,000.
A group without shingles makes no key, which short texts can't afford: up to SHORT shingles the least hashes of a text
are keys as well (prefix filter; a set similar to it holds at least ceil(SIMILARITY n) of its n, so both share one of the
n - ceil(SIMILARITY n) + 1 least), at the same two levels. Texts whose similar texts are all that short have no others.
With exact=True texts of every length are keyed that way and no pair is missed; a text of n shingles then has some 0.4 n
keys in place of 40 at most, and travels with its set to as many buckets.

Candidates never become rows of pairs. Texts travel with their sets of shingles to the buckets of their keys, where a
task compares whole sets and returns the links of a spanning forest. Buckets of the same members count once. First each
text meets its largest bucket, in parts that all hold the bucket's least text; that joins the copies of one text at
linear cost. Then the buckets that still hold several classes are compared in full: one beyond CHUNK texts or
CHUNK_HASHES shingles is dealt into chunks, and each two chunks meet in a task of their own, so no task holds more than
two chunks and nothing is capped.

Defined results: words are lower-cased in A-Z and parted by ASCII white space; a null text has no words; texts without
words are copies of each other; fewer words than a shingle make one shingle; equal texts are one node, found by a
64-bit hash; a very long text is keyed and compared with all its shingles; of equal doc_ids in a class the least text hash
stays, and fully equal rows stay or go together but for one; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import simhash
from tickloom.llm.common import if_small, materialize, small_batches, temporary
from tickloom.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: Groups of shingles that make a key, at each of a text's two levels.
KEYS = 20
#: Shingles up to which a text is keyed by its least hashes, without a miss.
SHORT = 40
#: Texts, and shingles of all of them, that a chunk holds on average.
CHUNK, CHUNK_HASHES = 1_024, 1 << 20
#: Shingles compared at once, as columns of a matrix of texts.
COLUMNS = 4_096


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a whole text's shingles, ascending."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1]
    hash_ = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_(joined[a:z], simhash.SEED) for a, z in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist())], dtype=np.uint64))


def _prints(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of the runs of h that begin at starts."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    ones = np.add.reduceat(bits, starts, axis=0)
    return np.packbits(2 * ones > np.diff(np.append(starts, len(h)))[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def group_keys(h: np.ndarray, exact: bool = False) -> np.ndarray:
    """Keys at both levels of a text's length: of its least hashes if it is short, or if exact, of its used groups of shingles if not."""
    if not len(h):
        return np.zeros(1, np.uint64)
    keys, own = [], math.floor(math.log(len(h)) / -math.log(SIMILARITY) + 1e-9)
    for level in (own, own + 1):
        if exact or len(h) <= SHORT:
            least = h[: len(h) - math.ceil(SIMILARITY * len(h) - 1e-9) + 1]
            keys.append(_mixed(least + np.full(1, level + (1 << 32), np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        if exact or len(h) <= SIMILARITY * SHORT + 1e-9:  # all that is similar to it is short, too
            continue
        longest = SIMILARITY ** -(level + 1)
        groups = math.floor(2 * longest * (1 - SIMILARITY) / (1 + SIMILARITY)) + 1
        g = h % np.uint64(groups)
        order = np.argsort(g, kind="stable")
        order = order[: int(np.searchsorted(g[order], KEYS))]
        if len(order):
            at, starts = np.unique(g[order], return_index=True)
            keys.append(_mixed(_prints(h[order], starts) + (at + np.uint64(level * KEYS + 1)) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _listed(node: list[int], sets: list[np.ndarray], *more: tuple[str, pa.Array]) -> pa.RecordBatch:
    """text_hash and hashes (a list each), with further columns."""
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), lists, *[x for _, x in more]], names=["text_hash", "hashes", *[n for n, _ in more]])


def keyed(docs: DataFrame, exact: bool = False) -> DataFrame:
    """text_hash, hashes (its keys), fp, size (shingles) of every row of docs; equal texts of a batch once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {}
            for node, text in zip(b.column(0).to_pylist(), b.column(1)):
                if node not in rows:
                    h = shingles(text.as_py())
                    rows[node] = (int(_prints(h, np.zeros(1, np.int64))[0]) if len(h) else 0, group_keys(h, exact).view(np.int64), len(h))
            fp = np.array([r[0] for r in rows.values()], dtype=np.uint64).view(np.int64)
            size = np.array([r[2] for r in rows.values()], dtype=np.int64)
            yield _listed(list(rows), [r[1] for r in rows.values()], ("fp", pa.array(fp)), ("size", pa.array(size)))

    return docs.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "text_hash long, hashes array<long>, fp long, size long")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_hash, hashes (its set of shingles) of the wanted texts, once each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = dict(zip(b.column(0).to_pylist(), b.column(1)))
            yield _listed(list(texts), [shingles(t.as_py()).view(np.int64) for t in texts.values()])

    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash", "left_semi")
    return texts.mapInArrow(run, "text_hash long, hashes array<long>").dropDuplicates(["text_hash"])


def _matches(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Positions i < j of sets at SIMILARITY or more. Sets are counted against each other as rows of a 0/1 matrix of shingles."""
    size = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if (1 + SIMILARITY) * both >= SIMILARITY * size.sum() - 1e-9:
            yield 0, 1
        return
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    owner, hashes = np.repeat(np.arange(len(sets)), size)[order], hashes[order]
    column = np.cumsum(np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - a] = 1
        both += has @ has.T
    found = (1 + SIMILARITY) * both >= SIMILARITY * (size[:, None] + size[None]) - 1e-6
    yield from zip(*(x.tolist() for x in np.nonzero(np.triu(found, 1))))


def forest(node: list[int], root: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of similar texts that join the classes (by root) which meet here."""
    parent = {r: r for r in root}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out = []
    if len(parent) > 1:
        for i, j in _matches(sets):
            a, b = top(root[i]), top(root[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node[i], node[j]))
    return out


def linked(met: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: a spanning forest of the similar texts of each bucket of met (key, text_hash, root)."""
    small_batches(met.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, root, held = None, [], [], []

        def out() -> pa.RecordBatch:
            found = forest(node, root, held) if len(node) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for b in batches:
            flat, ends = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
            for i, (k, n, r) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                if k != key:
                    yield out()
                    key, node, root, held = k, [], [], []
                node.append(n)
                root.append(r)
                held.append(flat[ends[i] : ends[i + 1]])
        yield out()

    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = met.join(sets, "text_hash").select("key", "text_hash", "root", "hashes")
    return rows.repartition(parts, "key").sortWithinPartitions("key", "text_hash").mapInArrow(run, "u long, v long").distinct()


def buckets(nodes: DataFrame) -> DataFrame:
    """key, text_hash, n, chunks, least of every bucket of several texts; buckets of the same members count once."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("text_hash").alias("first")), "fingerprints")
    close = simhash.links(firsts, firsts.count())
    close = close.join(firsts.toDF("u", "first_u"), "u").join(firsts.toDF("v", "first_v"), "v")
    close = close.select(F.xxhash64(F.lit("link"), "first_u", "first_v").alias("key"), F.explode(F.array("first_u", "first_v")).alias("text_hash"))
    keys = nodes.select(F.explode("hashes").alias("key"), "text_hash", "size")
    keys = keys.union(nodes.select(F.xxhash64(F.lit("print"), "fp"), "text_hash", "size"))
    keys = keys.union(close.join(nodes.select("text_hash", "size"), "text_hash").select("key", "text_hash", "size"))
    members = F.struct(F.count("*"), F.bit_xor(F.xxhash64("text_hash")), F.sum(F.pmod(F.xxhash64(F.lit(1), "text_hash"), F.lit(1 << 40))))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.min("text_hash").alias("least"), members.alias("members")).filter("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("hashes") / CHUNK_HASHES)).cast("int")
    once = sizes.groupBy("members").agg(F.min(F.struct("key", "n", chunks.alias("chunks"), "least")).alias("b")).select("b.*")
    once = materialize(once, "buckets")
    return keys.select("key", "text_hash").join(if_small(once, once.count()), "key")


def _chunk(text_hash: str = "text_hash") -> Column:
    return F.pmod(F.xxhash64(F.lit("chunk"), text_hash), F.col("chunks")).cast("int")


def classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """text_hash, root (one text hash of the class) of every text of docs (text) that has a near-copy."""
    nodes = materialize(keyed(docs, exact).dropDuplicates(["text_hash"]), "nodes")
    met = materialize(buckets(nodes), "members")
    wanted = materialize(met.select("text_hash").distinct(), "wanted")
    sets = materialize(shingle_sets(docs, if_small(wanted, wanted.count())), "shingles")

    largest = met.groupBy("text_hash").agg(F.max(F.struct("n", "key", "chunks", "least")).alias("b")).select("text_hash", "b.*")
    part = lambda c: F.xxhash64(F.lit("first"), "key", c).alias("key")
    leaders = largest.select("key", "chunks", "least").distinct()
    leaders = leaders.select("key", F.col("least").alias("text_hash"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
    first = largest.select(part(_chunk()), "text_hash").union(leaders.select(part(F.col("c")), "text_hash")).distinct()
    near = materialize(linked(first.withColumn("root", F.col("text_hash")), sets), "near")

    roots = components(near).withColumnRenamed("node", "text_hash")
    named = met.join(roots, "text_hash", "left").select("key", "text_hash", "chunks", F.coalesce("root", "text_hash").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z").select("key")
    rest = named.join(mixed, "key").select("key", "text_hash", "root", _chunk().alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    rest = rest.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"), "text_hash", "root")
    more = materialize(linked(rest, sets), "near")
    return components(near.union(more)).withColumnRenamed("node", "text_hash")


def one_of_each_group(docs: DataFrame, exact: bool = False) -> DataFrame:
    """docs without near-copies: the row of least doc_id (then text hash) of each class stays; columns as they are."""
    with temporary(docs.sparkSession):
        named = materialize(classes(docs, exact), "classes")
        rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
        found = rows.join(if_small(named, named.count()), "text_hash", "left")
        found = found.select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))
        return simhash.first_of_each(docs, materialize(found, "near-copies", keep=True))
