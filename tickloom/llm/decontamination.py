"""Benchmark decontamination by SimHash of item-sized windows, with built-in functions only.

Words are runs of letters and digits, lower-cased; shingles have five words. A window of a document is as long as
a benchmark item. A window similar to an item shares shingles with it, so windows are laid only where a document
has a shingle of some item of that length: each such shingle is tried as the first shared one, which at similarity S stands
within the first (1 - S) of the window. Nothing similar is lost by that. The shingle places a window and no more; which
items the window meets is for the index to say.

Windows and items get 64-bit SimHash fingerprints. Eight blocks of eight bits are indexed by length of item, each with all
values within two bits: fingerprints within RADIUS = 23 bits agree to within two in some block, so a window's eight blocks
find all items of its length within the radius, and pairs beyond it are dropped. A pair at similarity 0.8 differs in about 10 bits,
and in more than 23 about twice in a million. Candidates are verified by the exact similarity of shingles weighted by
how often each occurs: sum of the lesser over sum of the greater weights.

An item of fewer than five words is one shingle of all its words, which a document must hold exactly; it is looked for if it
has LETTERS letters and digits, as a few short words are no evidence.

Equal texts are looked at once. What is broadcast is measured in bytes first; beyond the bound Spark shuffles.

Defined results: null and empty texts match nothing; items of fewer than five words and of fewer than LETTERS letters
match nothing; a null doc_id or item_id is reported as such; repeated rows
are each reported; of windows alike the first is; a very long text is one row of shingles, cut into windows where it
meets items; an empty table on either side gives an empty result; other columns are left out, or kept as they are by
without_contaminated.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import if_light, if_small, materialize, table, unused

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 64, 8, 8, 2
#: Guaranteed: more than 8 blocks x 2 bits + 7 further bits are needed to differ by 3 in every block.
RADIUS = BLOCKS * BLOCK_RADIUS + BLOCKS - 1
#: Least letters and digits of an item of fewer than five words.
LETTERS = 12
#: Bytes of a broadcast row of a benchmark shingle, and of one of the index, besides its values.
ROW_BYTES = 48


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(text: Column) -> Column:
    """array<long>: hashes of the five-word shingles of a text, in order."""
    one = F.array(F.struct(words_of(text).alias("w")))
    return F.flatten(
        F.transform(
            one,
            lambda x: F.when(
                F.size(x["w"]) >= SHINGLE,
                F.transform(F.sequence(F.lit(0), F.size(x["w"]) - SHINGLE), lambda i: F.xxhash64(*[F.get(x["w"], i + k) for k in range(SHINGLE)])),
            ).otherwise(F.array().cast("array<long>")),
        )
    )


def simhash(hashes: Column) -> Column:
    """Bits set in over half of the hashes."""
    n = F.size(hashes)
    ones = lambda k: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftright", h, k).bitwiseAND(F.lit(1).cast("long")).cast("int"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("long"),
        lambda a, k: a.bitwiseOR(F.when(2 * ones(k) > n, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))),
    )


def _block(fp: Column, b: int) -> Column:
    return F.shiftright(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def _index_keys(fp: Column, probe: bool) -> Column:
    """array<int>: block number and value; for the indexed side with every value within BLOCK_RADIUS bits."""
    masks = [sum(1 << i for i in c) for t in range(BLOCK_RADIUS + 1) for c in itertools.combinations(range(BLOCK_BITS), t)]
    variants = F.array(*map(F.lit, [0] if probe else masks))
    keys = lambda b: F.transform(variants, lambda m: _block(fp, b).bitwiseXOR(m) + F.lit(b << BLOCK_BITS))
    return F.flatten(F.array(*[keys(b) for b in range(BLOCKS)]))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of lesser over sum of greater counts of two arrays' elements."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """text_key, item_id, window (first word), similarity, distance: the best window of each text and item."""
    items = benchmark.select("item_id", shingle_hashes(F.col("text")).alias("shingles")).filter(F.size("shingles") > 0)
    items = materialize(items.select("item_id", "shingles", F.size("shingles").alias("m"), simhash(F.col("shingles")).alias("item_fp")), "items")
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    known = items.select(F.explode("shingles").alias("h"), "m").distinct()
    keyed = docs.select(F.md5(F.encode("text", "UTF-8")).alias("text_key"), "text").filter("text IS NOT NULL")
    hashed = keyed.select("text_key", shingle_hashes(F.col("text")).alias("shingles"))
    hits = hashed.select("text_key", F.posexplode("shingles").alias("pos", "h")).join(if_light(known, n_shingles * ROW_BYTES), "h")
    back = F.floor((1 - similarity) * F.col("m")).cast("int")
    starts = hits.select("text_key", "m", F.explode(F.sequence(F.greatest(F.col("pos") - back, F.lit(0)), "pos")).alias("s"))
    tried = materialize(starts.groupBy("text_key").agg(F.collect_set(F.struct("m", "s")).alias("at")), "windows")
    mine = if_small(tried.select("text_key"), tried.count())
    texts = hashed.join(mine, "text_key", "left_semi").dropDuplicates(["text_key"])
    cut = texts.join(tried, "text_key").select("text_key", "shingles", F.explode("at").alias("a"))
    cut = cut.select("text_key", "a.m", "a.s", F.slice("shingles", F.col("a.s") + 1, F.col("a.m")).alias("win"))
    windows = materialize(cut.withColumn("fp", simhash(F.col("win"))), "windows")
    per_item = BLOCKS * sum(math.comb(BLOCK_BITS, t) for t in range(BLOCK_RADIUS + 1))
    index = if_light(items.select("item_id", "m", "item_fp", F.explode(_index_keys(F.col("item_fp"), False)).alias("key")), n_items * per_item * ROW_BYTES)
    probes = windows.select("text_key", "m", "s", "fp", F.explode(_index_keys(F.col("fp"), True)).alias("key"))
    met = probes.join(index, ["m", "key"])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    first = F.array_min(F.filter(F.array(*[F.when(F.bit_count(_block(F.col("fp"), b).bitwiseXOR(_block(F.col("item_fp"), b))) <= BLOCK_RADIUS, F.lit(b)) for b in range(BLOCKS)]), lambda x: x.isNotNull()))
    once = met.filter((distance <= RADIUS) & (F.shiftright("key", BLOCK_BITS) == first))  # a pair counts in its first block
    near = once.select("text_key", F.struct("item_id").alias("i"), "item_fp", "m", "s", distance.alias("distance")).distinct()
    whole = if_light(items.select(F.struct("item_id").alias("i"), "item_fp", F.col("shingles").alias("item")).distinct(), 8 * n_shingles + n_items * ROW_BYTES)
    pairs = near.join(windows.select("text_key", "m", "s", "win"), ["text_key", "m", "s"]).join(whole, ["i", "item_fp"])
    right = pairs.select("text_key", "i.item_id", "s", "distance", weighted_similarity(F.col("win"), F.col("item")).alias("similarity")).filter(F.col("similarity") >= similarity)
    best = right.groupBy("text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("s")).alias("back"), "distance")).alias("b"))
    best = best.select("text_key", "item_id", (-F.col("b.back")).alias("window"), "b.similarity", "b.distance")
    return materialize(best.unionByName(_short_items(keyed, benchmark)), "contaminated")


def _short_items(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same columns for items of fewer than five words: where a text (text_key, text) holds their words in a row."""
    run = lambda words, i, n: F.xxhash64(F.array_join(F.slice(words, i, n), " "))
    letters = F.length(F.array_join("w", ""))
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter((F.size("w") < SHINGLE) & (letters >= LETTERS))
    items = materialize(items.select("item_id", F.size("w").alias("n"), run(F.col("w"), F.lit(1), F.size("w")).alias("h")).distinct(), "short")
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # at most SHINGLE - 1
    if not sizes:
        return items.filter(F.lit(False)).select(F.lit("").alias("text_key"), "item_id", F.lit(0).alias("window"), F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"))
    words = keyed.select("text_key", words_of(F.col("text")).alias("w")).withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).filter(F.size("w") >= F.col("n"))
    runs = words.select("text_key", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: run(F.col("w"), i, F.col("n")))).alias("window", "h"))
    found = runs.join(if_light(items, items.count() * ROW_BYTES), ["n", "h"]).groupBy("text_key", "item_id").agg(F.min("window").alias("window"))
    return found.select("text_key", "item_id", "window", F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"))


def text_key(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, window, similarity, distance of every document and item that it holds."""
    found = contaminated_texts(docs, benchmark)
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key")).join(if_small(found, found.count()), "text_key").drop("text_key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs less those that hold an item; columns as they are."""
    (key,) = unused(docs, "text_key")
    found = contaminated_texts(docs, benchmark).select(F.col("text_key").alias(key)).distinct()
    rows = docs.withColumn(key, text_key(F.col("text")))
    return rows.join(if_small(found, found.count()), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
