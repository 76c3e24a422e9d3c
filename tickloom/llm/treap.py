"""Ranked lexical search: the best documents of each item, by a K2-treap over terms and documents.

Each task lays its documents out as a grid of terms by documents, whose cells hold integer impacts, and folds it into
a quadtree: a node has a bitmap of its four quadrants that hold anything, and the greatest impact below it; children
are found by counting bits. Rows are spaced (SPREAD) so that the upper levels part terms and the lower ones documents.

An item descends along the rows of all its terms at once: a range of documents has one node a term, and the weighted
sum of their maxima bounds the score of every document in the range. Ranges are opened best first, several at a time,
until none can beat the item's TOP documents so far, which a task carries from one grid to the next. Bounds of single
documents are their scores, so results are exact.

The grid's rows are the terms that items hold; no other term changes a score. Items come in chunks of bounded bytes, each
a pass over the documents. Documents are read once a chunk and stored as numbers of terms with their counts; how many
documents hold a term, how many there are and how long they are is counted over all of them.

Defined results: a null or empty text has no terms, so it is neither counted nor found, and an item without terms finds
nothing; rows of one item_id are one item with the terms of all; each row of documents is a document, so a doc_id may
come twice; equal scores go by ascending doc_id, null last; a very long text is one row of its distinct terms; other
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, small_batches, table, temporary

TOP = 20
#: Bytes of items' texts that are searched in one pass: what the driver and each task hold of them.
ITEM_BYTES = 4 << 20
#: Documents and cells of a grid, levels by which rows are spread, ranges of an item opened at a time, sizes of arrays.
GRID_DOCS, GRID_CELLS, SPREAD, OPENED, CELLS_AT_ONCE = 1 << 13, 1 << 20, 6, 64, 1 << 18
SALTS = 64
LAST = (1 << 63) - 1
_letters = bytes(range(ord("a"), ord("z") + 1))
#: Every byte outside a term becomes a space, and A-Z lower case; bytes from 0x80 on belong to terms.
TO_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or c in _letters or 0x30 <= c <= 0x39 else 0x20 for c in range(256))
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int32)


def terms(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(TO_TERMS).split()


def _interleaved(x: np.ndarray) -> np.ndarray:
    """The bits of x (below 2**32) at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A quadtree over cells (row, column, impact): node 0 is the root, and the last one stands for all empty cells."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        self.spread = SPREAD
        self.height = max(1, int(rows.max(initial=0)).bit_length() + SPREAD, int(columns.max(initial=0)).bit_length())
        code = (_interleaved(rows.astype(np.uint64) << np.uint64(SPREAD)) << np.uint64(1)) | _interleaved(columns)
        order = np.argsort(code)
        code, best = code[order], impacts[order].astype(np.int64)
        levels = [(np.zeros(len(code), np.uint8), best)]
        for _ in range(self.height if len(code) else 0):
            parent = code >> np.uint64(2)
            at = np.flatnonzero(np.diff(parent, prepend=parent[0] ^ np.uint64(1)))
            kids = np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.uint8), dtype=np.uint8), at)
            code, best = parent[at], np.maximum.reduceat(best, at)
            levels.append((kids, best))
        empty = (np.zeros(1, np.uint8), np.zeros(1, np.int64))
        self.kids, self.best = (np.concatenate([lv[k] for lv in [*levels[::-1], empty]]) for k in (0, 1))
        count = _ONES[self.kids]
        self.first = 1 + np.cumsum(count) - count  # breadth first, so children follow in the order of their parents
        self.empty = len(self.kids) - 1

    def child(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        kids = self.kids[node]
        below = self.first[node] + _ONES[kids & ((1 << quadrant) - 1)]
        return np.where(kids >> quadrant & 1, below, self.empty)


class Best:
    """The TOP documents of each item so far: by score, then id, a missing id last."""

    def __init__(self, items: int):
        self.score = np.zeros((items, TOP), np.int64)
        self.id, self.none = np.full((items, TOP), LAST), np.ones((items, TOP), bool)

    def open(self, item: np.ndarray, bound: np.ndarray, id_: np.ndarray, none: np.ndarray) -> np.ndarray:
        """Where documents of at most this score and at least this id can still come in."""
        score, last, lacks = self.score[item, -1], self.id[item, -1], self.none[item, -1]
        return (bound > score) | ((bound == score) & (bound > 0) & ((id_ < last) | ((id_ == last) & (none < lacks))))

    def add(self, item: np.ndarray, score: np.ndarray, id_: np.ndarray, none: np.ndarray) -> None:
        """Take documents in; item must be sorted."""
        touched, at, count = np.unique(item, return_index=True, return_counts=True)
        for i, a, n in zip(touched.tolist(), at.tolist(), count.tolist()):
            s, d, x = (np.concatenate((old[i], new[a : a + n])) for old, new in ((self.score, score), (self.id, id_), (self.none, none)))
            order = np.lexsort((x, d, -s))[:TOP]
            self.score[i], self.id[i], self.none[i] = s[order], d[order], x[order]


def descend(treap: Treap, ids: np.ndarray, none: np.ndarray, rows: np.ndarray, weights: np.ndarray, base: int, best: Best) -> None:
    """Search one grid for items base, base + 1, ...: rows and weights have one line an item, padded with weight 0.

    ids and none tell the id of each column, in ascending order, and whether it is missing.
    """
    h, docs = treap.height, len(ids)
    item = np.arange(len(rows))
    level, place = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    node = np.where(weights > 0, 0, treap.empty)
    bound = (weights * treap.best[node]).sum(1)
    while True:
        begin = place << (h - level)
        keep = best.open(base + item, bound, ids[begin], none[begin])
        if not keep.any():
            return
        item, level, place, bound, node = (x[keep] for x in (item, level, place, bound, node))
        order = np.lexsort((place << (h - level), -bound, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        now, later = order[rank < OPENED], order[rank >= OPENED]
        it, lv, shift = np.repeat(item[now], 2), level[now] + 1, (h - 1 - level[now])[:, None]
        bit = (rows[item[now]] << treap.spread) >> shift & 1
        below = np.stack([treap.child(node[now], 2 * bit + d) for d in (0, 1)], 1).reshape(len(it), -1)
        lv, pl = np.repeat(lv, 2), (2 * place[now][:, None] + np.arange(2)).ravel()
        top = (weights[it] * treap.best[below]).sum(1)
        inside = (top > 0) & (pl << (h - lv) < docs)
        done = inside & (lv == h)
        if done.any():
            fits = done.copy()
            fits[done] = best.open(base + it[done], top[done], ids[pl[done]], none[pl[done]])
            best.add(base + it[fits], top[fits], ids[pl[fits]], none[pl[fits]])
        more = inside & ~done
        item, level, place, bound = (np.concatenate((x[later], y[more])) for x, y in ((item, it), (level, lv), (place, pl), (bound, top)))
        node = np.concatenate((node[later], below[more]))


def _padded(items: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    wide = max((len(r) for r, _ in items), default=0)
    rows, weights = np.zeros((len(items), wide), np.int64), np.zeros((len(items), wide), np.int64)
    for i, (r, w) in enumerate(items):
        rows[i, : len(r)], weights[i, : len(r)] = r, w
    return rows, weights


def _groups(items: list[tuple[list[int], list[int]]]) -> Iterator[tuple[int, int]]:
    """Consecutive items whose ranges fit together into arrays of bounded size."""
    begin = 0
    for z in range(1, len(items) + 1):
        wide = max(len(r) for r, _ in items[begin : z + 1])
        if z == len(items) or (z + 1 - begin) * wide * OPENED > CELLS_AT_ONCE:
            yield begin, z
            begin = z


def counted_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n_terms, and of the vocabulary's terms in the text their numbers and counts; documents without terms go."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary
        for b in batches:
            ids, sizes, own, times, ends = [], [], [], [], [0]
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1)):
                found = terms(value.as_buffer().to_pybytes()) if value.is_valid else []
                if found:
                    ids.append(doc_id)
                    sizes.append(len(found))
                    for t, n in Counter(found).items():
                        if (k := number.get(t)) is not None:
                            own.append(k)
                            times.append(n)
                    ends.append(len(own))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_terms long, terms array<int>, counts array<int>")


def _grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a task in grids of bounded documents and cells."""
    held, docs, cells = [], 0, 0
    for b in batches:
        size = len(b.column(2).flatten())
        if held and (docs + b.num_rows > GRID_DOCS or cells + size > GRID_CELLS):
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, cells = [], 0, 0
        held.append(b)
        docs, cells = docs + b.num_rows, cells + size
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _search_chunk(docs: DataFrame, items: dict[int | None, Counter]) -> DataFrame:
    """item_id, doc_id, score: of each task the best documents of these items."""
    spark = docs.sparkSession
    words = sorted({t for c in items.values() for t in c})
    number = {t: i for i, t in enumerate(words)}
    stored = materialize(counted_terms(docs, number), "terms")
    total = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("length")).first()
    n, length = total["n"], max(1, total["length"])
    holding = stored.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # at most one row a term of the chunk
    # Rows go from frequent to rare, so that full cells lie together.
    holding.sort(key=lambda r: (-r["count"], r["t"]))
    row_of = np.zeros(max(1, len(words)), np.int64)
    weight = {}
    for i, r in enumerate(holding):
        row_of[r["t"]] = i
        weight[r["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    asked, names = [], []
    for item_id, c in sorted(items.items(), key=lambda x: len(x[1])):
        held = [(int(row_of[k]), weight[k] * times) for t, times in c.items() if weight.get(k := number[t], 0) > 0]
        if held:
            names.append(item_id)
            asked.append(([r for r, _ in held], [w for _, w in held]))
    groups = [(a, *_padded(asked[a:z])) for a, z in _groups(asked)]
    small_batches(spark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked))
        for grid in _grids(b for b in batches if b.num_rows):
            ids = grid.column("doc_id").combine_chunks()
            none, raw = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(LAST).to_numpy()
            order = np.lexsort((none, raw))
            column = np.empty(len(order), np.int64)
            column[order] = np.arange(len(order))
            lists, tf = grid.column("terms").combine_chunks(), grid.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            each = np.diff(lists.offsets.to_numpy())
            scale = 75 + 25 * grid.column("n_terms").to_numpy() * n // length
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(scale, each))
            treap = Treap(row_of[lists.flatten().to_numpy()], np.repeat(column, each), impact)
            for base, rows, weights in groups:
                descend(treap, raw[order], none[order], rows, weights, base, best)
        item, place = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in item.tolist()], pa.int64()), pa.array(best.id[item, place], mask=best.none[item, place]), pa.array(best.score[item, place])], names=["item_id", "doc_id", "score"]
        )

    return materialize(stored.mapInArrow(search, "item_id long, doc_id long, score long"), "found", keep=True)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents (doc_id, text) of each item (item_id, text)."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES))
    found = None
    for c in range(chunks):
        own: dict[int | None, Counter] = {}
        for r in texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).collect():
            own.setdefault(r["item_id"], Counter()).update(terms(r["text"]))
        with temporary(docs.sparkSession):
            part = _search_chunk(docs, own)
        found = part if found is None else found.union(part)
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for keys in (["item_id", "salt"], ["item_id"]):  # every task has its best of each item: first by parts, then all
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= TOP)
    return salted.select("item_id", "rank", "doc_id", "score")


def op11_k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), d AS (SELECT row, doc_id, ts, len(ts) AS n FROM words WHERE len(ts) > 0),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
  ) GROUP BY ALL
), tf AS (
  SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, totals GROUP BY t),
impact AS (
  SELECT row, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)) AS x FROM tf JOIN d USING (row), totals
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * x) AS BIGINT) AS score FROM asked JOIN weight USING (t) JOIN impact USING (t) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""
