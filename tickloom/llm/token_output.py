"""Token ids in ORC: run-length encoded stripes with row indexes and a Bloom filter on doc_id.

Documents are range-partitioned by doc_id, encoded, and written one file or more a partition in ascending order.
`ids` is an integer list, which ORC stores with run-length encoding; readers may take stripes in parallel, and a
lookup by doc_id skips files, stripes and row groups by their statistics and Bloom filters.

Texts are cut where a new piece must begin, and each distinct part of a chunk of texts is looked up once in what the
worker has encoded before; Arrow numbers the parts and numpy lays their ids out. A chunk is bounded by its bytes.

Defined results: a null text is encoded as an empty one (only the end id); null doc_ids come first; repeated
doc_ids are ordered by the hash of their text, and spread over files by it; fully equal rows follow each other; a very long text is a chunk of its own; other columns
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import BATCH_ROWS, fresh_path, materialize, small_batches, table

END_ID = 0
MARKS = ".,;:!?&#*%$|"
#: Words encoded as one text: few enough that it stays in a processor's cache.
LINES = 16
#: Distinct parts whose ids a worker keeps, and bytes of text that it encodes at once.
CACHE_WORDS, CHUNK_BYTES = 400_000, 6 << 20
ORC_OPTIONS = {
    "compression": "none",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "5000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
FILE_SCHEMA = "part int, ord long, doc_id long, ids array<int>"
_encoders: dict = {}


def _spaces(data: np.ndarray) -> np.ndarray:
    """By byte of UTF-8 text, with one more at either end: whether it belongs to white space."""
    table_ = np.zeros(256, bool)
    table_[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    out = np.concatenate(([True], table_[data], [True]))
    for lead, more in ((0xC2, ("85", "a0")), (0xE1, ("9a80",)), (0xE2, (*[f"80{x:02x}" for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)], "819f")), (0xE3, ("8080",))):
        at = np.flatnonzero(data == lead)
        for tail in map(bytes.fromhex, more):
            hit = at[at + len(tail) < len(data)]
            for k, x in enumerate(tail):
                hit = hit[data[hit + k + 1] == x]
            for k in range(len(tail) + 1):
                out[hit + k + 1] = True
    return out


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a byte-level tokenizer of this family always starts a new piece, of texts that end at ends[1:].

    That is at the start of a text, before a space between two non-spaces, and around a line feed between two.
    """
    space, edge = _spaces(data), np.zeros(len(data) + 2, bool)
    edge[ends] = True  # at i + 1: the byte i is the last of a text
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[~(space[at] | edge[at] | space[at + 2] | edge[at + 1])]
    start = np.zeros(len(data) + 1, bool)
    start[ends] = start[at] = start[at[data[at] == 0x0A] + 1] = True
    return np.flatnonzero(start)


class Encoder:
    """A tokenizer with the ids of the parts met so far: the ids of slot i are pool[first[i] : first[i] + count[i]]."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.slot: dict[str, int] = {}
        self.pool, self.first = np.array([END_ID], "<u4"), np.zeros(1, np.int64)
        self.count, self.seen = np.ones(1, np.int64), np.full(1, 1 << 30)

    def forget(self, least: int = 1 << 30) -> None:
        """Drop parts that fewer than `least` chunks held. Slot 0 is the end of a document, the others are in order of learning."""
        if self.slot:
            kept = np.flatnonzero(self.seen >= least)
            words, ids = list(self.slot), self._ids(kept)
            self.slot = {words[k - 1]: i for i, k in enumerate(kept[1:].tolist(), 1)}
            self.pool, self.count, self.seen = ids, self.count[kept], self.seen[kept] // 2
            self.seen[0] = 1 << 30
            self.first = np.cumsum(self.count) - self.count

    def _encode(self, words: list[str], odd: np.ndarray, marked: np.ndarray) -> None:
        """Learn words; those without inner white space (not odd) are encoded together, a line feed between each two."""
        plain = words
        if odd.any():
            plain, inner = [w for w, o in zip(words, odd.tolist()) if not o], [w for w, o in zip(words, odd.tolist()) if o]
            marked = marked[~odd]
            coded = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(inner, add_special_tokens=False)]
            size = np.fromiter(map(len, coded), np.int64, len(inner))
            self._learn(inner, np.concatenate(coded), np.cumsum(size) - size, size)
        # Closing marks after a letter or digit are a piece by themselves, so words are encoded without them.
        both: tuple[list[str], ...] = ([], [], [])
        for w in map(plain.__getitem__, np.flatnonzero(marked).tolist()):
            if (x := w.rstrip(MARKS))[-1:].isalnum():
                for column, y in zip(both, (w, x, w[len(x) :])):
                    column.append(y)
        new = list(set(plain).difference(both[0]).union(both[1], both[2]).difference(self.slot))
        lines = ["\n".join(new[at : at + LINES]) for at in range(0, len(new), LINES)]
        coded = [x for at in range(0, len(lines), 1024) for e in self.tokenizer.encode_batch_fast(lines[at : at + 1024], add_special_tokens=False) for x in (e.ids, self.feed)]
        ids = np.fromiter(itertools.chain.from_iterable(coded), "<u4")
        ends = np.flatnonzero(ids == self.feed[0])
        if len(self.feed) != 1 or len(ends) != len(new):
            raise ValueError("the tokenizer doesn't keep line feeds apart")
        start = np.concatenate(([0], ends + 1))[:-1]
        self._learn(new, ids, start, ends - start)
        x, m = (np.fromiter(map(self.slot.__getitem__, w), np.int64, len(w)) for w in both[1:])
        pairs = np.stack((x, m), axis=1).ravel()
        size = self.count[x] + self.count[m]
        self._learn(both[0], self._ids(pairs), np.cumsum(size) - size, size)

    def _learn(self, words: list[str], ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.first), len(self.first) + len(words))))
        self.first = np.concatenate((self.first, len(self.pool) + first))
        self.count = np.concatenate((self.count, count))
        self.seen = np.concatenate((self.seen, np.zeros(len(words), np.int64)))
        self.pool = np.concatenate((self.pool, ids))

    def _ids(self, slot: np.ndarray) -> np.ndarray:
        """The ids of the slots one after the other."""
        count = self.count[slot]
        ends = np.cumsum(count)
        return self.pool[np.repeat(self.first[slot] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and where each begins and the last ends."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        at = cuts(data, ends - ends[0]).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        words, letters = parts.dictionary.to_pylist(), parts.dictionary
        if len(self.slot) > CACHE_WORDS:
            self.forget(2)
        slot = np.fromiter(map(self.slot.get, words, itertools.repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(slot < 0)):
            begin = np.frombuffer(letters.buffers()[1], np.int64)[: len(words) + 1]
            chars = np.frombuffer(letters.buffers()[2], np.uint8)[: begin[-1]]
            lead = chars[begin[:-1]] == 0x20
            odd = np.add.reduceat(_spaces(chars)[1:-1].astype(np.int64), begin[:-1]) - lead + (np.diff(begin) == lead)
            unknown = list(map(words.__getitem__, new.tolist()))
            self._encode(unknown, odd[new] > 0, np.isin(chars[begin[1:] - 1], list(MARKS.encode()))[new])
            slot[new] = np.fromiter(map(self.slot.__getitem__, unknown), np.int64, len(new))
        self.seen[slot] += 1
        slot = slot[parts.indices.to_numpy()]
        last = np.searchsorted(at, ends[1:] - ends[0])
        slot = np.insert(slot, last, 0)
        return self._ids(slot), np.concatenate(([0], np.cumsum(self.count[slot])[last + np.arange(len(last))]))


def encoder(path: str) -> Encoder:
    """The tokenizer of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in chunks of about CHUNK_BYTES, so that a part met often is looked up once."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= CHUNK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode docs (doc_id, text) and write them to path in ascending doc_id order."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in _chunks(batches):
            ids, ends = encoder(tokenizer).encode(b.column(1))
            n = b.num_rows
            for a in range(0, n, BATCH_ROWS):
                z = min(n, a + BATCH_ROWS)
                lists = pa.ListArray.from_arrays(pa.array((ends[a : z + 1] - ends[a]).astype(np.int32)), pa.array(ids[ends[a] : ends[z]].view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(z - a, part, np.int32)), pa.array(np.arange(done + a, done + z)), b.column(0).slice(a, z - a).cast(pa.int64()), lists], schema=schema
                )
            done += n

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The hash of the text parts and orders rows of one doc_id, or without one, however many they are.
    keys = ["doc_id", "text_hash", "text"]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).repartitionByRange(parts, *keys[:2]).sortWithinPartitions(*keys)
    ordered.select("doc_id", "text").mapInArrow(encode, FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of the given documents; the filter reaches the ORC reader."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of written tokens."""
    small_batches(tokens.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<i4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["part", "ord", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = materialize(tokens.mapInArrow(sums, "part int, ord long, doc_id long, n_tokens long, ids_crc32 long"), "token-digest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    run = Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )


def op7_orc_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), tokenizer, path)
    return digest(read_tokens(spark, path))
