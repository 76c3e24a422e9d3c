"""Removal of repeated byte strings by sorting suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (smaller doc_id, or the same document
and an earlier start). Sorting every suffix would shuffle each byte of the corpus LENGTH times, so suffixes are
thinned without loss: every start s is assigned to the suffix within s .. s + LENGTH - GRAM whose first GRAM bytes
have the least hash. That choice depends on the LENGTH bytes alone, so equal strings are assigned alike. About one
suffix in 31 is left, each standing for a range of starts.

The suffixes are range-partitioned by their leading bytes at sampled splitters (then by hash of the leading GRAM
bytes, by the hash of all bytes that the range of starts covers, and by place), so that one string that fills the
corpus still spreads over many buckets. Buckets are sorted locally; neighbours are compared in each bucket, and
what begins or ends a bucket is compared across boundaries. A suffix whose whole range occurred earlier is done.
The few that share leading bytes with others but not the whole range - at the edges of copies - are spelled out
start by start and sorted the same way by their full strings' hashes (two of 64 bits).

Defined results: a null text has no bytes; a null doc_id is smaller than any other; rows of one doc_id at the same
start are neither earlier than the other, so repeated rows are treated alike; rows of one doc_id, or without one, are told
apart by the 64-bit hash of their text; a very long text is worked through in segments of a megabyte; other columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import if_light, if_small, materialize, small_batches, table, temporary

LENGTH, GRAM = 100, 40
REACH = LENGTH - GRAM  # ranges of starts span 0 to REACH
SPAN_BITS = 6
SEGMENT = 1 << 20
CHUNK_ROWS = 1 << 17
#: Bytes of places, or of removed runs, up to which they are broadcast to the documents.
BROADCAST_BYTES = 32 << 20
#: A row of documents, wherever it is met: its doc_id, if any, and the 64-bit hash of its text.
SAME_ROW = "d.doc_id <=> p.doc_id AND d.tag = p.tag"
AT = ["doc_id", "tag", "place"]
SUFFIX = ["g", "c", "doc_id", "tag", "place"]
_U = np.uint64
_tables: dict = {}


def _constants() -> tuple:
    """Random byte codes, powers of an odd base and of its inverse, for two independent hashes."""
    if not _tables:
        rng, n = np.random.default_rng(20240501), SEGMENT + 2 * LENGTH + REACH + 1
        for k in (0, 1):
            base = int(rng.integers(1 << 60)) * 8 + 5
            inverse = pow(base, -1, 1 << 64)
            powers = [np.cumprod(np.concatenate((np.ones(1, _U), np.full(n - 1, _U(b))))) for b in (base, inverse)]
            _tables[k] = (rng.integers(0, 1 << 64, 256, dtype=_U), *powers)
    return _tables[0], _tables[1]


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any substring follows, and the powers that shift it to a common origin."""
    codes, powers, inverse = _constants()[which]
    return np.concatenate((np.zeros(1, _U), np.cumsum(codes[data] * inverse[: len(data)]))), powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(32))


def _layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the documents' offsets in them; nulls are empty."""
    column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.empty(0, np.uint8)
    return data, ends - ends[0] if len(column) else np.zeros(1, np.int64)


def _place(start: np.ndarray, span: np.ndarray) -> np.ndarray:
    """A range of starts in a text as one number: the first and how many follow (at most REACH)."""
    return (start << SPAN_BITS) | span


def _start(place: np.ndarray) -> np.ndarray:
    return place >> SPAN_BITS


def _span(place: np.ndarray) -> np.ndarray:
    return place & ((1 << SPAN_BITS) - 1)


def thinned(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """doc index, first start in it, span of starts, hash of leading bytes, hash of all covered bytes."""
    n = len(data)
    doc_of = lambda at: np.searchsorted(ends, at, side="right") - 1
    for a in range(0, n, SEGMENT):
        seg = data[a : a + SEGMENT + LENGTH + REACH]
        m = len(seg) - LENGTH + 1
        if m <= 0:
            continue
        q, powers = _sums(seg, 0)
        gram = _mix((q[GRAM:] - q[:-GRAM]) * powers[: len(seg) - GRAM + 1])
        order = (gram & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(len(gram), dtype=_U))
        low, width = order, 1
        while 2 * width <= REACH + 1:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        rest = REACH + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        starts = np.arange(min(m, SEGMENT, n - a))
        doc = doc_of(starts + a)
        whole = starts + a + LENGTH <= ends[doc + 1]
        starts, doc = starts[whole], doc[whole]
        if not len(starts):
            continue
        anchor = (_U(0xFFFFFFFF) - (low[starts] & _U(0xFFFFFFFF))).astype(np.int64)
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        lo, hi = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
        at, d = anchor[np.concatenate(([0], cut))], doc[np.concatenate(([0], cut))]
        lead = (seg[at].astype(_U) << _U(56)) | (seg[at + 1].astype(_U) << _U(48)) | (seg[at + 2].astype(_U) << _U(40))
        g = lead | (gram[at] & _U((1 << 40) - 1))
        c = _mix(_mix((q[hi + LENGTH] - q[lo]) * powers[lo]) + (hi - lo).astype(_U))
        yield d, lo + a - ends[d], hi - lo, g, c


def _bucket(docs: DataFrame) -> DataFrame:
    """g, c, doc_id, tag, place of the thinned suffixes. docs: doc_id, tag, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _layout(b.column(2))
            for d, lo, span, g, c in thinned(data, ends):
                rows = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array(_place(lo, span))], names=SUFFIX
                )

    return docs.mapInArrow(run, "g long, c long, doc_id long, tag long, place long")


def _compare(rows: DataFrame) -> DataFrame:
    """kind, g, c, doc_id, tag, place: rows of a class (g, c) after its first place (kind 0), and the first of each class
    where g has several (1) or where the group touches the end of what was compared at once (2)."""

    def judge(g: np.ndarray, c: np.ndarray, doc: np.ndarray, null: np.ndarray, tag: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        n = len(g)
        new_g = np.concatenate(([True], g[1:] != g[:-1]))
        new_c = new_g | np.concatenate(([True], c[1:] != c[:-1]))
        first = np.maximum.accumulate(np.where(new_c, np.arange(n), 0))
        later = (doc != doc[first]) | (null != null[first]) | (_start(place) != _start(place[first]))
        group = np.cumsum(new_g) - 1
        classes = np.bincount(group, weights=new_c)
        edge = (group == 0) | (group == group[-1])
        lead = ~later & (new_c | (tag != tag[first]) | (place != place[first]))
        kind = np.where(later, 0, np.where(lead & edge, 2, np.where(lead & (classes[group] > 1), 1, -1)))
        at = np.flatnonzero(kind >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(kind[at].astype(np.int32)), pa.array(g[at]), pa.array(c[at]), pa.array(doc[at], mask=null[at]), pa.array(tag[at]), pa.array(place[at])], names=["kind", *SUFFIX]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            null = t.column(2).is_null().to_numpy()
            return judge(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).fill_null(0).to_numpy(), null, t.column(3).to_numpy(), t.column(4).to_numpy())

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK_ROWS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g", "c", "doc_id", "place", "tag"]
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*SUFFIX).mapInArrow(run, "kind int, g long, c long, doc_id long, tag long, place long")


def _across(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that repeat an earlier place, and the firsts of classes whose g has several; boundaries resolved."""
    start = F.shiftright("place", SPAN_BITS)
    edge = found.filter("kind = 2")
    first = edge.groupBy("g", "c").agg(F.min(F.struct("doc_id", start.alias("start"))).alias("f"))
    judged = edge.join(first, ["g", "c"]).withColumn("later", ~F.struct("doc_id", start.alias("start")).eqNullSafe(F.col("f")))
    several = materialize(first.groupBy("g").count().filter("count > 1").select("g"), "several")
    several = if_small(several, several.count())
    repeats = found.filter("kind = 0").select(*AT).unionByName(judged.filter("later").select(*AT))
    firsts = found.filter("kind = 1").select(*AT).unionByName(judged.filter("NOT later").join(several, "g", "left_semi").select(*AT))
    return repeats, firsts


def _by_row(places: DataFrame) -> GroupedData:
    """Places by row of documents; rows of one doc_id, or without one, stay apart by their texts."""
    return places.groupBy("doc_id", "tag")


def _spelled(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """g, c, doc_id, tag, place: each start in the places of firsts, by two hashes of its LENGTH bytes."""
    places = materialize(_by_row(firsts).agg(F.collect_list("place").alias("places")), "edges")
    rows, total = places.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    both = docs.alias("d").join(if_light(places, 8 * total + 48 * rows, BROADCAST_BYTES).alias("p"), F.expr(SAME_ROW)).select("d.doc_id", "d.tag", "d.text", "p.places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _layout(b.column(2))
            lists, got = b.column(3), []
            for i in range(b.num_rows):
                p = lists[i].values.to_numpy()
                span = _span(p) + 1
                s = np.repeat(_start(p), span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
                got.append((i, np.unique(s)))
            for i, s in got:
                text = data[ends[i] : ends[i + 1]]
                for a in range(0, len(text), SEGMENT):
                    mine = s[(s >= a) & (s < a + SEGMENT)]
                    if len(mine):
                        h = []
                        for which in (0, 1):
                            q, powers = _sums(text[a : a + SEGMENT + LENGTH], which)
                            h.append(_mix((q[mine - a + LENGTH] - q[mine - a]) * powers[mine - a]).view(np.int64))
                        rows = pa.array(np.full(len(mine), i))
                        yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), b.column(0).take(rows), b.column(1).take(rows), pa.array(_place(mine, np.zeros_like(mine)))], names=SUFFIX)

    return both.mapInArrow(run, "g long, c long, doc_id long, tag long, place long")


def _runs(places: DataFrame) -> DataFrame:
    """doc_id, tag, runs: maximal removed runs of each row of documents as packed (begin, end) pairs of long."""
    lists = _by_row(places).agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for places_ in b.column(2):
                p = np.sort(places_.values.to_numpy())
                lo, hi = _start(p), np.maximum.accumulate(_start(p) + _span(p) + LENGTH)
                new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                last = np.concatenate((new[1:] - 1, [len(lo) - 1]))
                packed.append(np.stack((lo[new], hi[last]), axis=1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["doc_id", "tag", "runs"])

    return lists.select("doc_id", "tag", "places").mapInArrow(run, "doc_id long, tag long, runs binary")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, tag, runs of docs (doc_id, tag, text)."""
    small_batches(docs.sparkSession)
    with temporary(docs.sparkSession):
        repeats, firsts = _across(materialize(_compare(_bucket(docs)), "suffixes"))
        more, _ = _across(materialize(_compare(_spelled(docs, firsts)), "spelled"))
        return materialize(_runs(repeats.unionByName(more)), "runs", keep=True)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text without the runs, as bytes)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    runs = repeated_runs(rows)
    n, size = runs.agg(F.count("*"), F.coalesce(F.sum(F.length("runs")), F.lit(0))).first()
    both = rows.alias("d").join(if_light(runs, size + 48 * n, BROADCAST_BYTES).alias("p"), F.expr(SAME_ROW), "left").select("d.doc_id", "d.tag", "d.text", "p.runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _layout(b.column(2))
            raw, out = data.tobytes(), []
            for i, packed in enumerate(b.column(3).to_pylist()):
                text, spans, kept, at = raw[ends[i] : ends[i + 1]], 0, [], 0
                for lo, hi in np.frombuffer(packed or b"", "<i8").reshape(-1, 2).tolist():
                    kept.append(text[at:lo])
                    at, spans = hi, spans + 1
                whole = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(whole), spans, hashlib.sha256(whole).hexdigest(), whole))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
