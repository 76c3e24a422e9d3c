"""Secrets in texts: fixed patterns, and random strings that a tokenizer's vocabulary compresses badly.

A vocabulary learnt from prose and code spells ordinary words with few tokens: four characters or more a token in
English, two to three in invented words. Random keys get less than two. So each run of key characters that no fixed
pattern covers is encoded, and one of few characters a token is a secret (kind `random`), unless it is a known kind of
digest or identifier: hexadecimal digests and ids of standard lengths, UUIDs, numbers and dates, subresource
integrity values, and whatever the words before it call a digest, commit, checksum or the like. Of a run with slashes or
dots the ordinary words at both ends are left out first, and where the rest passes, its parts are tried one by one, so
that a key in a path shows.

One pass over the documents, without a shuffle; a task holds one batch of texts. Texts without a long run and without a
keyword are told apart on their bytes and never meet a pattern.

Defined results: a null text is empty and has no spans; spans are code points with the end exclusive; a random string
that overlaps a span of a fixed pattern is not added; a null doc_id is passed through, repeated rows are each answered;
a very long text is searched whole in linear time, and a very long run is encoded in pieces of PIECE characters; spans
at one place come in the order of KINDS; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import small_batches, table

KINDS = ("assign", "access", "hex", "random")
#: Keywords' letters match in either case, ASCII letters only. A match that is too short is dropped, and the search
#: goes on behind it, so lengths are looked at after matching.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Runs that may be keys, with the padding of base64.
RUN = re.compile(r"[A-Za-z0-9+/_.~-]{16,}={0,2}")
PARTS = re.compile(r"[^/.]+")
RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.~-="
LEAST_RUN, PIECE, BEFORE = 16, 1024, 40
#: Most characters a token of a random string: with letters of both cases (behind a capital) or digits among letters, and of letters
#: of one case, where invented words come nearer and PLAIN_RUN letters are needed. Of 2,000 random strings of 32 hexadecimal
#: digits 99 % stay below 2.01, of base64 below 1.55.
MIXED, PLAIN, PLAIN_RUN = 2.0, 1.6, 24
#: Digests and identifiers (fixed forms): UUID; hexadecimal of the usual lengths; numbers, dates, versions; integrity values.
KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|(?:0x)?(?:[0-9a-f]{128}|[0-9a-f]{96}|[0-9a-f]{64}|[0-9a-f]{56}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9a-f]{24}|[0-9a-f]{16})"
    r"|(?:0x)?(?:[0-9A-F]{128}|[0-9A-F]{96}|[0-9A-F]{64}|[0-9A-F]{56}|[0-9A-F]{40}|[0-9A-F]{32}|[0-9A-F]{24}|[0-9A-F]{16})"
    r"|v?[0-9][0-9TZ._/+-]*"
    r"|sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}"
)
CALLED = re.compile(r"(?:md5|sha-?[0-9]{0,3}|digest|checksum|integrity|etag|fingerprint|commit|revision|rev|uuid|guid|doi|isbn)(?:sum)?[\"']?\s*[:=(]?\s*[\"']?$", re.I | re.A)
FOUND_SCHEMA = "doc_id long, spans array<struct<start:int,rank:int,end:int,ratio:double>>"
_vocabularies: dict = {}


def vocabulary(path: str, pattern: str):
    """The tiktoken encoding of a file of ranks, once a worker process."""
    if path not in _vocabularies:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _vocabularies[path] = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, rank, end of the fixed patterns' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def ratio(run: str, encoding) -> float:
    """Characters a token."""
    return len(run) / sum(len(encoding.encode_ordinary(run[a : a + PIECE])) for a in range(0, len(run), PIECE))


def _exposed(run: str, encoding) -> float | None:
    """The ratio, if it tells that run is random."""
    if len(run) < LEAST_RUN or KNOWN.fullmatch(run):
        return None
    mixed = sum(bool(re.search(c, run[1:])) for c in ("[a-z]", "[A-Z]", "[0-9]")) > 1
    if not mixed and len(run) < PLAIN_RUN:
        return None
    few = ratio(run, encoding)
    return few if few <= (MIXED if mixed else PLAIN) else None


def random_spans(text: str, covered: list[tuple[int, int, int]], encoding) -> list[tuple[int, int, int, float]]:
    """start, rank, end, ratio of random strings that meet no covered span (in order of start)."""
    out, apart, reach = [], [], 0
    for a, _, z in covered:  # the covered spans united
        if apart and a <= reach:
            reach = max(reach, z)
            apart[-1] = (apart[-1][0], reach)
        else:
            apart.append((a, z))
            reach = z
    starts = np.array([a for a, _ in apart], np.int64)
    for m in RUN.finditer(text):
        at = m.start() + len(m[0]) - len(m[0].lstrip("-._~/"))
        run = m[0].strip("-._~/")
        if KNOWN.fullmatch(run) or CALLED.search(text[max(0, at - BEFORE) : at]):
            continue
        parts = [(p.start(), p.end()) for p in PARTS.finditer(run)]
        odd = [k for k, (a, z) in enumerate(parts) if z - a >= 4 and ratio(run[a:z], encoding) <= MIXED]
        if odd:
            first, last = parts[odd[0]][0], parts[odd[-1]][1]
            tried = [(first, last, _exposed(run[first:last], encoding))]
            if tried[0][2] is None:
                tried = [(a, z, _exposed(run[a:z], encoding)) for a, z in (parts[k] for k in odd)]
            for a, z, few in tried:
                k = int(np.searchsorted(starts, at + z)) - 1
                if few is not None and not (k >= 0 and apart[k][1] > at + a):
                    out.append((at + a, 3, at + z, few))
    return out


def _worth_a_look(raw: bytes, inside: np.ndarray) -> bool:
    """Whether a text can hold a span: it has a long run of key characters, or a keyword."""
    apart = np.flatnonzero(~inside[np.frombuffer(raw, np.uint8)])
    if np.diff(apart, prepend=-1, append=len(raw)).max() > LEAST_RUN:
        return True
    low = raw.lower()
    return any(k in low for k in KEYWORDS)


def find_secrets(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and spans (start, rank in KINDS, end, ratio of random ones) of docs (doc_id, text).

    ranks and pattern: the file and the splitting pattern of a tiktoken vocabulary, which every worker reads.
    """
    small_batches(docs.sparkSession)
    span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, inside = vocabulary(ranks, pattern), np.zeros(256, bool)
        inside[list(RUN_BYTES)] = True
        for b in batches:
            found = []
            for value in b.column(1):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                if not _worth_a_look(raw, inside):
                    found.append([])
                    continue
                text = raw.decode()
                own = base_spans(text)
                spans = sorted([(*s, None) for s in own] + random_spans(text, own, encoding), key=lambda s: s[:3])
                found.append([dict(zip(("start", "rank", "end", "ratio"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(search, FOUND_SCHEMA)


def op13_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    found = find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.filter("spans", lambda x: x["rank"] < 3)), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.array_min(F.transform("spans", lambda x: x["ratio"])).alias("least_ratio"),
    )
