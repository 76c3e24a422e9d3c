"""Every opN query on the smallest tables, each column of its contract against a plain version."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tickloom.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name: str) -> dict:
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


def test_op1(spark, documents):
    got = rows(spark, "op1_rake_mixture")
    assert got.keys() == documents.keys()
    assert all(got[i]["tokens"] == len(brute.WORD.findall(r["text"] or "")) and (got[i]["source"], got[i]["lang"]) == (r["source"], r["lang"]) for i, r in documents.items())
    assert all(0 <= r["probability"] <= 1 for r in got.values()) and any(r["sampled"] for r in got.values())


def test_op2(spark, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["op2_simhash_decontamination"](spark, SF).collect()}
    grams = {i: {t[k : k + 5] for t in [brute.item_words(x)] for k in range(len(t) - 4)} for i, x in items.items()}
    want = {}
    for d, r in documents.items():
        words = brute.item_words(r["text"] or "")
        own = {words[k : k + 5] for k in range(len(words) - 4)}
        for i, x in items.items():
            if own & grams[i] and (s := brute.item_similarity(r["text"], x)) >= 0.8:
                want[d, i] = s
    assert got.keys() == want.keys() and got
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_op3(spark, documents):
    got = rows(spark, "op3_weak_supervision_pii")
    assert got.keys() == documents.keys()
    for i, r in documents.items():
        want = brute.personal_data(r["text"] or "")
        kinds = Counter(x.split(":")[0] for x in want)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds[k] for k in ("email", "ip", "card", "phone")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}


def test_op4(spark, documents):
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in rows(spark, "op4_suffix_dedup").items()}
    assert got == brute.without_repeats([(i, r["text"] or "") for i, r in documents.items()])


def test_op5(spark):
    got = [tuple(r) for r in QUERIES["op5_warc_transactions"](spark, SF).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
        want = con.execute(SQL["op5_warc_transactions"]).fetchall()
    assert sorted(got) == sorted(want) and got


def test_op6(spark, documents):
    got = rows(spark, "op6_mcd_outliers")
    assert got.keys() == documents.keys()
    for i, r in documents.items():
        text = r["text"] or ""
        words = brute.WORD.findall(text)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        covered = {k + j for k, g in enumerate(grams) if g in often for j in range(5)}
        lines = [x for x in text.split("\n") if brute.WORD.search(x)]
        base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (base and got[i]["kept"]) and (got[i]["distance2"] is None) == base
    assert sum(r["kept"] for r in got.values()) > 0.8 * sum(not r["base_failed"] for r in got.values())


def test_op7(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0
    got = rows(spark, "op7_orc_token_output")
    for i in sorted(documents):
        ids = [*tokenizer.encode(documents[i]["text"] or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8(spark, documents):
    got = rows(spark, "op8_ecoc_language_id")
    known = {r["lang"] for r in documents.values()} - {None}
    for i, r in documents.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["lang_pred"] in known | {"und"}
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    held = [(got[i]["lang_pred"], r["lang"]) for i, r in documents.items() if got[i]["held_out"] and r["lang"] and got[i]["lang_pred"] != "und"]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_op9(spark, documents):
    got = rows(spark, "op9_hypergeometric_sharding")
    assert got.keys() == documents.keys()
    for i, r in documents.items():
        raw = (r["text"] or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    slots = {s: sorted(r["slot"] for r in got.values() if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op10(spark, documents):
    got = rows(spark, "op10_simhash_near_duplicates")
    prints = [(i, brute.fingerprint(r["text"] or "")) for i, r in documents.items()]
    comp = brute.classes(prints)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", comp[i]) for i, f in prints}
