"""Ranked search by the K2-treap against scoring every document."""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import oracle, rows  # noqa: E402

from tickloom.llm import treap  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs: list[tuple], items: list[tuple]) -> dict:
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, x) for i, x in held if x]
    n, length = len(held), sum(len(x) for _, x in held)
    df = Counter(t for _, x in held for t in set(x))
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, []).extend(plain_terms(t))
    out = {}
    for item, words in asked.items():
        scored = []
        for i, x in held:
            tf, m = Counter(x), 100 - 25 + (25 * len(x) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words if tf[t])
            if s > 0:
                scored.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:20], 1):
            out[item, rank] = (i, -s)
    return out


def corpus(seed: int = 4) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Été", "ÀB", "naïve", "日本", "x9", "K"]
    text = lambda n: rng.choice(" ,.-\n\x00|").join(words[min(int(rng.expovariate(0.02)), 305)] for _ in range(n))
    docs = [(i, text(rng.randint(1, 120))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(7, docs[7][1]), (7, "w0 w1"), (None, docs[7][1]), (None, "w3"), (500, None), (501, ""), (502, " .;\n"), (503, text(20000)), ((1 << 63) - 1, docs[7][1]), (-4, docs[9][1])]
    items = [(i, text(rng.randint(1, 40))) for i in range(25)] + [(30, docs[7][1]), (31, None), (32, "..."), (33, "unheard of"), (34, "w1 W1 w1"), (34, "w2"), (35, text(3000)), (None, "w5 w6"), (36, "Été日本 naïve ÀB àb")]
    return docs, items


@pytest.mark.parametrize("chunk", [treap.ITEM_BYTES, 400])
def test_equals_scoring_every_document(spark, monkeypatch, chunk):
    docs, items = corpus()
    monkeypatch.setattr(treap, "ITEM_BYTES", chunk if chunk > 400 else 9000)
    rng = random.Random(1)
    rng.shuffle(docs)
    got = treap.search(
        spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, item_id string").repartition(3),
        spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int"),
    ).collect()
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got} == plain(docs, items)
    assert len(got) == len({(r["item_id"], r["rank"]) for r in got}) > 400


@pytest.mark.parametrize("seed", range(6))
def test_grids_one_after_the_other(seed):
    """Random impacts in several grids, with many ties: descents that carry the best so far equal a full sort."""
    rng = np.random.default_rng(seed)
    items = [(rng.choice(40, k, replace=False).tolist(), rng.integers(1, 4, k).tolist()) for k in (1, 3, 12, 30)]
    rows_, weights = treap._padded(items)
    best, want = treap.Best(len(items)), [[] for _ in items]
    for docs in (1, 77, 300):
        ids = np.sort(rng.integers(0, 200, docs))
        full = rng.integers(0, 3, (40, docs)) * rng.integers(0, 2, (40, docs))
        r, c = np.nonzero(full)
        treap.descend(treap.Treap(r, c, full[r, c]), ids, np.zeros(docs, bool), rows_, weights, 0, best)
        for k, (own, w) in enumerate(items):
            want[k] += [(-int(s), int(i)) for s, i in zip((full[own] * np.array(w)[:, None]).sum(0), ids) if s > 0]
    for k in range(len(items)):
        assert [(-s, i) for s, i in zip(best.score[k].tolist(), best.id[k].tolist()) if s] == sorted(want[k])[: treap.TOP]


def test_paths_reach_every_cell_and_no_other():
    rng = np.random.default_rng(2)
    r, c = np.unique(rng.integers(0, 90, (500, 2)), axis=0).T
    x = rng.integers(1, 1000, len(r))
    t = treap.Treap(r, c, x)
    full = np.zeros((90, 90), np.int64)
    full[r, c] = x
    i, j = (a.ravel() for a in np.meshgrid(np.arange(90), np.arange(90), indexing="ij"))
    node = np.zeros(len(i), np.int64)
    for level in range(t.height - 1, -1, -1):
        before = t.best[node]
        node = t.child(node, 2 * ((i << t.spread) >> level & 1) + (j >> level & 1))
        assert (t.best[node] <= before).all()
    assert (t.best[node] == full[i, j]).all() and t.best[0] == x.max()
    assert t.kids.dtype == np.uint8 and treap.Treap(r[:0], c[:0], x[:0]).best.tolist() == [0]  # no root but the empty node


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert treap.search(none, item).count() == 0
    assert treap.search(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), item.limit(0)).count() == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got, want = treap.op11_k2_treap_search(spark, sf).toPandas(), oracle(sf, treap.OP11_SQL)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got) == 800
