"""Near-copies at 0.8 against all pairs, on edited, short, empty and repeated texts."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tickloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, text_hash long, root string"


def texts() -> list[str | None]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    out: list[str | None] = [None, "", " \n", "a b", "A  b", "a b c", "x " * 50, "x " * 90]
    for n in (12, 60, 150, 400, 3_000):
        base = [word() for _ in range(n)]
        for edits in (0, 1, 2, n // 90, n // 60, n // 45, n // 30, n // 10):
            copy = list(base)
            for i in rng.sample(range(n), edits):
                copy[i] = word()
            out.append(" ".join(copy))
        out.append(" ".join(base[: n * 9 // 10]))
        out.append(" ".join(base).upper())
    passage = " ".join(word() for _ in range(60))
    out += [" ".join(word() for _ in range(80)) + " " + passage for _ in range(5)]
    return out


def plain(items: list[str | None]) -> dict[int, int]:
    """Least position reachable over pairs of similar texts."""
    sets = [set(near_copies.shingles(t).tolist()) for t in items]
    comp = list(range(len(items)))
    for i, j in itertools.combinations(comp[:], 2):
        both = len(sets[i] & sets[j])
        if 9 * both >= 4 * (len(sets[i]) + len(sets[j])) and comp[i] != comp[j]:
            low, high = sorted((comp[i], comp[j]))
            comp = [low if c == high else c for c in comp]
    return dict(enumerate(comp))


@pytest.mark.parametrize("chunk", [1_024, 3])
def test_one_of_each_class_stays(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    items = texts()
    rows = [(i, t, 1, "r") for i, t in enumerate(items)]
    docs = spark.createDataFrame([*rows, *rows[:20]], SCHEMA).repartition(3)
    kept = near_copies.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain(items).values()))


def test_forest_joins_what_all_pairs_join():
    items = texts()
    sets = [near_copies.shingles(t).view(np.int64) for t in items]
    comp = list(range(len(items)))
    for u, v in near_copies.forest(comp[:], comp[:], sets):
        low, high = sorted((comp[u], comp[v]))
        comp = [low if c == high else c for c in comp]
    words = [i for i, h in enumerate(sets) if len(h)]
    assert [comp[i] for i in words] == [plain(items)[i] for i in words]


def families(count: int = 60) -> list[str]:
    """Families of edited copies with similarities on both sides of 0.8: several hundred pairs at or above it."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    out = []
    for f in range(count):
        base = [word() for _ in range(rng.choice((20, 45, 90, 200, 500)))]
        for _ in range(10):
            copy = list(base)
            for i in rng.sample(range(len(base)), rng.randint(0, max(1, len(base) // 45))):
                copy[i] = word()
            out.append(" ".join(copy))
    return list(dict.fromkeys(out))


def test_no_similar_pair_of_many_families_is_lost(spark):
    items = families()
    sets = [set(near_copies.shingles(t).tolist()) for t in items]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(items)), 2) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    assert len(pairs) > 500
    docs = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string").repartition(3)
    found = near_copies.classes(docs).join(docs.selectExpr("doc_id", "xxhash64(text) AS text_hash"), "text_hash").collect()
    root = {r["doc_id"]: r["root"] for r in found}
    caught = sum(i in root and root[i] == root.get(j) for i, j in pairs)
    assert caught >= 0.99 * len(pairs)
    comp = plain(items)
    assert all(comp[i] == comp[j] for (i, a), (j, b) in itertools.combinations(root.items(), 2) if a == b)


def test_empty_table(spark):
    assert near_copies.one_of_each_group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_some_group_of_shingles_is_untouched():
    rng = np.random.default_rng(5)
    for n in (10, 40, 90, 300, 5_000):
        for _ in range(50):
            h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = rng.choice(n, int(n * (1 - near_copies.SIMILARITY)), replace=False)  # a subset at exactly 0.8
            assert set(near_copies.group_keys(h)) & set(near_copies.group_keys(np.delete(h, gone)))


def test_similar_short_texts_share_a_key():
    rng = np.random.default_rng(6)
    for n in (*range(4, 21), 26, 32, 33, 40):
        sizes = [(m, both) for m in range(n, n * 5 // 4 + 1) for both in range(1, n + 1) if 9 * both >= 4 * (n + m)]
        for k in range(1_000):
            m, both = sizes[k % len(sizes)]
            h = rng.permutation(np.unique(rng.integers(0, 1 << 63, n + m + 5, dtype=np.uint64)))
            a, b = np.sort(h[:n]), np.sort(h[n - both : n - both + m])
            assert set(near_copies.group_keys(a).tolist()) & set(near_copies.group_keys(b).tolist()), (n, m, both)


def test_rows_without_an_id_are_copies_too(spark):
    rows = [(5, "a", 1), (None, "a", 1), (None, "b", 1), (None, "c", 2), (None, "c", 2), (None, "d", 2), (7, "e", 3), (None, "f", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long")
    found = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "root")
    least = found.filter("root = 2").agg({"text_hash": "min"}).first()[0]
    kept = simhash.first_of_each(docs, found).selectExpr("doc_id", "root", "xxhash64(text) AS h").collect()
    assert sorted((r["root"], r["doc_id"] or 0) for r in kept) == [(1, 5), (2, 0), (3, 7), (4, 0)]
    assert [r["h"] for r in kept if r["root"] == 2] == [least]


def test_exact_keys_miss_nothing():
    """Sets of up to 900 shingles at a similarity of 0.8 or a little more always share a key; a little less is not promised."""
    rng = np.random.default_rng(16)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        both = int(np.ceil(0.8 * n))
        pool = np.unique(rng.integers(0, 1 << 64, 2 * n + 4, dtype=np.uint64))
        rng.shuffle(pool)
        k = int(rng.integers(0, n - both + 1))
        a = np.sort(pool[:n])
        b = np.sort(np.concatenate((pool[: n - k], pool[n : n + max(0, int(np.floor((n - k) / 0.8 + 1e-9)) - n)])))
        same = len(np.intersect1d(a, b))
        if same / (len(a) + len(b) - same) >= 0.8:
            assert len(np.intersect1d(near_copies.group_keys(a, True), near_copies.group_keys(b, True)))


def test_exact_classes_of_long_texts(spark):
    rng = random.Random(17)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(700)]
    texts = [base, base[:640] + [f"x{k}" for k in range(60)], [f"y{k}" for k in range(60)] + base[60:], [f"z{k}" for k in range(700)], base[:350] + [f"v{k}" for k in range(350)]]
    docs = spark.createDataFrame([(k, " ".join(t), "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in near_copies.one_of_each_group(docs, exact=True).collect()) == [0, 3, 4]
