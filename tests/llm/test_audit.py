"""Filter interactions by the retraction stream against a plain count of every order."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.llm import audit
from tickloom.llm.common import fresh_path

SCHEMA = "doc_id long, text string, source string, part int, MASK string"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(docs: list[tuple], labels: list[tuple]) -> dict:
    judged = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        for f, x in zip(
            "ABCDE",
            (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)),
                i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
            ),
        ):
            if x:
                fails.add(f)
        flag = lambda k: i is not None and any(r[0] == i and r[k] == 1 for r in labels)
        judged.append((source or "", fails, flag(1), flag(2)))
    out, shapley = {}, {}
    for part in {x[0] for x in judged}:
        own = [x for x in judged if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in own if f in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: tuple(v) + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(5)
    long_ = [" ".join(f"w{rng.randint(0, n)}" for _ in range(210)) for n in (9, 60, 9999, 9999)]
    texts = [None, "", " \n", "word", "WORD x", "a # b", *long_, long_[2] + " & ", long_[3] + " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, long_[0] + "%", "é" * 30000 + " 🙂"]
    ids = [None, None, *range(58), 3, 3, 7, 2**62, 2**62 + 1, -5]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for i in ids]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), 4, 4, None, 999]]
    return docs, labels


@pytest.mark.parametrize("files, a_batch", [(1, 1), (7, 1), (7, 3)])
def test_every_order_of_arrival(spark, files, a_batch):
    docs, labels = corpus()
    path = fresh_path(spark, "documents")
    rows = sorted(docs, key=lambda r: -(r[0] or 0))  # the smallest ids come last, so earlier ones are retracted
    for k in range(files):
        spark.createDataFrame([(*r, 1, "x") for r in rows[k::files]], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = audit.interactions(audit.masks_by_part(spark, path, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), a_batch)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIGURES) for r in got} == plain(docs, labels)


def test_later_smaller_ids_retract():
    row = lambda i, part="p": (b"k", i, part, 1, 0, 0, 1)
    held = audit.STATE.empty_table().to_pandas()
    total: dict = {}
    for ids in ([9, 9], [5], [7], [2], [2, 1]):
        held, changes = audit.retract(held, pd.DataFrame([row(i) for i in ids], columns=audit.STATE.names))
        for r in changes.itertuples():
            total[r.mask] = total.get(r.mask, 0) + r.n
    assert total == {1: 1, 1 | audit.SAME: 6} and held.doc_id.tolist() == [1]
    assert audit._unpacked(audit._packed(held)).values.tolist() == held.values.tolist()


def test_empty_table(spark):
    path = fresh_path(spark, "documents")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert audit.interactions(audit.masks_by_part(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_equals_sql(spark):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parents[1]))
    from compare import oracle, rows

    sf = "/root/testdata/sf0.001"
    got = audit.op12_retraction_stream_audit(spark, sf).toPandas()
    want = oracle(sf, audit.OP12_SQL)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got) == 12000


def test_counters_are_additive(spark):
    counts = [("p", m, 2 + m % 3, m % 2, 1) for m in range(32)]
    got = audit.interactions(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long"))
    whole = sum(r[2] for r in counts)
    ends = got.filter("step = 5").collect()
    assert len(ends) == 120 and {r["kept"] for r in ends} == {2}
    assert {r["s"] for r in got.groupBy("filter_order").agg(F.sum("removed").alias("s")).collect()} == {whole - 2}
