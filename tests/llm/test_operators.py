"""Every corpus operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tickloom.llm import decontamination, language, mixing, pii, quality, sharding, simhash, suffixes, token_output, warc  # noqa: E402
from tickloom.llm.common import fresh_path  # noqa: E402
from tickloom.llm.graph import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, tokens int, fp long"
SYLLABLES = {"en": "the ing tion er on and st wh".split(), "fr": "eau ou é que ment aux le oi".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(3)
    texts = [(sentence(rng, lang, rng.randint(8, 80)), lang) for lang in ("en", "fr") for _ in range(40)]
    base = texts[0][0]
    passage = sentence(rng, "en", 40)
    texts += [(None, "en"), ("", "fr"), ("  \n\t ", None), ("123 456 !!", None), ("🙂 é\x1c a\r\n\nb", "fr"), (base, "en"), (base, "en"), (base + " end", "en")]
    texts += [(sentence(rng, "en", 20) + " " + passage + " " + sentence(rng, "en", 20), "en") for _ in range(5)]
    texts += [("a" * 5000, "en"), ("ab" * 700, "en"), (sentence(rng, "en", 4000), "en"), ("Mail joe.x@mail.example.com or +1 (389) 555-5010, 8.196.197.208; 4703443633947811. 999.1.1.1", "en")]
    rows = [(i, t, lang, f"src{i % 3}" if i % 7 else None, len(t or ""), "x", 1, 2) for i, (t, lang) in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts() -> list[tuple[int, str]]:
    return [(r[0], r[1] or "") for r in corpus()]


def test_personal_data_matches_plain_version(docs, empty):
    got = {r["doc_id"]: [f"{pii.KINDS[s['rank']]}:{s['start']}:{s['end']}" for s in r["base"]] for r in pii.find_personal_data(docs).collect()}
    assert got == {i: brute.personal_data(t) for i, t in texts()}
    assert len(got[max(got)]) == 4
    assert pii.find_personal_data(empty).count() == 0


@pytest.mark.parametrize("text", ["x" * 30000, "1" * 30000, "1-" * 9000, "1.2." * 5000, "a@b.c-d._x@y.z" * 40, "+1 " * 500, "12 " * 1500, "+1(((", "1.2.3.4.5.6.7.8 a@b @c.d 0000000000000000"])
def test_personal_data_on_hard_texts(spark, text):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.find_personal_data(rows).first()
    assert [f"{pii.KINDS[s['rank']]}:{s['start']}:{s['end']}" for s in r["base"]] == brute.personal_data(text)


def test_parts_of_addresses(spark):
    texts_ = ["10.0.0.1", "0.0.0.0", "00.1.2.3", "256.1.1.1", "192.168.0.5", "255.255.255.255", "1.2.3.0256", "000.000.000.000", "1.2.3.256", "0999.1.1.1", "1.2.3"]
    rows = spark.createDataFrame([(i, f"at {t} now") for i, t in enumerate(texts_)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["base"]] for r in pii.find_personal_data(rows).collect()}
    assert got == {i: ([(3, 3 + len(t))] if brute.personal_data(f"at {t} now") else []) for i, t in enumerate(texts_)}
    assert sorted(i for i, x in got.items() if x) == [0, 1, 2, 4, 5, 7]


def test_wider_spans_are_added_where_labelers_agree(spark):
    plain = [(i, f"host address: 93.{i}.8.4 and card: {('4' + str(i).zfill(3) + '0000' * 3)[:12]}0000 or so") for i in range(120)]
    odd = [(900, "host address: 93[.]24[.]8[.]4 is up"), (901, "pay by card: 4111.1111.1111.1111 today"), (902, "part 9999/9999/9999/9999 of 12"), (903, None)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame([*plain, *odd, *odd], "doc_id long, text string")).collect()}
    spans = lambda i: [(pii.KINDS[s["rank"]], s["start"], s["end"]) for s in got[i]["spans"]]
    assert not any(got[i]["base"] for i in (900, 901, 902, 903))
    assert spans(900) == [("ip", 14, 29)] and spans(901) == [("card", 13, 32)] and spans(902) == spans(903) == []


def test_personal_data_adds_spelled_out_address(spark):
    plain = [(i, f"write to user{i}@mail.example.com now") for i in range(50)]
    rows = spark.createDataFrame([*plain, (99, "write to joe [at] mail [dot] example [dot] com now")], "doc_id long, text string")
    r = next(x for x in pii.find_personal_data(rows).collect() if x["doc_id"] == 99)
    assert not r["base"] and [(s["rank"], s["start"]) for s in r["spans"]] == [(0, 9)]


def test_repeats_match_plain_version(docs, empty):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs).collect()}
    assert got == brute.without_repeats(texts())
    assert sum(x[1] for x in got.values()) > 1000
    assert suffixes.remove_repeats(empty).count() == 0


def test_repeats_across_segments_and_chunks(docs, monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[1500:2500] = data[200:1200]
    whole = [np.concatenate(x) for x in zip(*suffixes.thinned(data, np.array([0, 3000])))]
    covered = np.zeros(3000, int)
    for lo, span in zip(whole[1], whole[2]):
        covered[lo : lo + span + 1] += 1
    assert (covered[:2901] == 1).all() and not covered[2901:].any()


def test_repeated_rows_are_not_earlier_than_each_other(spark):
    rng = random.Random(9)
    a, b = sentence(rng, "en", 60), sentence(rng, "fr", 60)
    rows = spark.createDataFrame([(1, a), (1, a), (2, b), (None, b)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.remove_repeats(rows).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, len(b.encode()))]


def test_rows_without_an_id_are_told_apart(spark):
    rng = random.Random(10)
    a, b = sentence(rng, "en", 60), sentence(rng, "fr", 60)
    rows = spark.createDataFrame([(None, a + "1"), (None, b + "2"), (7, a + b), (8, "short"), (9, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.remove_repeats(rows).collect()}
    size = lambda t: len(t.encode())
    assert got == {(None, size(a) + 1): 0, (None, size(b) + 1): 0, (7, size(a) + size(b)): size(a) + size(b), (8, 5): 0, (9, 0): 0}


def test_fingerprints_and_classes(docs, empty):
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [(i, brute.fingerprint(t)) for i, t in texts()]
    comp = brute.classes(fps)
    assert got == {i: (f, comp[i]) for i, f in fps}
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_dense_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(100)}
    center = rng.getrandbits(64)
    for _ in range(200):
        fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = components(simhash.links(rows, len(fps))).collect()
    comp = brute.classes([(signed(f), f) for f in fps])
    want = {}
    for f, c in comp.items():
        want.setdefault(c, set()).add(f)
    mine = {}
    for r in got:
        mine.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, mine.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("n", [10, 10**6, 10**10])
def test_thresholds_cover_the_radius(n):
    counts = np.full((64, 64), n / 4)
    np.fill_diagonal(counts, n / 2)
    masks = simhash.plan_probes(counts, n, np.array([], dtype=np.uint64))
    rng = random.Random(n)
    for _ in range(200):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flip & m == 0 for m in masks)


def test_near_dedup_keeps_one_of_each(docs):
    kept = simhash.one_of_each_group(docs.unionByName(docs.filter("doc_id < 5")))
    comp = brute.classes([(i, brute.fingerprint(t)) for i, t in texts()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values()))
    assert kept.columns == docs.columns


def test_decontamination_matches_plain_version(spark, docs, empty):
    rng = random.Random(8)
    held = [r[1] for r in corpus() if r[1] and len(r[1].split()) > 70]
    items = [(1, " ".join(held[0].split()[20:50])), (2, " ".join(held[1].upper().split()[5:30]) + " other"), (3, sentence(rng, "en", 30)), (4, "the ing"), (5, None), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(docs, bench).collect()}
    want = {(d, i): s for d, t in texts() for i, x in items[:3] if (s := brute.item_similarity(t, x)) >= 0.8}
    assert got.keys() == want.keys() and len(got) >= 2
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    kept = decontamination.without_contaminated(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in corpus()} - {d for d, _ in want} and kept.columns == docs.columns
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_language_held_out_accuracy(docs, empty):
    got = {r["doc_id"]: r["_tl_lang"] for r in language.identify(docs).select("doc_id", "_tl_lang").collect()}
    for i, t, lang, *_ in corpus():
        if not any(c.isalpha() for c in t or ""):
            assert got[i]["lang"] == "und" and got[i]["score"] == 0
    held = [(got[i]["lang"], lang) for i, t, lang, *_ in corpus()[:80] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert language.identify(empty).count() == 0
    assert {r["l"] for r in language.identify(docs.withColumn("lang", docs.lang.cast("string").substr(99, 1))).selectExpr("_tl_lang.lang l").collect()} <= {"", "und"}


def test_numerals_are_no_letters(spark, docs):
    model = language.train(docs)
    rows = spark.createDataFrame([("½ ² Ⅷ ① 12",), ("",), (None,), ("ª",), ("x" * 200_000,)], "text string")
    got = [tuple(r) for r in rows.select(language.predict(F.col("text"), model).alias("p")).select("p.lang", "p.score").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and all(lang != "und" and 0 < score <= 1 for lang, score in got[3:])


@pytest.mark.parametrize("k", [1, 2, 4, 9])
def test_codewords_differ(k):
    m = language.codewords(k)
    assert len({tuple(r) for r in m}) == k


def test_quality_statistics():
    t = "a b c d e f\na b c d e f\n\nx #$"
    assert quality.statistics(t) == (14, 15, 2, 3, 1, 12)
    assert quality.statistics(None) == (0, 0, 0, 0, 0, 0)


def test_least_determinant_is_found(spark):
    """Against the least determinant over every subset."""
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(9, quality.DIMS)), 6 + 0.1 * rng.normal(size=(3, quality.DIMS))))
    floor, h = np.full(quality.DIMS, 0.01), 9
    best, mean = min((quality._fit(*quality._moments(x[list(c)]), floor, len(x))[2], x[list(c)].mean(0).tolist()) for c in itertools.combinations(range(len(x)), h))
    assert abs(quality.starts_of(x, floor, len(x), 1)[1][2] - best) < 1e-9
    rows = [("a", "l", v.tolist(), [0.1] * quality.DIMS) for v in x]
    found = quality.mcd(spark.createDataFrame(rows, "g string, l string, x array<double>, least array<double>")).first()
    assert abs(found["logdet"] - best) < 1e-9 and np.allclose(found["mu"], mean)


def test_small_groups_are_judged_by_their_language(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, "en", rng.randint(30, 90)), "en", f"s{i}", 0, "x", 1, 2) for i in range(120)]
    rows += [(900, "&&& ".join(sentence(rng, "en", 60).split()), "en", "own", 0, "x", 1, 2), (901, "&&& ".join(sentence(rng, "en", 60).split()), "xx", "own", 0, "x", 1, 2)]
    rows += rows[-2:]
    got = [(r["doc_id"], r["kept"], r["distance2"]) for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert {k for i, k, _ in got if i >= 900} == {False} and len({x for x in got if x[0] >= 900}) == 2
    assert sum(k for i, k, _ in got if i < 900) >= 117


def test_quality_rejects_far_documents(spark, empty):
    rng = random.Random(5)
    rows = [(i, sentence(rng, "en", rng.randint(30, 90)), "en", f"s{i % 2}", 0, "x", 1, 2) for i in range(500)]
    rows += [(900, "&&& ".join(sentence(rng, "en", 60).split()), "en", "s0", 0, "x", 1, 2), (901, None, None, None, 0, "x", 1, 2)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 502 and not got[900]["kept"] and got[901]["base_failed"] and not got[901]["kept"]
    assert sum(got[i]["kept"] for i in range(500)) >= 495
    assert quality.judge(empty).count() == 0


def test_quality_rejects_duplicated_lines(spark):
    rng = random.Random(8)
    line = lambda: sentence(rng, "en", rng.randint(8, 14))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(4, 30))), "en", "s0", 0, "x", 1, 2) for i in range(400)]
    rows += [(i, "\n".join([*(line() for _ in range(12)), "read on", line(), "read on"]), "en", "s0", 0, "x", 1, 2) for i in range(400, 410)]
    rows += [(900 + k, "\n".join(x for _ in range(k) for x in (line(), "read on")), "en", "s0", 0, "x", 1, 2) for k in (8, 12, 25)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[900 + k]["base_failed"] or got[900 + k]["kept"] for k in (8, 12, 25))
    assert all(got[i]["kept"] for i in range(400, 410))  # one line twice is within what a document can resolve
    assert sum(got[i]["kept"] for i in range(400)) >= 396


def test_mixing_meets_the_margins(docs, empty):
    got = mixing.mix(docs)
    assert got.count() == docs.count() and mixing.mix(empty).count() == 0
    codes, t = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], np.array([10.0, 20, 30, 40])
    want = [np.array([0.5, 0.5]), np.array([0.4, 0.6])]
    f = mixing.rake(codes, t, want)
    for c, w in zip(codes, want):
        assert np.allclose(np.bincount(c, weights=t * f) / 100, w)
    assert (mixing.calibrate(codes, t, want, 0.9)[1] <= 1).all()
    words = {r["doc_id"]: r["tokens"] for r in got.collect()}
    assert words == {i: len(brute.WORD.findall(t)) for i, t in texts()}


@pytest.mark.parametrize("good, bad, sample", [(5, 7, 6), (30, 3, 20), (2_000, 9_000, 40), (10**12, 10**12, 30)])
def test_hypergeometric_law(good, bad, sample):
    rng, n = np.random.default_rng(1), 20_000
    got = np.bincount([sharding.hypergeometric(rng, good, bad, sample) for _ in range(n)], minlength=sample + 1)
    if good < 10**9:
        total = math.comb(good + bad, sample)
        want = np.array([math.comb(good, k) * math.comb(bad, sample - k) / total if k <= good and sample - k <= bad else 0.0 for k in range(sample + 1)])
    else:  # nearly binomial
        want = np.array([math.comb(sample, k) * 0.5**sample for k in range(sample + 1)])
    assert not got[want == 0].any()
    often = want * n >= 5
    chi2 = ((got - want * n)[often] ** 2 / (want * n)[often]).sum()
    assert chi2 < often.sum() + 5 * (2 * often.sum()) ** 0.5 + 5


def test_hypergeometric_of_large_populations():
    rng = np.random.default_rng(2)
    got = np.array([sharding.hypergeometric(rng, 3 * 10**11, 7 * 10**11, 10**10) for _ in range(400)], dtype=float)
    sd = (10**10 * 0.3 * 0.7 * 0.99) ** 0.5
    assert abs(got.mean() - 3 * 10**9) < 5 * sd / 20 and 0.8 < got.std() / sd < 1.2
    m = sharding.communication_matrix([10**10] * 3, [6 * 10**9] * 5, 1)
    assert (m.sum(1) == 10**10).all() and (m.sum(0) == 6 * 10**9).all()


def test_partitions_share_a_row_of_the_matrix():
    sizes = np.array([5, 0, 9, 4, 3, 8, 1])
    matrix = sharding.communication_matrix([int(sizes[i::3].sum()) for i in range(3)], [10, 10, 10], 4)
    own = np.array([sharding.own_share(matrix, sizes, p, 4) for p in range(7)])
    assert own.sum(1).tolist() == sizes.tolist() and own.sum(0).tolist() == [10, 10, 10]
    assert all((own[i::3].sum(0) == matrix[i]).all() for i in range(3))


def test_sharding_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "x", 7)] * 300 + [(None, None, 8)] * 5 + [(i, "y" * 50_000, 9) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, dice string, at long").repartition(5).withColumn("AT_", F.lit("q")).withColumn("slot", F.lit(99))
    got = sharding.shuffle_into_shards(df, 8)
    assert got.columns == ["doc_id", "dice", "at", "AT_", "shard", "slot"]
    got = got.collect()
    assert Counter((r["doc_id"], r["dice"], r["at"]) for r in got) == Counter(rows) and {r["AT_"] for r in got} == {"q"}
    slots = [(r["shard"], r["slot"]) for r in got]
    assert len(set(slots)) == len(rows) and all((s, k) in set(slots) for s in range(8) for k in range(len(rows) // 8))


def test_mixing_meets_stated_shares(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(20, 60), rng.choice(["en", "fr", None]), rng.choice("abc"), "q") for i in range(600)]
    docs = spark.createDataFrame([*rows, *rows[:9], (None, None, None, None, "q")], "doc_id long, text string, lang string, source string, source_kind string")
    stated = {"source": {"a": 0.5, "b": 0.2}, "lang": {"en": 0.4, None: 0.3}, "topic": {"x": 0.25}}
    topic = F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y")
    got = {(r["axis"], r["kind"]): (r["target"], r["expected"]) for r in mixing.margins(docs, keep=0.4, targets=stated, topic=topic).collect()}
    assert all(abs(got[a, k][0] - v) < 1e-9 for a, shares in stated.items() for k, v in shares.items())
    assert all(abs(t - e) < 1e-6 for t, e in got.values())
    mixed = mixing.mix(docs, keep=0.4, targets=stated, topic=topic)
    assert mixed.columns == [*docs.columns, "tokens", "topic", "weight", "probability", "sampled"]
    found = mixed.collect()
    kept = sum(r["tokens"] * r["probability"] for r in found)
    assert abs(sum(r["tokens"] * r["probability"] for r in found if r["source"] == "a") / kept - 0.5) < 1e-6
    fate = {}
    for r in found:
        assert fate.setdefault(r["doc_id"], r["sampled"]) == r["sampled"] and r["source_kind"] == "q"
    with pytest.warns(UserWarning, match="margins"):
        mixing.mix(docs.filter("source <> 'a'").withColumn("source", F.lit("b")), targets={"lang": {"en": 0.9, "fr": 0.1}}, keep=0.99)
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"lang": {"en": 0.9, "fr": 0.3}})


def test_sharding_is_exact(docs, empty):
    got = sharding.shuffle_into_shards(docs, 8).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in slots.values()]
    assert len(got) == len(corpus()) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shuffle_into_shards(empty, 8).count() == 0
    m = sharding.communication_matrix([5, 0, 9], [4, 4, 6], 1)
    assert m.sum(1).tolist() == [5, 0, 9] and m.sum(0).tolist() == [4, 4, 6]


def test_tokens_round_trip(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, file = public.path("byte_bpe_50k.json"), fresh_path(spark, "t")
    token_output.write_tokens(docs, path, file)
    got = {r["doc_id"]: r for r in token_output.digest(token_output.read_tokens(spark, file)).collect()}
    tok, start = Tokenizer.from_file(path), 0
    for i, t in texts():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in token_output.lookup(spark, file, [3]).collect()] == [3]
    token_output.write_tokens(empty, path, file + "-empty")
    assert token_output.digest(token_output.read_tokens(spark, file + "-empty")).count() == 0


def test_words_are_encoded_as_in_their_text():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, rng = public.path("byte_bpe_50k.json"), random.Random(1)
    marks = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "é", "1", "'s", "!", "<|endoftext|>", "\x1c", "\x85", "🙂", ". ", ",", "&&&", "²", "　"]
    many = ["".join(rng.choices(marks, k=rng.randint(0, 12))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(many, add_special_tokens=False)]
    ids, ends = token_output.encoder(path).encode(pa.array(many))
    assert [ids[a : z - 1].tolist() for a, z in zip(ends[:-1], ends[1:])] == want and not ids[ends[1:] - 1].any()


def test_warc_round_trip(spark):
    rows = [(5, "http://a/ b", "<p>é</p>"), (3, "http://a", "<p>é</p>"), (9, None, None), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\nx"), (8, "u", "WARC/1.1\r\n\r\nx"), (None, "n", "only")]
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), fresh_path(spark, "w"))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [
        ((int(m) if (m := r["metadata"]["fields"].get("page-id")) else None), r["response"]["record_type"], r["response"]["payload_bytes"], r["response"]["payload_digest"], r["metadata"]["fields"].get("refers-to-page"), r["request"] is not None)
        for r in warc.assemble(warc.read_warc(files)).collect()
    ]
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    w, e = d(rows[4][2]), d("")
    want = [(5, "revisit", 9, d("<p>é</p>"), "3", True), (3, "response", 9, d("<p>é</p>"), None, True), (9, "revisit", 0, e, "7", True), (7, "response", 0, e, None, True), (8, "response", 13, w, None, True), (8, "response", 13, w, None, True), (None, "response", 4, d("only"), None, True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    none = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), fresh_path(spark, "w"))
    assert warc.assemble(warc.read_warc(none)).count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, "/root/testdata/sf0.001")
        assert rows.columns[: len(docs.columns)] == docs.columns
        assert rows.count() <= before.count()
    assert {"shard", "slot"} <= set(rows.columns)


def test_rows_without_an_id_whose_hashes_nearly_agree(spark):
    """Two texts whose 64-bit hashes share their low 26 bits: places found in one aren't applied to the other."""
    import xxhash

    rng, seen = random.Random(11), {}
    twice, other = sentence(rng, "en", 40), sentence(rng, "fr", 130)
    low = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() & ((1 << 26) - 1)
    for k in range(30000):
        seen[low(f"{twice} | {twice} {k}")] = k
    a, b = next((f"{twice} | {twice} {seen[h]}", t) for k in range(30000) if (h := low(t := f"{other} {k}")) in seen)
    short = next((t for k in range(4000) for t in [f"short {k}"] if low(t) in seen), "short")
    for ids in ((None, None, None), (1, 1, 1)):
        rows = spark.createDataFrame(list(zip(ids, (a, b, short))), "doc_id long, text string")
        got = {r["n_bytes"]: r["n_removed"] for r in suffixes.remove_repeats(rows).collect()}
        alone = brute.without_repeats([(1, a)])[1][1]
        assert got == {len(a.encode()): alone, len(b.encode()): 0, len(short.encode()): 0} and alone > 100


def test_many_rows_without_an_id(spark):
    """20,000 rows without an id: what a row repeats of itself goes, what rows share at other starts goes where it starts later."""
    rng = random.Random(12)
    texts_ = [f"{k} " + sentence(rng, "en", 12) for k in range(19_900)] + [f"{k} " + 2 * (sentence(rng, "fr", 40) + " ") for k in range(100)]
    want = sorted((len(t.encode()), brute.without_repeats([(1, t)])[1][1]) for t in texts_)
    rows = spark.createDataFrame([(None, t) for t in texts_], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(rows).collect()) == want


def test_stated_shares_of_absent_kinds(spark):
    rng = random.Random(13)
    rows = [(i, sentence(rng, "en", 30), rng.choice(["en", "fr", "es"]), "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["axis"], r["kind"]): (r["target"], r["expected"]) for r in mixing.margins(docs, keep=0.3, targets={"lang": {"en": 0.5, "nope": 0.3}}).collect()}
    assert abs(got["lang", "en"][0] - 0.5) < 1e-9 and abs(got["lang", "en"][1] - 0.5) < 1e-3
    assert got["lang", "nope"] == (0.3, 0.0)
    with pytest.warns(UserWarning, match="nope"):
        mixing.mix(docs, keep=0.3, targets={"lang": {"en": 0.5, "nope": 0.3}})


def test_shares_of_many_partitions_by_halving():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 50, 5000)
    matrix = sharding.communication_matrix([int(sizes[i::8].sum()) for i in range(8)], sharding.shard_sizes(int(sizes.sum()), 16), 5)
    own = np.array([sharding.own_share(matrix, sizes, p, 5) for p in range(len(sizes))])
    assert (own.sum(1) == sizes).all() and (own >= 0).all()
    assert all((own[i::8].sum(0) == matrix[i]).all() for i in range(8))


def test_tokens_of_rows_without_or_with_one_id(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(public.path("byte_bpe_50k.json")), random.Random(14)
    rows = [(None, sentence(rng, "en", 9)) for _ in range(60)] + [(5, sentence(rng, "fr", 9)) for _ in range(60)] + [(5, "same")] * 9 + [(5, None), (None, ""), (7, "z")]
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start long, IDS string"), public.path("byte_bpe_50k.json"), path)
    got = token_output.digest(token_output.read_tokens(spark, path)).collect()
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, crc(t)) for i, t in rows)
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == [sum(x["n_tokens"] for x in in_order[:k]) for k in range(len(in_order))]
    assert [r["doc_id"] for r in in_order] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))


def test_index_finds_every_pair_within_the_radius(spark):
    """Pairs come from the block index alone: random fingerprints and near ones, against all pairs of equal lengths."""
    rng = random.Random(15)
    items = [(i, 20 + i % 3, rng.getrandbits(64)) for i in range(60)]
    windows = []
    for k in range(600):
        _, m, fp = rng.choice(items)
        for b in rng.sample(range(64), rng.randint(0, 30)):
            fp ^= 1 << b
        windows.append((k, m if k % 5 else 99, fp))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    left = spark.createDataFrame([(k, m, signed(f)) for k, m, f in windows], "k int, m int, fp long")
    right = spark.createDataFrame([(i, m, signed(f)) for i, m, f in items], "i int, m int, item_fp long")
    probes = left.select("k", "m", "fp", F.explode(decontamination._index_keys(F.col("fp"), True)).alias("key"))
    index = right.select("i", "m", "item_fp", F.explode(decontamination._index_keys(F.col("item_fp"), False)).alias("key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= decontamination.RADIUS
    got = {(r["k"], r["i"]) for r in probes.join(index, ["m", "key"]).filter(near).select("k", "i").distinct().collect()}
    want = {(k, i) for k, m, f in windows for i, n, g in items if m == n and (f ^ g).bit_count() <= decontamination.RADIUS}
    assert got == want and len(want) > 300


def test_short_items(spark):
    docs = spark.createDataFrame(
        [(1, "so: Electroencephalography, machines hum"), (2, "a b c d e f g"), (3, "これはとても長い日本語の文章です ok"), (4, "machines electroencephalography"), (None, "electroencephalography MACHINES"), (5, None), (6, "")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(10, "electroencephalography machines"), (11, "a b"), (12, "これはとても長い日本語の文章です"), (13, ""), (14, None), (None, "Machines hum electro")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["window"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 10): (1.0, 1), (3, 12): (1.0, 0), (None, 10): (1.0, 0)}
    assert sorted(r["doc_id"] for r in decontamination.without_contaminated(docs, items).collect()) == [2, 4, 5, 6]


def test_texts_between_languages_are_flagged(spark):
    """From one language to the other word by word: the choice is open somewhere on the way, and not at the ends."""
    rng = random.Random(18)
    learnt = [(i, sentence(rng, lang, 60), lang) for i, lang in enumerate(["en", "fr"] * 150)]
    a, b = sentence(rng, "en", 800).split(), sentence(rng, "fr", 800).split()
    mixed = [(1000 + k, " ".join(a[: 2 * k] + b[2 * k :]), None) for k in range(401)]
    docs = spark.createDataFrame(learnt + mixed, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["_tl_lang"] for r in language.identify(docs).collect()}
    way = [got[1000 + k] for k in range(401)]
    assert (way[0]["lang"], way[-1]["lang"]) == ("fr", "en") and not way[0]["ambiguous"] and not way[-1]["ambiguous"]
    assert any(w["ambiguous"] for w in way[40:361])
    assert all(not got[i]["ambiguous"] and got[i]["lang"] == lang for i, _, lang in learnt)


def test_rows_learnt_from_are_bounded_over_all_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_ROWS", 40)
    seen = []
    monkeypatch.setattr(language, "fit_bits", lambda x, y, code: seen.append(len(x)) or (np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.ones(code.shape[1], np.float32)))
    rng = random.Random(19)
    docs = spark.createDataFrame([(i, sentence(rng, "en", 5), f"l{i % 8}") for i in range(1600)], "doc_id long, text string, lang string")
    assert set(language.train(docs)["langs"]) <= {f"l{k}" for k in range(8)} and 8 <= seen[0] <= 90
