"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits. One logistic classifier per bit reads hashed byte n-grams (one to
three bytes) of the whole lower-cased text. Decoding adds, over the bits, the logistic loss of the classifier's
margin against the codeword, weighted by how well that bit could be learnt, and takes the language of least loss.

Training uses a bounded sample: at most about TRAIN_PER_LANG labelled documents of each language, drawn by a hash
of doc_id among documents whose crc32(doc_id) mod 5 is not 0. Prediction covers all documents and whole texts.

Defined results: a text that is null, empty or has no letter (Unicode category L) is `und` with score 0; with no
labelled document everything is `und`; with one labelled language all letters are that language; a null doc_id is never
learnt from and counts as held out; repeated rows are each answered; equal losses take the language first in order;
very long texts are read whole, one text of a batch at a time; an existing column of the result's name is replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import small_batches, table

#: Labelled rows that the model is fitted on: of each language, and of all (4 KB each on their way to the driver).
TRAIN_PER_LANG, TRAIN_ROWS = 1_500, 40_000
DIM = 2_048
#: Two best losses closer than this share of the weights leave the language open.
AMBIGUOUS_GAP = 0.02
#: Unicode letters alone: numerals such as fractions, superscripts or Roman digits are none.
_LETTER = regex.compile(r"\p{L}")
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def ngram_vector(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of bytes; unit length."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    h = [b * np.uint32(_MIX[0]) >> shift]
    if len(b) > 1:
        pair = b[:-1] * np.uint32(257) + b[1:]
        h.append(pair * np.uint32(_MIX[1]) >> shift)
    if len(b) > 2:
        h.append((pair[:-1] * np.uint32(263) + b[2:]) * np.uint32(_MIX[2]) >> shift)
    n = np.bincount(np.concatenate(h), minlength=DIM).astype(np.float32)
    return np.sqrt(n / max(1.0, float(n.sum())))


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +1/-1: all useful splits for up to 6 languages, else random ones with the widest least distance."""
    if k <= 1:
        return np.ones((k, 1), dtype=np.float32)
    if k <= 6:
        bits = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(bits, dtype=np.float32).T.copy()
    rng, best, width = np.random.default_rng(seed), None, 10 * int(np.ceil(np.log2(k)))
    for _ in range(50):
        m = rng.choice(np.array([1, -1], dtype=np.float32), size=(k, width))
        m = m[:, np.abs(m.sum(0)) < k]
        gap = ((m.shape[1] - m @ m.T) / 2 + np.eye(k) * width).min()
        if best is None or gap > best[0]:
            best = (gap, m)
    return best[1]


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits by accelerated gradient descent; weights, biases and bit reliabilities."""
    t, k = code[y], len(code)
    share = np.bincount(y, minlength=k).astype(np.float32)
    w_row = (1.0 / (np.maximum(share, 1)[y] * k))[:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), np.float32(4.0)
    for i in range(steps):
        g = -t * w_row / (1 + np.exp(np.clip(t * (x @ w + b), -30, 30)))
        move = np.float32(i / (i + 3))
        nw, nb = w - rate * (x.T @ g + 1e-5 * w), b - rate * g.sum(0)
        w, b, vw, vb = nw + move * (nw - vw), nb + move * (nb - vb), nw, nb
    right = ((np.sign(x @ vw + vb) == t) * w_row).sum(0)
    return vw, vb, np.maximum(2 * right - 1, 0.01).astype(np.float32)


def decode(margins: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of least weighted loss, its probability against the others, and whether the choice is open."""
    loss = np.log1p(np.exp(np.clip(-margins[:, None, :] * code[None], -30, 30))) @ (weight / weight.sum())
    best = loss.argmin(1)
    if len(code) == 1:
        return best, np.ones(len(best)), np.zeros(len(best), bool)
    two = np.sort(loss, axis=1)
    e = np.exp(-8.0 * (loss - two[:, :1]))
    return best, 1 / e.sum(1), two[:, 1] - two[:, 0] < AMBIGUOUS_GAP


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> dict:
    """The model: languages, codewords, classifiers. docs: doc_id, text, lang."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    per_lang = max(1, min(per_lang, TRAIN_ROWS // len(langs)))
    rate = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, per_lang / sizes[lang]))])
    coin = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([ngram_vector(t).astype(np.float16).tobytes() for t in texts])

    got = rows.filter(coin < rate[F.col("lang")]).select("lang", vector("text").alias("v")).toPandas()
    if not len(got):
        return {"langs": []}
    got = got.sort_values(["lang", "v"])
    langs = sorted(set(got["lang"]))
    x = np.stack([np.frombuffer(v, np.float16) for v in got["v"]]).astype(np.float32)
    y = np.searchsorted(np.array(langs, dtype=object), got["lang"].to_numpy(dtype=object))
    code = codewords(len(langs))
    w, b, trust = fit_bits(x, y, code)
    return {"langs": langs, "code": code, "w": w, "b": b, "trust": trust}


def predict(text: Column, model: dict) -> Column:
    """struct(lang string, score double, ambiguous boolean) of a text column."""
    langs = model["langs"]
    small_batches(SparkSession.active())

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [("und", 0.0, True)] * len(texts)
            known = [i for i, t in enumerate(texts) if langs and t is not None and _LETTER.search(t)]
            for at in range(0, len(known), 256):
                part = known[at : at + 256]
                x = np.stack([ngram_vector(texts.iat[i]) for i in part])
                best, score, open_ = decode(x @ model["w"] + model["b"], model["code"], model["trust"])
                for i, c, s, o in zip(part, best, score, open_):
                    out[i] = (langs[c], float(s), bool(o))
            yield pd.DataFrame(out, columns=["lang", "score", "ambiguous"])

    return run(text)


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, name: str = "_tl_lang") -> DataFrame:
    """docs with a column `name`: struct(lang, score, ambiguous), from a model learnt on docs itself."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, predict(F.col("text"), train(docs.select("doc_id", "text", "lang"), per_lang)))


def op8_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_tl_lang.lang").alias("lang_pred"),
        F.col("_tl_lang.score").alias("score"),
        F.col("_tl_lang.ambiguous").alias("ambiguous"),
    )
