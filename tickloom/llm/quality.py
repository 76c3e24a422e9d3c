"""Quality rules with robust multivariate outliers.

Text statistics of every whole document are computed once and kept in the shared folder. The minimum-covariance-
determinant estimate is then found for each pair of language and source over all its documents. Starts come from a
sample of at most about SAMPLE documents of a group: random subsets are concentrated there, and the KEPT of least
determinant go on beside one start from medians. Over all documents, concentration steps then repeat "distances to the
estimate, smallest H of them, their mean and covariance" until no start's determinant falls any more, and the start of
least determinant wins. Distances are counted in fine logarithmic bins, so a step is an aggregation with partial sums
and never gathers a group. Two last steps take the moments of all documents within the 97.5 % distance (reweighting).

Groups lend each other strength at every size alike: PRIOR documents with the moments of the language are added to those
of a group, and PRIOR documents with the moments of all to those of a language. A group of a few documents is thus judged
by its language, and a large one by itself, with no size at which one rule gives way to another. A document whose
transformed statistics lie beyond the cut by squared Mahalanobis distance is rejected.

The deviations and correlations of the data decide. Most documents of a group have no symbols or duplicated lines, and a
deviation of zero would reject the first one, so a deviation counts as no less than what the statistic of a document of
that length can resolve: half a unit of a root of counts (a symbol, a line, a repeat of five words, which covers ten),
and the sampling error of a mean word length. In concentration steps the mean square of these resolutions, times PRIOR
over the documents plus PRIOR, is added to the variances, so that a determinant never vanishes.

Defined results: a null text has no words and fails the base rule; null language or source is a kind of its own; what
fails the base rule has no distance (null); repeated rows and ties are each judged, alike; a very long text is one row of
six counts; a null doc_id is passed through; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import if_small, materialize, small_batches, table

#: Share of a group that the estimate rests on; documents of a group's sample, its random subsets, and those that go on.
H, SAMPLE, SUBSETS, KEPT = 0.75, 400, 40, 2
#: Concentration steps at most, and the fall of the logarithm of a determinant below which a start has converged.
STEPS, CONVERGED = 12, 1e-3
#: Documents with the moments of the wider group that are added to each group.
PRIOR = 200.0
#: Fixed values for five dimensions: what makes the covariances of the nearest 75 and 97.5 % consistent; chi-square at
#: 0.975 and 0.999.
CONSISTENCY, REWEIGHTED, NEAR, CUT = 1.41, 1.055, 12.833, 20.515
#: Deviations below this are not resolved by a document of any length; weight of the unit matrix in correlations.
RESOLUTION, RIDGE = 0.02, 0.01
DIMS = 5
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_WORD, _SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeated, n = 0, len(words)
    if n >= 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(grams)) < len(grams):
            often = {g for g, k in Counter(grams).items() if k > 1}
            covered = bytearray(n)
            for i, g in enumerate(grams):
                if g in often:
                    covered[i : i + 5] = b"\x01\x01\x01\x01\x01"
            repeated = sum(covered)
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeated


def text_statistics(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([statistics(t) for t in b["text"]], columns=[x.split()[0] for x in STATS.split(", ")])
            yield pd.concat([b[["doc_id", "lang", "source"]].reset_index(drop=True), got], axis=1)

    return docs.select("doc_id", "text", "lang", "source").mapInPandas(run, f"doc_id long, lang string, source string, {STATS}")


def _features() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


def _resolutions() -> list[Column]:
    """Least deviation of each feature in a document of its length."""
    half = lambda n, unit=1: F.sqrt(F.lit(0.25 * unit) / F.greatest(F.col(n), F.lit(1)))
    own = [F.lit(RESOLUTION), half("n_words"), half("word_chars"), half("n_lines"), half("n_words", 10)]
    return [F.greatest(r, F.lit(RESOLUTION)) for r in own]


def _square(half: np.ndarray) -> np.ndarray:
    """The symmetric matrix of which half holds the PAIRS."""
    out = np.zeros((DIMS, DIMS))
    for v, (i, j) in zip(half, PAIRS):
        out[i, j] = out[j, i] = v
    return out


def _fit(n: float, s: np.ndarray, q: np.ndarray, floor: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and logarithm of the determinant from moments of a subset of a group of `size`."""
    mu = s / n
    cov = CONSISTENCY * (_square(q / n) - np.outer(mu, mu)) + np.diag(floor * PRIOR / (size + PRIOR) + 1e-9)
    return mu, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    return len(x), x.sum(0), np.array([(x[:, i] * x[:, j]).sum() for i, j in PAIRS])


def starts_of(x: np.ndarray, floor: np.ndarray, size: float, seed: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Estimates to go on from: medians with quartile deviations, and concentrated random subsets of a sample."""
    rng, h = np.random.default_rng(seed), max(1, int(np.ceil(H * len(x))))
    low, mid, high = np.percentile(x, [25, 50, 75], axis=0)
    spread = ((high - low) / 1.349) ** 2 + floor
    found = []
    for _ in range(SUBSETS):
        now, last = _fit(*_moments(x[rng.permutation(len(x))[: DIMS + 1]]), floor, size), np.inf
        for _ in range(30):
            d = x - now[0]
            now = _fit(*_moments(x[np.argsort(np.einsum("ni,ij,nj->n", d, now[1], d), kind="stable")[:h]]), floor, size)
            if last - now[2] < CONVERGED:
                break
            last = now[2]
        found.append(now)
    found.sort(key=lambda e: (e[2], e[0].tolist()))
    return [(mid, np.diag(1 / spread), 1e9), *found[:KEPT]]


def _first_estimates(rows: DataFrame) -> DataFrame:
    """g, start, mu, inv, logdet, floor, size of each group's starts."""
    floor = F.array(*[F.avg(F.col("least")[i] * F.col("least")[i]) for i in range(DIMS)])
    groups = materialize(rows.groupBy("g").agg(F.count("*").cast("double").alias("size"), floor.alias("floor")), "groups")
    coin = F.pmod(F.xxhash64(F.lit("start"), *[F.col("x")[i] for i in range(DIMS)], F.rand(29)), F.lit(1 << 40)) / float(1 << 40)
    some = rows.join(if_small(groups, groups.count()), "g").filter(coin * F.col("size") < SAMPLE).select("g", "x", "floor", "size")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["x"].tolist())
        x = x[np.lexsort(x.T)]
        found = starts_of(x, np.array(b["floor"].iat[0]), float(b["size"].iat[0]), 5)
        return pd.DataFrame([(b["g"].iat[0], i, m.tolist(), v.ravel().tolist(), d) for i, (m, v, d) in enumerate(found)], columns=["g", "start", "mu", "inv", "logdet"])

    found = some.groupBy("g").applyInPandas(run, "g string, start int, mu array<double>, inv array<double>, logdet double")
    return found.join(groups, "g")


def _distance(d: list[Column], inv: str = "inv") -> Column:
    total = F.lit(0.0)
    for i in range(DIMS):
        total = total + d[i] * d[i] * F.col(inv)[i * DIMS + i]
        for j in range(i):
            total = total + 2 * d[i] * d[j] * F.col(inv)[i * DIMS + j]
    return F.greatest(total, F.lit(0.0))


def _from_mean() -> list[Column]:
    return [F.col("x")[i] - F.col("mu")[i] for i in range(DIMS)]


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and m: count, sums and sums of products of x."""
    parts = [F.count("*").cast("double"), *[F.sum(F.col("x")[i]) for i in range(DIMS)], *[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS]]
    return rows.groupBy(*keys).agg(F.array(*parts).alias("m"))


def mcd(rows: DataFrame) -> DataFrame:
    """g, mu, inv, logdet: the estimate of least determinant of each group. rows: g string, x and least arrays of DIMS doubles."""
    small_batches(rows.sparkSession)
    now = materialize(_first_estimates(rows), "mcd")
    few = now.count()

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_fit(m[0], np.array(m[1 : 1 + DIMS]), np.array(m[1 + DIMS :]), np.array(f), n) for m, f, n in zip(b["m"], b["floor"], b["size"])]
            yield b[["g", "start"]].assign(mu=[o[0].tolist() for o in out], inv=[o[1].ravel().tolist() for o in out], logdet=[o[2] for o in out], floor=b["floor"], size=b["size"], fell=b["last"] - [o[2] for o in out])

    bin_of = F.floor(F.log2(_distance(_from_mean()) + 1e-6) * 32).cast("int")
    for _ in range(STEPS):
        far = rows.join(if_small(now, few), "g").select("g", "start", "x", bin_of.alias("bin"))
        bins = far.groupBy("g", "start", "bin").count().groupBy("g", "start").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("bins"), F.sum("count").alias("n"))
        walk = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("cut")),
            lambda a, b: F.struct(
                (a["c"] + b["count"]).alias("c"),
                F.when(a["cut"].isNull() & (a["c"] + b["count"] >= H * F.col("n")), b["bin"]).otherwise(a["cut"]).alias("cut"),
            ),
        )
        cut = materialize(bins.select("g", "start", walk["cut"].alias("cut")), "cuts")
        near = _sums(far.join(if_small(cut, few), ["g", "start"]).filter("bin <= cut"), "g", "start")
        packed = near.join(now.select("g", "start", "floor", "size", F.col("logdet").alias("last")), ["g", "start"])
        now = materialize(packed.mapInPandas(fit, "g string, start int, mu array<double>, inv array<double>, logdet double, floor array<double>, size double, fell double"), "mcd")
        if not now.filter(F.col("fell") >= CONVERGED).limit(1).count():
            break
    else:
        open_ = now.filter(F.col("fell") >= CONVERGED)
        warnings.warn(f"{open_.count()} starts, of group {open_.first()['g']} the first, haven't converged in {STEPS} steps", stacklevel=2)
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "start", "mu", "inv")).alias("b"))
    return materialize(best.select("g", "b.mu", "b.inv", "b.logdet"), "mcd")


def _scaled() -> list[Column]:
    return [d / F.greatest(F.col("dev")[i], F.col("least")[i]) for i, d in enumerate(_from_mean())]


def estimates(rows: DataFrame) -> DataFrame:
    """g, mu, dev, inv (of correlations) of each group of rows (g, l, x, least), reweighted and lent strength by l and by all.

    A group of a few documents that are all far from the others has them at its own centre, so what is near is judged
    once more by the estimates that others have lent strength to.
    """
    own = mcd(rows)
    groups = materialize(rows.select("l", "g").distinct(), "groups")
    first = _lent(_sums(rows.join(if_small(own, own.count()), "g").filter(_distance(_from_mean()) <= NEAR), "l", "g"), groups)
    return _lent(_sums(rows.join(if_small(first, first.count()), "g").filter(_distance(_scaled()) <= NEAR), "l", "g"), groups)


def _lent(sums: DataFrame, groups: DataFrame) -> DataFrame:
    """g, mu, dev, inv of all groups (l, g) from the moments m of what is near in each (l, g), with those of l and of all."""
    sums = materialize(sums, "moments")
    total = lambda *keys: sums.groupBy(*keys).agg(F.array(*[F.sum(F.col("m")[i]) for i in range(1 + DIMS + len(PAIRS))]).alias("w"))
    lend = lambda m, w: F.zip_with(m, w, lambda a, b: a + PRIOR * b / w[0])
    every = F.broadcast(total().filter("w[0] > 0").withColumnRenamed("w", "a"))  # one row
    by_language = groups.select("l").distinct().join(total("l"), "l", "left").crossJoin(every)
    by_language = by_language.select("l", F.coalesce(lend(F.col("w"), F.col("a")), F.transform("a", lambda b: PRIOR * b / F.col("a")[0])).alias("w"))
    lent = groups.join(sums.drop("l"), "g", "left").join(by_language, "l")
    lent = lent.select("g", F.coalesce(lend(F.col("m"), F.col("w")), "w").alias("m"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mu, dev, inv = [], [], []
            for m in b["m"]:
                mean = np.array(m[1 : 1 + DIMS]) / m[0]
                cov = REWEIGHTED * (_square(np.array(m[1 + DIMS :]) / m[0]) - np.outer(mean, mean))
                d = np.sqrt(np.maximum(np.diag(cov), 0))
                spread = np.where(d > 1e-6, d, np.inf)  # a constant statistic correlates with none
                corr = cov / np.outer(spread, spread)
                np.fill_diagonal(corr, 1)
                mu.append(mean.tolist())
                dev.append(d.tolist())
                inv.append(np.linalg.inv((1 - RIDGE) * corr + RIDGE * np.eye(DIMS)).ravel().tolist())
            yield pd.DataFrame({"g": b["g"], "mu": mu, "dev": dev, "inv": inv})

    return materialize(lent.mapInPandas(invert, "g string, mu array<double>, dev array<double>, inv array<double>"), "estimates")


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Statistics of docs (doc_id, text, lang, source) with base_failed, distance2 and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = materialize(text_statistics(docs).withColumn("base_failed", base), "quality")
    name = lambda *c: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("null")) for x in c])
    rows = stats.withColumns({"l": name("lang"), "g": name("lang", "source"), "x": F.array(*_features()), "least": F.array(*_resolutions())})
    known = estimates(rows.filter("NOT base_failed").select("l", "g", "x", "least"))
    out = rows.join(if_small(known, known.count()), "g", "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance(_scaled())))
    return out.select("doc_id", "lang", "source", *[x.split()[0] for x in STATS.split(", ")], "base_failed", "distance2", (~F.col("base_failed") & (F.col("distance2") <= cut)).alias("kept"))


def op6_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
