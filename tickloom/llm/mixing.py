"""Mixing sources to target weights: iterative proportional fitting, then calibrated Poisson sampling.

Token counts are summed into cells of source x language x topic. Raking multiplies the cells by one factor for each
source, language and topic until the token totals meet the target shares of all three margins. A document of cell
c is then kept with probability min(1, kappa * factor of c); kappa is set so that the kept tokens are expected to
be `keep` of all, and capped cells are raked again so that the margins stay calibrated.

Targets are shares by source, language and topic that the caller states; a kind without one shares what the stated
ones leave, in the observed proportions. An axis without any targets gets the observed shares flattened by an exponent.
Topics come from a column expression of the caller, else from the form of a text. `margins` reports the target and the
expected share of every kind; where they are further apart than REPORTED, as stated shares may be beyond reach with the
documents at hand, a warning says so.

The cross-table of cells is the only thing on the driver; it grows with the kinds of sources, not with documents, and
more than MAX_CELLS cells are refused with an error before they are fetched.

Defined results: null source, language or topic is a kind of its own; a null text counts 0 tokens and topic `none`; a
document's coin depends on doc_id and text only, so repeated rows share their fate, also with a null doc_id; very long
texts are one row each, weighed by their tokens; kinds with equal tokens are treated alike; an empty table gives an
empty result; columns named like the results are replaced, and no other name can clash.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE, if_small, materialize, table, unused

KEEP = 0.8
#: Exponents that flatten the observed shares into targets: 1 leaves them, 0 makes all kinds equal.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
AXES = tuple(TEMPER)
ROUNDS, TOLERANCE = 500, 1e-9
#: Rounds of capping, cells that the driver holds at most, and the gap of a margin from its target that is reported.
CAPPINGS, MAX_CELLS, REPORTED = 100, 2_000_000, 0.005


def topic_of(text: Column) -> Column:
    """The form of a text, used as its topic: listing, markup, records, prose or none."""
    return (
        F.when(text.isNull() | (F.length(F.trim(text)) == 0), "none")
        .when(F.instr(text, " | ") > 0, "listing")
        .when(text.rlike(r"[*#$%&]{3}"), "markup")
        .when(text.rlike(r"\d{3}.*\d{3}"), "records")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    """Words of a text, counted without making them: starts of runs of non-space."""
    squeezed = F.trim(F.regexp_replace(text, SPACE, " "))
    words = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1
    return F.when(F.coalesce(F.length(squeezed), F.lit(0)) == 0, F.lit(0)).otherwise(words).cast("long")


def targets_of(codes: np.ndarray, tokens: np.ndarray, power: float, kinds: list[str | None] = (), stated: dict[str | None, float] | None = None) -> np.ndarray:
    """Target shares by kind: the stated ones, and for the others the rest in observed proportions; if none is stated,
    observed shares flattened by `power`."""
    share = np.bincount(codes, weights=tokens) / max(tokens.sum(), 1e-300)
    if not stated:
        flat = np.where(share > 0, share, 1.0) ** power * (share > 0)
        return flat / max(flat.sum(), 1e-300)
    given = np.array([stated.get(k, np.nan) for k in kinds])
    open_ = np.isnan(given)
    if min(stated.values()) < 0 or sum(stated.values()) > 1 + 1e-9:
        raise ValueError("target shares must not be negative or add up to more than 1")
    rest = max(0.0, 1 - given[~open_].sum())  # what kinds that the data lack were to have goes to those without a stated share
    out = np.where(open_, rest * share / max(share[open_].sum(), 1e-300), given)
    return out / max(out.sum(), 1e-300)


def rake(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], lower: np.ndarray | None = None) -> np.ndarray:
    """Factors by cell so that tokens * factor meets the targets (shares of sum(tokens)); `lower` holds fixed cells."""
    total, factor = tokens.sum(), np.ones(len(tokens))
    free = np.ones(len(tokens), bool) if lower is None else np.isnan(lower)
    if lower is not None:
        factor = np.where(free, 1.0, lower)
    for _ in range(ROUNDS):
        off = 0.0
        for code, want in zip(codes, targets):
            got = np.bincount(code, weights=tokens * factor * free, minlength=len(want))
            fixed = np.bincount(code, weights=tokens * factor * ~free, minlength=len(want))
            room = np.maximum(want * total - fixed, 0)
            step = np.divide(room, got, out=np.ones_like(got), where=got > 0)
            factor = np.where(free, factor * step[code], factor)
            off = max(off, float(np.abs(step[got > 0] - 1).max(initial=0)))
        if off < TOLERANCE:
            break
    return factor


def calibrate(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], keep: float) -> tuple[np.ndarray, np.ndarray]:
    """Raked factors, and sampling probabilities whose expected tokens meet the targets as far as 1 allows."""
    factor = rake(codes, tokens, targets)
    prob = keep * factor
    for _ in range(CAPPINGS):
        over = prob > 1 + 1e-9
        if not over.any():
            break
        held = np.where(prob >= 1 - 1e-9, 1 / keep, np.nan)
        prob = keep * rake(codes, tokens, targets, held)
    return factor, np.minimum(prob, 1.0)


def _planned(docs: DataFrame, keep: float, temper: dict[str, float], targets: dict[str, dict[str | None, float]], topic: Column | None):
    """docs with tokens, topic and keys of cells; the keys; the cells with weight and probability; margins by axis and kind."""
    new = ("tokens", "topic", "weight", "probability", "sampled")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    (*keys,) = unused(docs, *[f"{a}_kind" for a in AXES])
    rows = docs.select(*own, n_tokens(F.col("text")).alias("tokens"), (topic_of(F.col("text")) if topic is None else topic.cast("string")).alias("topic"))
    rows = rows.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(a)), F.lit("null")) for k, a in zip(keys, AXES)})
    sums = materialize(rows.groupBy(*keys).agg(F.sum("tokens").alias("t")), "cells")
    if (n := sums.count()) > MAX_CELLS:
        raise ValueError(f"{n} cells of source, language and topic are more than the {MAX_CELLS} that are raked on the driver; join rare kinds first")
    cells = sums.orderBy(*keys).toPandas()
    if not n:
        return rows, own, keys, cells.assign(weight=[], probability=[]), []
    mass = cells["t"].to_numpy(dtype=float) + 1e-6
    kinds = [cells[k].astype("category") for k in keys]
    codes = [k.cat.codes.to_numpy() for k in kinds]
    names = [[None if x == "null" else x[1:] for x in k.cat.categories] for k in kinds]
    wanted = [targets_of(c, mass, temper[a], x, targets.get(a)) for a, c, x in zip(AXES, codes, names)]
    factor, prob = calibrate(codes, mass, wanted, keep)
    kept = mass * prob
    lacking = [(a, k, float(v), 0.0) for a, x in zip(AXES, names) for k, v in targets.get(a, {}).items() if k not in x]
    margins = lacking + [(a, k, float(w), float(g)) for a, c, x, want in zip(AXES, codes, names, wanted) for k, w, g in zip(x, want, np.bincount(c, weights=kept) / max(kept.sum(), 1e-300))]
    return rows, own, keys, cells.assign(weight=factor, probability=prob), margins


def mix(docs: DataFrame, keep: float = KEEP, temper: dict[str, float] = TEMPER, seed: int = 23, targets: dict[str, dict[str | None, float]] | None = None, topic: Column | None = None) -> DataFrame:
    """docs with tokens, topic, weight, probability and sampled. targets: by axis, shares of kept tokens by kind."""
    rows, own, keys, cells, reached = _planned(docs, keep, temper, targets or {}, topic)
    if off := [m for m in reached if abs(m[2] - m[3]) > REPORTED]:
        warnings.warn(f"{len(off)} margins are off their targets, the first: {off[0]}; see margins()", stacklevel=2)
    plan = docs.sparkSession.createDataFrame(
        [(*k, float(f), float(p)) for k, f, p in zip(cells[keys].itertuples(index=False, name=None), cells["weight"], cells["probability"])],
        ", ".join(f"{k} string" for k in keys) + ", weight double, probability double",
    )
    coin = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 11) / float(1 << 53)
    return rows.join(if_small(plan, len(cells)), keys).select(
        *own, "tokens", "topic", "weight", "probability", (coin < F.col("probability")).alias("sampled")
    )


def margins(docs: DataFrame, keep: float = KEEP, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str | None, float]] | None = None, topic: Column | None = None) -> DataFrame:
    """axis, kind, target, expected: the share of kept tokens that each kind should have, and the one that sampling gives."""
    reached = _planned(docs, keep, temper, targets or {}, topic)[-1]
    return docs.sparkSession.createDataFrame(reached, "axis string, kind string, target double, expected double")


def op1_rake_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled")
