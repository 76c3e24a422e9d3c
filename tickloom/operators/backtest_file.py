"""The rules of whole backtest files, as published (fixed names and values)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.config import BASES, COHORTS, QUALITIES, REGIMES, SAMPLES, STRATEGIES
from tickloom.operators.rules import FLAG, NUMBER, OPTIONAL, OR_NULL, TEXT, Rule, an_object, array_of, errors, one_of

#: Versions that can be read, universes, verdicts, groups of hurdles, entries after a pullback, states of entry (fixed values).
VERSIONS = (1, 2, 3, 4)
UNIVERSE_CODES = ("ndx", "ngx")
VERDICTS, HURDLES = ("pass", "partial", "fail"), ("pass", "partial", "partialOrBetter", "fail")
PULLBACKS = ("pullback_immediate", "pullback_resume", "pullback_resume_vol")
ENTRY_STATES = (0, 1, 2, 3, "산정불가")

_maybe = NUMBER | OR_NULL
_text_or_null = Rule("text", empty=True, nullable=True)
_sample, _basis, _regime, _strategy, _state = one_of(*SAMPLES), one_of(*BASES), one_of(*REGIMES), one_of(*STRATEGIES), one_of(*ENTRY_STATES)


def _figures(*names: str) -> dict[str, Rule]:
    return {n: _maybe for n in names}


_core = _figures("winRate", "avgExcess", "medianExcess", "mdd")
_summary = an_object(signals=NUMBER, **_core, avgReturn=_maybe)
_by_holding = array_of(an_object(days=NUMBER, signals=NUMBER, **_core, avgReturn=_maybe))
_by_entry = array_of(an_object(days=NUMBER, conditional=_summary, opportunity=_summary))
_regime_detail = array_of(an_object(regime=_regime, signals=NUMBER, **_core, **_figures("stopHitRate", "avgHoldingDays"), baseline=an_object(signals=NUMBER, **_core))) | OPTIONAL
_compared = an_object(signals=NUMBER, **_figures("avgExcess", "medianExcess")) | OR_NULL

RULES: dict[str, Rule] = {
    "schemaVersion": one_of(*VERSIONS),
    "generatedAt": TEXT,
    "config": an_object(
        dataFrom=_text_or_null, dataTo=_text_or_null, stepDays=NUMBER, holdingDays=Rule("numbers"), warmupDays=NUMBER, splitDate=_text_or_null, benchmark=TEXT, topN=NUMBER,
        overlapFactor=Rule("named_numbers", optional=True), universe=one_of(*UNIVERSE_CODES) | OPTIONAL,
        universeStats=an_object(tickerCount=NUMBER, hasFullYearDataExcludedCount=NUMBER, hasFullYearDataExcludedRatio=_maybe) | OPTIONAL,
    ),
    "strategies": array_of(an_object(key=_strategy, sample=_sample, basis=_basis, relaxedShare=_maybe, signalQuality=one_of(*QUALITIES) | {"only": 2}, byHolding=_by_holding)),
    "fundamentalAxis": an_object(note=TEXT, coveredFrom=_text_or_null, byVerdict=array_of(an_object(verdict=one_of(*VERDICTS), byHolding=_by_holding))) | OPTIONAL | OR_NULL,
    "variants": array_of(
        an_object(
            name=TEXT, adopted=FLAG, outVsBaseline=an_object(**_figures("avgExcessDelta", "winRateDelta")), note=Rule("text", empty=True),
            outDetail=an_object(signals=NUMBER, **_core, **_figures("avgReturn", "avgHoldingDays", "stopHitRate")) | OPTIONAL, regimeDetail=_regime_detail,
        )
    ) | OPTIONAL,
    "freshnessCohorts": array_of(an_object(key=one_of(*STRATEGIES[:2]), sample=_sample, cohort=one_of(*COHORTS), byHolding=_by_holding)) | OPTIONAL,
    "regimeAxis": array_of(an_object(strategyKey=_strategy, sample=_sample, regime=_regime, byHolding=_by_holding)) | OPTIONAL,
    "entryVariants": array_of(an_object(name=TEXT, signals=NUMBER, fillRate=_maybe, strategyKey=_strategy | OPTIONAL, byHolding=_by_entry)) | OPTIONAL,
    "combos": array_of(an_object(name=TEXT, adopted=FLAG, signals=NUMBER, **_core, **_figures("fillRate", "avgReturn", "avgHoldingDays"), regimeDetail=_regime_detail)) | OPTIONAL,
    "stateAxis": array_of(an_object(strategyKey=_strategy, sample=_sample, state=_state, byHolding=_by_holding)) | OPTIONAL,
    "stateRegimeAxis": array_of(an_object(strategyKey=_strategy, sample=_sample, state=_state, regime=_regime, byHolding=_by_holding)) | OPTIONAL,
    "pullbackAxis": array_of(an_object(name=one_of(*PULLBACKS), sample=_sample, basis=_basis, regime=_regime, adopted=FLAG, signals=NUMBER, fillRate=_maybe, byHolding=_by_entry)) | OPTIONAL,
    "pullbackFunnel": array_of(an_object(sample=_sample, basis=_basis, regime=_regime, signals=NUMBER, insufficientData=NUMBER, steps=an_object(**{k: NUMBER for k in ("p1", "p1p2", "p1p2p3", "observed")}))) | OPTIONAL,
    "climaxPartial": an_object(
        name=TEXT, adopted=FLAG, outDetail=an_object(signals=NUMBER, **_core, **_figures("avgReturn", "climaxTriggerRate"), avgHoldingDays=_maybe | OPTIONAL),
        comparison=an_object(noExit=_compared, fullClimaxExit=_compared, partialClimaxExit=_compared),
    ) | OPTIONAL,
    "hurdleIntersection": array_of(an_object(sample=_sample, regime=_regime, hurdleGroup=one_of(*HURDLES), coveredFrom=_text_or_null, note=TEXT, byHolding=_by_holding)) | OPTIONAL | OR_NULL,
}


def backtest_errors(records: DataFrame) -> DataFrame:
    """id, path of each value that breaks a rule, of backtest files (id, json)."""
    return errors(records, RULES)
