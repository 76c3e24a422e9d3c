"""Every rule of a backtest file: a whole file that keeps them all, and what each change to it breaks."""

import json

import pytest

from tickloom.operators.backtest_file import RULES, backtest_errors

CORE = {"winRate": 0.5, "avgExcess": -0.1, "medianExcess": None, "mdd": 0}
SUMMARY = {"signals": 3, **CORE, "avgReturn": 1.5}
HELD = [{"days": 5, **SUMMARY}, {"days": 20, **{k: None for k in SUMMARY}, "signals": 0}]
ENTERED = [{"days": 5, "conditional": SUMMARY, "opportunity": SUMMARY}]
DETAIL = [{"regime": "up", "signals": 1, **CORE, "stopHitRate": 0.1, "avgHoldingDays": None, "baseline": {"signals": 2, **CORE}}]
WHOLE = {
    "schemaVersion": 4,
    "generatedAt": "2026-01-01",
    "config": {
        "dataFrom": None, "dataTo": "x", "stepDays": 5, "holdingDays": [5, 20.5], "warmupDays": 252, "splitDate": None, "benchmark": "b", "topN": 5, "overlapFactor": {"5": 1, "20": 4.0}, "universe": "ndx",
        "universeStats": {"tickerCount": 1, "hasFullYearDataExcludedCount": 0, "hasFullYearDataExcludedRatio": None},
    },
    "strategies": [{"key": "trend", "sample": "in", "basis": "top5", "relaxedShare": None, "byHolding": HELD}],
    "fundamentalAxis": {"note": "n", "coveredFrom": None, "byVerdict": [{"verdict": "pass", "byHolding": HELD}]},
    "variants": [{"name": "v", "adopted": False, "outVsBaseline": {"avgExcessDelta": None, "winRateDelta": 1}, "note": "", "outDetail": {**SUMMARY, "avgHoldingDays": 3, "stopHitRate": 0}, "regimeDetail": DETAIL}],
    "freshnessCohorts": [{"key": "minervini", "sample": "out", "cohort": "3-4d", "byHolding": HELD}],
    "regimeAxis": [{"strategyKey": "consensus_1star", "sample": "out", "regime": "down", "byHolding": []}],
    "entryVariants": [{"name": "e", "signals": 2, "fillRate": None, "byHolding": ENTERED}],
    "combos": [{"name": "c", "adopted": True, "signals": 1, **CORE, "fillRate": 1, "avgReturn": 0, "avgHoldingDays": 2}],
    "stateAxis": [{"strategyKey": "trend", "sample": "in", "state": 3, "byHolding": HELD}, {"strategyKey": "trend", "sample": "in", "state": "산정불가", "byHolding": HELD}],
    "stateRegimeAxis": [{"strategyKey": "trend", "sample": "in", "state": 0, "regime": "up", "byHolding": HELD}],
    "pullbackAxis": [{"name": "pullback_resume", "sample": "in", "basis": "top5", "regime": "up", "adopted": False, "signals": 1, "fillRate": 0.5, "byHolding": ENTERED}],
    "pullbackFunnel": [{"sample": "in", "basis": "top5", "regime": "up", "signals": 1, "insufficientData": 0, "steps": {"p1": 1, "p1p2": 1, "p1p2p3": 0, "observed": 0}}],
    "climaxPartial": {"name": "c", "adopted": False, "outDetail": {**SUMMARY, "climaxTriggerRate": 0.2}, "comparison": {"noExit": None, "fullClimaxExit": {"signals": 1, "avgExcess": None, "medianExcess": 0}, "partialClimaxExit": None}},
    "hurdleIntersection": [{"sample": "in", "regime": "up", "hurdleGroup": "partialOrBetter", "coveredFrom": None, "note": "n", "byHolding": HELD}],
}
GONE = object()
#: Where a value is put (GONE: taken away), and the paths that then break a rule.
CHANGES = [
    (["schemaVersion"], 5, ["schemaVersion"]), (["schemaVersion"], "4", ["schemaVersion"]), (["generatedAt"], "", ["generatedAt"]), (["config"], None, ["config"]), (["config"], GONE, ["config"]),
    (["config", "dataFrom"], 3, ["config.dataFrom"]), (["config", "dataFrom"], GONE, ["config.dataFrom"]), (["config", "holdingDays"], [5, "20"], ["config.holdingDays"]), (["config", "holdingDays"], 5, ["config.holdingDays"]),
    (["config", "overlapFactor"], {"a": None}, ["config.overlapFactor"]), (["config", "overlapFactor"], None, ["config.overlapFactor"]), (["config", "overlapFactor"], GONE, []), (["config", "universe"], "other", ["config.universe"]), (["config", "universe"], GONE, []),
    (["config", "universeStats", "tickerCount"], "1", ["config.universeStats.tickerCount"]), (["config", "universeStats"], GONE, []), (["config", "topN"], True, ["config.topN"]),
    (["strategies"], {}, ["strategies"]), (["strategies"], GONE, ["strategies"]), (["strategies", 0], None, ["strategies[0]"]), (["strategies", 0, "key"], "other", ["strategies[0].key"]), (["strategies", 0, "byHolding", 1, "days"], None, ["strategies[0].byHolding[1].days"]),
    (["strategies", 0, "byHolding", 0, "mdd"], GONE, ["strategies[0].byHolding[0].mdd"]), (["strategies", 0, "relaxedShare"], "x", ["strategies[0].relaxedShare"]), (["schemaVersion"], 2, ["strategies[0].signalQuality"]), (["schemaVersion"], 1, []),
    (["fundamentalAxis"], None, []), (["fundamentalAxis"], GONE, []), (["fundamentalAxis"], 3, ["fundamentalAxis"]), (["fundamentalAxis", "byVerdict", 0, "verdict"], "none", ["fundamentalAxis.byVerdict[0].verdict"]), (["fundamentalAxis", "note"], "", ["fundamentalAxis.note"]),
    (["variants"], GONE, []), (["variants"], None, ["variants"]), (["variants", 0, "adopted"], 1, ["variants[0].adopted"]), (["variants", 0, "outDetail"], GONE, []), (["variants", 0, "outDetail"], None, ["variants[0].outDetail"]), (["variants", 0, "note"], None, ["variants[0].note"]),
    (["variants", 0, "outVsBaseline", "winRateDelta"], "1", ["variants[0].outVsBaseline.winRateDelta"]), (["variants", 0, "regimeDetail", 0, "baseline"], None, ["variants[0].regimeDetail[0].baseline"]), (["variants", 0, "regimeDetail", 0, "baseline", "mdd"], [], ["variants[0].regimeDetail[0].baseline.mdd"]),
    (["freshnessCohorts", 0, "key"], "consensus_2star", ["freshnessCohorts[0].key"]), (["freshnessCohorts", 0, "cohort"], "6d", ["freshnessCohorts[0].cohort"]), (["regimeAxis", 0, "regime"], None, ["regimeAxis[0].regime"]), (["regimeAxis", 0, "byHolding"], None, ["regimeAxis[0].byHolding"]),
    (["entryVariants", 0, "strategyKey"], "trend", []), (["entryVariants", 0, "strategyKey"], "x", ["entryVariants[0].strategyKey"]), (["entryVariants", 0, "byHolding", 0, "opportunity", "signals"], None, ["entryVariants[0].byHolding[0].opportunity.signals"]),
    (["combos", 0, "name"], 3, ["combos[0].name"]), (["combos", 0, "regimeDetail"], [1], ["combos[0].regimeDetail[0]"]), (["stateAxis", 0, "state"], 4, ["stateAxis[0].state"]), (["stateAxis", 1, "state"], "0", ["stateAxis[1].state"]), (["stateRegimeAxis", 0, "state"], None, ["stateRegimeAxis[0].state"]),
    (["pullbackAxis", 0, "name"], "entry_close", ["pullbackAxis[0].name"]), (["pullbackFunnel", 0, "steps", "p1p2"], None, ["pullbackFunnel[0].steps.p1p2"]), (["pullbackFunnel", 0, "steps"], GONE, ["pullbackFunnel[0].steps"]),
    (["climaxPartial"], None, ["climaxPartial"]), (["climaxPartial"], GONE, []), (["climaxPartial", "outDetail", "avgHoldingDays"], None, []), (["climaxPartial", "outDetail", "avgHoldingDays"], "x", ["climaxPartial.outDetail.avgHoldingDays"]), (["climaxPartial", "comparison", "noExit"], {"signals": 1}, ["climaxPartial.comparison.noExit.avgExcess", "climaxPartial.comparison.noExit.medianExcess"]),
    (["hurdleIntersection"], None, []), (["hurdleIntersection"], {}, ["hurdleIntersection"]), (["hurdleIntersection", 0, "hurdleGroup"], "fair", ["hurdleIntersection[0].hurdleGroup"]),
]


def changed(path: list, value: object) -> str:
    doc = json.loads(json.dumps(WHOLE))
    at = doc
    for k in path[:-1]:
        at = at[k]
    if value is GONE:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(doc)


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, changed(p, v)) for i, (p, v, _) in enumerate(CHANGES)] + [(1000, json.dumps(WHOLE)), (1001, "[1, 2"), (1002, "[]"), (1003, "null"), (1004, None), (1005, "{}")]
    out: dict = {}
    for r in backtest_errors(spark.createDataFrame(rows, "id int, json string")).collect():
        out.setdefault(r["id"], []).append(r["path"])
    return out


def test_all_sets_are_there():
    assert set(RULES) == set(WHOLE)


@pytest.mark.parametrize("i", range(len(CHANGES)))
def test_change(found, i):
    assert sorted(found.get(i, [])) == CHANGES[i][2], CHANGES[i]


def test_whole_and_unreadable_files(found):
    assert 1000 not in found and all(found[i] == [""] for i in (1001, 1002, 1003, 1004))
    assert sorted(found[1005]) == ["config", "generatedAt", "schemaVersion", "strategies"]
