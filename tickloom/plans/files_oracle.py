"""Which values of the backtest files break which rule, as SQL."""

from __future__ import annotations

from tickloom.plans.oracle import SQL as BASE

_HELD = "fundamentalAxis.byVerdict[0].byHolding[0]"
_BROKEN = {
    "schemaVersion": "strategy = 'consensus_1star'",
    "config.stepDays": "sample = 'in' AND days = 5",
    "config.overlapFactor": "days = 90",
    "strategies[0].signalQuality": "strategy = 'trend' AND quality = 'normal'",
    "strategies[0].byHolding": "basis = 'top5' AND days = 60",
    "strategies[0].byHolding[0].winRate": "days = 20",
    "regimeAxis[0].regime": "days = 120",
    **{p: "basis = 'allSignals' AND days = 5 AND quality <> 'relaxed'" for p in ("fundamentalAxis.note", "fundamentalAxis.byVerdict[1]", *[f"{_HELD}.{c}" for c in ("days", "signals", "winRate", "avgExcess", "medianExcess", "avgReturn", "mdd")])},
}

SQL: dict[str, str] = {
    "backtest_file_errors": f"WITH t AS (SELECT *, CONCAT_WS('/', strategy, sample, basis, quality, days) AS id, days = 90 AND quality = 'relaxed' AS unreadable FROM ({BASE['strategy_table']})) SELECT id, '' AS path FROM t WHERE unreadable UNION ALL "
    + " UNION ALL ".join(f"SELECT id, '{p}' FROM t WHERE NOT unreadable AND {c}" for p, c in _BROKEN.items()),
}
