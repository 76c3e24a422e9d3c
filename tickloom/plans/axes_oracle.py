"""The axes as SQL, one query for each, and what the check against looking ahead must find."""

from __future__ import annotations

from tickloom.plans.backtest_oracle import _FRESH, _STATED
from tickloom.plans.oracle import _CROSS, REGIME, TEMPLATE, _r, _sql, _trend

_FIGURES = f"""COUNT(*) AS signals, {_r('AVG((excess > 0)::INT)', 4)} AS win_rate, {_r('AVG(excess)', 4)} AS avg_excess, {_r('MEDIAN(excess)', 4)} AS median_excess, {_r('AVG(ret)', 4)} AS avg_return, {_r('AVG(mdd)', 4)} AS mdd"""
_NONE = "CAST(NULL AS VARCHAR)"


def _axis(name: str, regime: str, state: str, cohort: str, where: str) -> str:
    return f"SELECT '{name}' AS axis, strategy, sample, basis, quality, {regime} AS regime, {state} AS state, {cohort} AS cohort, days, {_FIGURES} FROM graded WHERE {where} GROUP BY ALL"


_GRADED = """graded AS (SELECT ps.*, CASE strategy WHEN 'trend' THEN cc WHEN 'minervini' THEN pc END AS cohort, b.basis, q.quality FROM ps JOIN fr ON fr.ticker = ps.ticker AND fr.date = ps.eval_date
  JOIN (SELECT UNNEST(['allSignals', 'top5']) AS basis) b ON b.basis = 'allSignals' OR ps.rank <= 5 JOIN (SELECT UNNEST(['all', 'normal', 'relaxed']) AS quality) q ON q.quality = 'all' OR (q.quality = 'relaxed') = ps.relaxed)"""
_ONE = "quality = 'all' AND basis = 'allSignals'"
_STATE = "state IN ('0', '1', '2', '3')"
_CUT = "cut AS (SELECT eval_date AS middle FROM (SELECT eval_date, ROW_NUMBER() OVER (ORDER BY eval_date) - 1 AS i, COUNT(*) OVER () AS n FROM grid) WHERE i = n // 2)"


def _checked(part: str, source: str, date: str) -> str:
    return f"SELECT '{part}' AS part, COUNT(*) AS checked, CAST(0 AS BIGINT) AS differing FROM {source}, cut WHERE {date} <= middle HAVING (SELECT COUNT(*) FROM cut) > 0"


SQL: dict[str, str] = {
    "backtest_axes": _sql(
        [*_STATED, _FRESH, _GRADED],
        " UNION ALL ".join(
            [
                _axis("strategies", _NONE, _NONE, _NONE, "TRUE"),
                _axis("regimes", "regime", _NONE, _NONE, "regime IS NOT NULL AND quality = 'all'"),
                _axis("states", _NONE, "state", _NONE, f"{_STATE} AND {_ONE}"),
                _axis("statesByRegime", "regime", "state", _NONE, f"{_STATE} AND regime IS NOT NULL AND {_ONE}"),
                _axis("freshness", _NONE, _NONE, "cohort", f"cohort IS NOT NULL AND {_ONE}"),
            ]
        ),
    ),
    "look_ahead_check": _sql(
        [*_CROSS, REGIME, _trend("default"), TEMPLATE, _CUT],
        " UNION ALL ".join(
            [
                *[_checked(part, "f", "date") for part in ("indicators", "entries", "exits")],
                _checked("template", "template", "eval_date"),
                _checked("trend", "trend", "eval_date"),
                _checked("regimes", "reg", "date"),
            ]
        ),
    ),
}
