"""The queries on universes and runs as SQL, for checking results in another engine."""

from __future__ import annotations

from tickloom.plans.oracle import SQL as BASE

_SUPPLIERS = BASE["bars"][BASE["bars"].index("agg AS (") : BASE["bars"].index("walk AS (")]
_CUSTOMERS = """agg AS (
  SELECT n.n_name AS ticker, CAST(n.n_nationkey AS BIGINT) AS pos, r.r_name AS sector, CAST(o.o_orderdate AS DATE) AS dt,
         CAST(SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, COUNT(*) AS volume
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL),
"""


def _second(sql: str) -> str:
    """A query on the second universe: only what bars are made of differs."""
    assert _SUPPLIERS in sql
    return sql.replace(_SUPPLIERS, _CUSTOMERS)


_DELTAS = ", ".join(f"FLOOR((b.{c} - a.{c}) * 1e4 + 0.5::DOUBLE) / 1e4 AS {c}_delta" for c in ("win_rate", "avg_excess", "median_excess", "avg_return", "mdd"))


def _compared(name: str, keys: str) -> str:
    own = lambda side, u: ", ".join(f"{side}.{c} AS {c}_{u}" for c in ("signals", "win_rate", "avg_excess", "median_excess", "avg_return", "mdd"))
    return f"SELECT {keys}, {own('a', 'suppliers')}, {own('b', 'customers')}, {_DELTAS} FROM ({BASE[name]}) a FULL JOIN ({_second(BASE[name])}) b USING ({keys})"


def _two_star(universe: str, sql: str) -> str:
    return f"SELECT '{universe}' AS universe, signals, win_rate, avg_excess, signals = 0 AS insufficient FROM ({sql}) WHERE strategy = 'consensus_2star' AND sample = 'out' AND basis = 'top5' AND quality = 'all' AND days = 20"


_GRID = "n >= 252 AND n < (SELECT COUNT(*) FROM cal) - 120 AND (n - 252) % 5 = 0"

SQL: dict[str, str] = {
    "second_universe_bars": _second(BASE["bars"]),
    "universe_comparison": _compared("strategy_table", "strategy, sample, basis, quality, days"),
    "universe_comparison_regimes": _compared("regime_axis", "strategy, sample, basis, regime, days"),
    "universe_two_star": f"{_two_star('suppliers', BASE['strategy_table'])} UNION ALL {_two_star('customers', _second(BASE['strategy_table']))}",
    "trend_recommend_from_file": BASE["trend_recommend_default"],
    "evaluation_dates_daily": BASE["evaluation_dates"].replace(_GRID, "n >= 252 AND n < (SELECT COUNT(*) FROM cal) - 120"),
    "template_recommend_short_run": BASE["template_recommend"].replace(_GRID, "n >= 300 AND n < (SELECT COUNT(*) FROM cal) - 60 AND (n - 300) % 10 = 0"),
}
