"""The backtest queries as SQL, for checking results in another engine."""

from __future__ import annotations

from tickloom.config import HORIZONS, REGIMES, SAMPLES, STATES, STRATEGIES
from tickloom.plans.backtest_queries import COMBOS, POLICIES
from tickloom.plans.oracle import _ALL, _CROSS, _DAILY, _SAMPLE, BARS, EXITS, FORWARD, QUARTERS, STATE, _cells, _r, _sql, _summary, _trend
from tickloom.plans.oracle import SQL as BASE

_T = "PARTITION BY ticker ORDER BY idx"
_K = "PARTITION BY eval_date, ticker"

#: Per bar: peak before it, and what pullbacks and exits look at.
PULLBACK = f"""
pb0 AS (SELECT f.*, state, ex.x1, ex.x4, CASE WHEN f.idx >= 63 THEN
          (SELECT MIN(b.idx) FROM bars b WHERE b.ticker = f.ticker AND b.idx BETWEEN f.idx - 63 AND f.idx - 1 AND b.close = f.high63) END AS peak_idx
        FROM f JOIN st USING (ticker, idx) JOIN ex USING (ticker, idx)),
cum AS (SELECT ticker, idx, SUM(volume) OVER ({_T}) AS cv FROM bars),
pb AS (SELECT p.*, -(p.close - p.pvt) / p.pvt * 100 AS depth, COALESCE(p.close > p.sma200, FALSE) AS p3,
         COALESCE(2 * p.peak_idx - p.idx >= 0 AND c.cv - k.cv < k1.cv - COALESCE(r1.cv, 0), FALSE) AS p4,
         CASE WHEN p.pvt IS NOT NULL THEN (SELECT MIN(b.close) FROM bars b WHERE b.ticker = p.ticker AND b.idx BETWEEN p.peak_idx + 1 AND p.idx) END AS low_since,
         MAX(p.close) OVER (PARTITION BY p.ticker ORDER BY p.idx ROWS 9 PRECEDING) AS resume
       FROM pb0 p LEFT JOIN cum c ON c.ticker = p.ticker AND c.idx = p.idx LEFT JOIN cum k ON k.ticker = p.ticker AND k.idx = p.peak_idx
       LEFT JOIN cum k1 ON k1.ticker = p.ticker AND k1.idx = p.peak_idx - 1 LEFT JOIN cum r1 ON r1.ticker = p.ticker AND r1.idx = 2 * p.peak_idx - p.idx - 1)
"""
SPLIT = _SAMPLE
RECORDS = f"""
rec AS MATERIALIZED (SELECT t.eval_date, t.ticker, CAST(ROW_NUMBER() OVER (PARTITION BY t.eval_date ORDER BY t.rank) AS INT) AS rank, t.level <> 'strict' AS relaxed, t.regime, COALESCE(s.n_passed = 8, FALSE) AS p1,
   CASE WHEN t.eval_date >= split THEN 'out' ELSE 'in' END AS sample
  FROM tg t JOIN s USING (eval_date, ticker) CROSS JOIN sp WHERE t.signal),
sg AS MATERIALIZED (SELECT rec.*, p.idx AS pos_at, p.close, p.pvt, p.pvt * (1 + 0.003::DOUBLE) AS trig, p.resume, p.depth BETWEEN 10 AND 25 AS p2, p.p3, p.p4 FROM rec JOIN pb p ON p.ticker = rec.ticker AND p.date = rec.eval_date)
"""
_SIG = [*_ALL, STATE, EXITS, PULLBACK.replace("pb0 AS (", "pb0 AS MATERIALIZED (").replace("\npb AS (", "\npb AS MATERIALIZED ("), SPLIT, RECORDS]


def _first(window: int, hit: str, price: str, delay: int = 0, only: str = "TRUE") -> str:
    return f"""SELECT g.*, h.idx + {delay} AS fill_idx, h.price FROM sg g LEFT JOIN (
      SELECT eval_date, ticker, ARG_MIN(idx, idx) AS idx, ARG_MIN(price, idx) AS price FROM (
        SELECT g.eval_date, g.ticker, a.idx, {price} AS price FROM sg g
        JOIN (SELECT *, LAG(close) OVER ({_T}) AS before, LEAD(open) OVER ({_T}) AS next_open FROM pb) a ON a.ticker = g.ticker AND a.idx BETWEEN g.pos_at + 1 AND g.pos_at + {window}
        WHERE {only} AND {hit}) GROUP BY eval_date, ticker) h ON h.eval_date = g.eval_date AND h.ticker = g.ticker"""


_LOUD = "COALESCE(a.volume >= 1.5 * a.vsma50, FALSE)"
_SEEN = "(g.pvt IS NOT NULL AND g.p1 AND g.p2 AND g.p3 AND g.p4)"
FILLS = {
    "entry_close": "SELECT g.*, pos_at AS fill_idx, close AS price FROM sg g",
    "entry_pivot_trigger": _first(21, "a.high >= g.trig", "GREATEST(g.trig, a.open)"),
    "entry_pivot_trigger_vol": _first(21, f"a.high >= g.trig AND {_LOUD}", "GREATEST(g.trig, a.open)"),
    "entry_pivot_confirm2": f"SELECT * REPLACE (CASE WHEN price IS NOT NULL THEN fill_idx END AS fill_idx) FROM ({_first(21, 'a.idx >= g.pos_at + 2 AND a.close > g.pvt AND a.before > g.pvt', 'COALESCE(a.next_open, -1)', 1)})",
    "pullback_immediate": f"SELECT g.*, CASE WHEN {_SEEN} THEN pos_at END AS fill_idx, CASE WHEN {_SEEN} THEN close END AS price FROM sg g",
    "pullback_resume": _first(30, "a.close > g.resume", "GREATEST(g.resume, a.open)", only=_SEEN),
    "pullback_resume_vol": _first(30, f"a.close > g.resume AND {_LOUD}", "GREATEST(g.resume, a.open)", only=_SEEN),
}
# a confirmed signal whose next bar is missing stays unfilled
FILLS["entry_pivot_confirm2"] = f"SELECT * REPLACE (CASE WHEN price >= 0 THEN fill_idx END AS fill_idx, CASE WHEN price >= 0 THEN price END AS price) FROM ({FILLS['entry_pivot_confirm2']})"

_ATR = "c <= price - 2.5 * atr0"


def _stop(rule: str, kind: str) -> str:
    return {
        "exit_stop8_time60": "c <= price * (1 - 0.08::DOUBLE)",
        "exit_stop8_trail15": "c <= price * (1 - 0.08::DOUBLE) OR c <= peak * (1 - 0.15::DOUBLE)",
        "exit_stop_atr": _ATR,
        "exit_sma50_break": "x1",
        "exit_climax": "x4",
        "exit_regime_conditional": f"COALESCE(regime, '') <> 'up' AND {_ATR}",
        "exit_regime_flip": "flip",
        "exit_structural": "c <= pvt0 * 0.97::DOUBLE" if kind == "breakout" else "c <= low0 * 0.98::DOUBLE",
    }[rule]


def _walk(entry: str, tag: str = "") -> str:
    """fl: fills; wk: one row a position and bar ahead."""
    return f"""
fl{tag} AS MATERIALIZED ({FILLS[entry]}),
wk{tag} AS (SELECT g.eval_date, g.ticker, g.rank, g.sample, g.regime, g.price, e.date AS fill_date, e.atr14 AS atr0, e.pvt AS pvt0, e.low_since AS low0, a.idx - g.fill_idx AS k, a.close AS c, a.x1, a.x4,
   COALESCE(r.regime = 'down' AND r.transition_date = r.date, FALSE) AS flip,
   MAX(a.close) OVER (PARTITION BY g.eval_date, g.ticker ORDER BY a.idx) AS top, GREATEST(price, MAX(CASE WHEN a.idx > g.fill_idx THEN a.close END) OVER (PARTITION BY g.eval_date, g.ticker ORDER BY a.idx)) AS peak
  FROM fl{tag} g JOIN pb e ON e.ticker = g.ticker AND e.idx = g.fill_idx CROSS JOIN (SELECT UNNEST(RANGE(0, 121)) AS step) ks JOIN pb a ON a.ticker = g.ticker AND a.idx = g.fill_idx + ks.step LEFT JOIN reg r ON r.date = a.date),
wd{tag} AS MATERIALIZED (SELECT *, MAX((top - c) / top) OVER ({_K} ORDER BY k) AS dd FROM wk{tag})
"""


def _ended(rule: str, entry: str, tag: str = "", keep: str = "TRUE") -> str:
    kind = "pullback" if entry.startswith("pullback") else "breakout"
    return f"""SELECT * FROM (SELECT w.*, w.k AS days, m.hit IS NOT NULL AS stop_hit FROM wd{tag} w JOIN (
      SELECT eval_date, ticker, MIN(CASE WHEN k BETWEEN 1 AND 60 AND ({_stop(rule, kind)}) THEN k END) AS hit, MAX(k) AS n FROM wd{tag} GROUP BY ALL) m
      ON m.eval_date = w.eval_date AND m.ticker = w.ticker AND w.k = COALESCE(m.hit, CASE WHEN m.n >= 60 THEN 60 END)) WHERE {keep}"""


def _measured(source: str) -> str:
    """source with ret, bench, excess."""
    return f"""(SELECT e.*, e.c / e.price - 1 AS ret, b.bench, e.c / e.price - 1 - b.bench AS excess FROM ({source}) e JOIN (
      SELECT w.fill_date, w.days, AVG(y.close / x.close - 1) AS bench FROM (SELECT DISTINCT fill_date, days FROM ({source})) w
      JOIN bars x ON x.date = w.fill_date JOIN bars y ON y.ticker = x.ticker AND y.idx = x.idx + w.days GROUP BY ALL) b ON b.fill_date = e.fill_date AND b.days = e.days)"""


_OUT = "rank <= 5 AND sample = 'out'"
_SUM = f"""COUNT(*) AS signals, {_r('AVG((excess > 0)::INT)', 4)} AS win_rate, {_r('AVG(excess)', 4)} AS avg_excess, {_r('MEDIAN(excess)', 4)} AS median_excess, {_r('AVG(ret)', 4)} AS avg_return"""
_RULES = ["exit_stop8_time60", "exit_stop8_trail15", "exit_stop_atr", "exit_sma50_break", "exit_climax", "exit_regime_conditional", "exit_regime_flip", "exit_structural"]
_MORE = f"{_r('AVG(dd)', 4)} AS mdd, {_r('AVG(days)', 4)} AS avg_days, {_r('AVG(stop_hit::INT)', 4)} AS stop_rate"
_EACH = " UNION ALL ".join(f"SELECT *, '{r}' AS rule FROM ({_ended(r, 'entry_close', keep=_OUT)})" for r in _RULES)
_EVERY = f"EACHX AS MATERIALIZED ({_EACH})"
_BASIS = "UNNEST(CASE WHEN rank <= 5 THEN ['allSignals', 'top5'] ELSE ['allSignals'] END) AS basis"
_HELD = f"SELECT *, k AS days FROM {{}} WHERE k IN ({', '.join(map(str, HORIZONS))})"
_HORIZON = f"(SELECT UNNEST([{', '.join(map(str, HORIZONS))}]) AS days)"
_PERF = [*_ALL, FORWARD, SPLIT, "pr AS (SELECT pf.*, reg.regime, CASE WHEN eval_date >= split THEN 'out' ELSE 'in' END AS sample FROM pf LEFT JOIN reg ON reg.date = pf.eval_date CROSS JOIN sp)"]
_STATED = [*_PERF, STATE, "ps AS (SELECT pr.*, st.state FROM pr JOIN st ON st.ticker = pr.ticker AND st.date = pr.eval_date)"]
_COHORT = "CASE WHEN {0} IS NULL OR {0} >= 10 THEN 'no_recent_breakout' WHEN {0} = 0 THEN '0d' WHEN {0} <= 2 THEN '1-2d' WHEN {0} <= 4 THEN '3-4d' ELSE '5d+' END"
_FRESH = f"fr AS (SELECT ticker, date, {_COHORT.format('since_cross')} AS cc, {_COHORT.format('since_high')} AS pc FROM (SELECT *, idx - MAX(CASE WHEN proximity = 0 THEN idx END) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS since_high FROM f))"


_SIGNED = "sx AS (SELECT sig.*, st.state, reg.regime FROM sig LEFT JOIN st ON st.ticker = sig.ticker AND st.date = sig.eval_date LEFT JOIN reg ON reg.date = sig.eval_date CROSS JOIN sp WHERE sig.eval_date >= split)"


def _policy(name: str, pool: str, keep: str) -> str:
    """Picks are made among all signals of a date; those with a bar 20 days on are measured."""
    arms = f"""SELECT eval_date, ticker, strategy, 'policy' AS arm FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY rank) AS place FROM sx WHERE {pool} AND {keep}) WHERE place <= 5
      UNION ALL SELECT eval_date, ticker, strategy, 'baseline' FROM sx WHERE {pool} AND rank <= 5"""
    return f"SELECT ps.*, '{name}' AS policy, arm FROM ({arms}) JOIN ps USING (eval_date, ticker, strategy) WHERE days = 20"


_TREND_ONLY, _PAIR = "strategy = 'trend'", "strategy LIKE 'consensus%'"
_POLICIES = " UNION ALL ".join(
    [
        _policy("relax_off_in_downturn", _TREND_ONLY, "NOT (COALESCE(regime, '') = 'down' AND relaxed)"),
        _policy("twostar_only_in_downturn", _PAIR, "NOT (COALESCE(regime, '') = 'down' AND strategy = 'consensus_1star')"),
        _policy("actionable_only_top5", _TREND_ONLY, "state IN ('1', '2')"),
    ]
)
_ARMS = _cells({"policy": tuple(POLICIES), "arm": ("policy", "baseline")}, f"SELECT policy, arm, COUNT(*) AS signals, {_summary('', '').split('AS signals, ')[1].split(' FROM ')[0]} FROM ({_POLICIES}) GROUP BY ALL")
_TREND_CTES = [*_CROSS, _trend("default")]
_D = "COALESCE(disparity, 0)"
_INVERTED = f"""SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY score DESC, old) AS INT) AS rank FROM (SELECT t.eval_date, t.ticker, t.rank AS old, {_r(
    f"CASE WHEN {_D} < 3 THEN GREATEST(0, {_D} / 3) * 60 WHEN {_D} <= 8 THEN 60 ELSE GREATEST(0, (15 - {_D}) / 7) * 60 END + GREATEST(0, LEAST(COALESCE(vol_trend, 0), 50)) / 50::DOUBLE * 30 + CASE WHEN COALESCE(lead3, FALSE) THEN 10 ELSE 0 END", 1)} AS score
    FROM trend t JOIN s USING (eval_date, ticker) LEFT JOIN sec ON sec.eval_date = s.eval_date AND sec.sector = s.sector WHERE t.signal)"""
FLAGGED = """
ob AS (SELECT ticker, idx, CASE WHEN idx >= 19 THEN AVG(obv) OVER (PARTITION BY ticker ORDER BY idx ROWS 19 PRECEDING) END AS obv20 FROM f),
fg AS (SELECT s.*, ob.obv20, COALESCE(lead3, FALSE) AS lead, CASE WHEN sufficient AND atr_pct IS NOT NULL THEN CUME_DIST() OVER (PARTITION BY s.eval_date, sufficient, atr_pct IS NULL ORDER BY atr_pct) * 100 END AS atr_rank
  FROM s JOIN ob USING (ticker, idx) LEFT JOIN sec ON sec.eval_date = s.eval_date AND sec.sector = s.sector)
"""
_TOGGLES = {
    "leading_sector": "lead", "rsi_overheated": "rsi14 >= 70", "rsi_oversold": "rsi14 <= 30", "bollinger_lower": "close <= boll_lower * 1.02::DOUBLE", "bollinger_upper": "close >= boll_upper",
    "near_high": "close >= w52_high * 0.95::DOUBLE", "near_low": "close <= w52_low * 1.05::DOUBLE", "stochastic_oversold": "slow_k <= 20", "stochastic_overbought": "slow_k >= 80",
    "atr_low": "atr_rank <= 30", "atr_high": "atr_rank >= 70", "obv_rising": "obv > obv20", "obv_falling": "obv < obv20",
}
METRICS = f"""
mt AS (SELECT a.ticker, {_r('(a.eps / NULLIF(e.eps, 0) - 1) * 100', 2)} AS eps_yoy, {_r('(a.revenue / NULLIF(e.revenue, 0) - 1) * 100', 2)} AS revenue_yoy, a.roe,
  a.operating_margin >= b.operating_margin AS margin_up, a.eps > b.eps AS accelerating FROM quarters a JOIN quarters b ON b.ticker = a.ticker AND b.rn = 2 LEFT JOIN quarters e ON e.ticker = a.ticker AND e.rn = 5 WHERE a.rn = 1),
vd AS (SELECT ticker, CASE WHEN u >= 2 THEN 'insufficientFundamentals' WHEN k = 3 THEN 'pass' WHEN k >= 1 THEN 'partial' ELSE 'fail' END AS verdict FROM (
  SELECT ticker, (eps_yoy IS NULL)::INT + (revenue_yoy IS NULL)::INT + (roe IS NULL)::INT AS u, COALESCE(eps_yoy >= 20, FALSE)::INT + COALESCE(revenue_yoy >= 20, FALSE)::INT + COALESCE(roe >= 0.17::DOUBLE, FALSE)::INT AS k FROM mt))
"""
_HISTORY = f"hs AS (SELECT * FROM ({BASE['fundamental_history']}))"
_ASOF = f"av AS (SELECT t.eval_date, t.ticker, CAST(t.rank AS INT) AS rank, h.verdict FROM (SELECT * FROM tg WHERE signal) t ASOF LEFT JOIN hs h ON h.ticker = t.ticker AND t.eval_date >= h.as_of)"
_LEGS = """cl AS (SELECT eval_date, ticker, MAX(k) AS n, MIN(CASE WHEN k BETWEEN 1 AND 60 AND x4 THEN k END) AS hit FROM wd WHERE rank <= 5 AND sample = 'out' GROUP BY ALL HAVING MAX(k) >= 60),
lg AS (SELECT w.*, w.k AS days, u.weight FROM (SELECT eval_date, ticker, 60 AS k, CASE WHEN hit IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM cl UNION ALL SELECT eval_date, ticker, hit, 0.5::DOUBLE FROM cl WHERE hit IS NOT NULL) u
  JOIN wd w ON w.eval_date = u.eval_date AND w.ticker = u.ticker AND w.k = u.k),
cv AS (SELECT w.eval_date, w.ticker, w.k, CASE WHEN hit IS NOT NULL AND w.k >= hit THEN 0.5 * (h.c / w.price) + 0.5 * (w.c / w.price) ELSE w.c / w.price END AS v FROM wd w JOIN cl USING (eval_date, ticker)
  LEFT JOIN wd h ON h.eval_date = w.eval_date AND h.ticker = w.ticker AND h.k = cl.hit WHERE w.k <= 60),
fall AS (SELECT eval_date, ticker, MAX((m - v) / m) AS mdd FROM (SELECT *, MAX(v) OVER (PARTITION BY eval_date, ticker ORDER BY k) AS m FROM cv) GROUP BY ALL)"""


_THREE = """w3 AS (SELECT * FROM (VALUES (10, 0.25::DOUBLE), (40, 1 / 3::DOUBLE), (60, 1 - 0.25::DOUBLE - 1 / 3::DOUBLE)) v(days, weight)),
l3 AS (SELECT w.*, days, weight FROM wd w JOIN ok USING (eval_date, ticker) JOIN w3 ON w.k = w3.days),
c3 AS (SELECT w.eval_date, w.ticker, w.k, SUM(w3.weight * x.c / w.price) AS v FROM wd w JOIN ok USING (eval_date, ticker) CROSS JOIN w3
  JOIN wd x ON x.eval_date = w.eval_date AND x.ticker = w.ticker AND x.k = LEAST(w.k, w3.days) WHERE w.k <= 60 GROUP BY ALL),
f3l AS (SELECT eval_date, ticker, MAX((m - v) / m) AS mdd FROM (SELECT *, MAX(v) OVER (PARTITION BY eval_date, ticker ORDER BY k) AS m FROM c3) GROUP BY ALL)"""


def _axis_figures(keys: str, parts: list[str]) -> str:
    """Of parts with fill_idx, excess, ret and dd (null where unmeasured): fill rate, conditional and opportunity figures."""
    zero = lambda c: f"COALESCE({c}, 0)"
    return f"""SELECT {keys}, COUNT(*) AS signals, {_r('AVG((fill_idx IS NOT NULL)::INT)', 4)} AS fill_rate, COUNT(excess) AS measured, {_r('AVG((excess > 0)::INT)', 4)} AS win_rate, {_r('AVG(excess)', 4)} AS avg_excess,
        {_r('MEDIAN(excess)', 4)} AS median_excess, {_r('AVG(ret)', 4)} AS avg_return, {_r('AVG(dd)', 4)} AS mdd, {_r('AVG((COALESCE(excess, 0) > 0)::INT)', 4)} AS opportunity_win_rate, {_r(f"AVG({zero('excess')})", 4)} AS opportunity_excess,
        {_r(f"MEDIAN({zero('excess')})", 4)} AS opportunity_median, {_r(f"AVG({zero('ret')})", 4)} AS opportunity_return, {_r(f"AVG({zero('dd')})", 4)} AS opportunity_mdd
        FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"""


def _entered(names: tuple[str, ...], keep: str) -> tuple[list[str], list[str]]:
    """CTEs of the walks, and all signals by rule and length with what was measured."""
    parts = [
        f"""SELECT g.sample, g.rank, g.regime, g.fill_idx, h.days, p.excess, p.ret, p.dd, '{e}' AS rule FROM (SELECT * FROM fl{i} WHERE {keep}) g CROSS JOIN {_HORIZON} h
          LEFT JOIN {_measured(_HELD.format(f'wd{i}'))} p ON p.eval_date = g.eval_date AND p.ticker = g.ticker AND p.days = h.days"""
        for i, e in enumerate(names)
    ]
    return [_walk(e, str(i)) for i, e in enumerate(names)], parts


def _entry_axis() -> str:
    ctes, parts = _entered(("entry_close", "entry_pivot_trigger", "entry_pivot_trigger_vol", "entry_pivot_confirm2"), _OUT)
    return _sql([*_SIG, *ctes], _axis_figures("rule, days", parts))


def _tagged(names: dict[str, tuple[str, str]]) -> str:
    ctes = [_walk(e, str(i)) for i, (e, _) in enumerate(names.values())]
    parts = [f"SELECT *, '{n}' AS combo FROM {_measured(_ended(r, e, str(i), _OUT))}" for i, (n, (e, r)) in enumerate(names.items())]
    return _sql([*_SIG, *ctes], f"SELECT combo, {_SUM}, {_r('AVG(dd)', 4)} AS mdd, {_r('AVG(days)', 4)} AS avg_days FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL")


def _pullback_axis() -> str:
    names = ("pullback_immediate", "pullback_resume", "pullback_resume_vol")
    ctes, parts = _entered(names, "regime IS NOT NULL")
    figures = _axis_figures("rule, sample, basis, regime, days", [f"SELECT *, {_BASIS} FROM ({p})" for p in parts])
    cells = {"rule": names, "sample": ("in", "out"), "basis": ("allSignals", "top5"), "regime": ("up", "neutral", "down"), "days": (5, 20, 60, 90, 120)}
    return _sql([*_SIG, *ctes], f"SELECT * REPLACE (COALESCE(measured, 0) AS measured) FROM ({_cells(cells, figures)})")


_FUNNEL = ", ".join(f"COUNT(*) FILTER (WHERE pvt IS NOT NULL AND {c}) AS {n}" for n, c in (("p1", "p1"), ("p1p2", "p1 AND p2"), ("p1p2p3", "p1 AND p2 AND p3"), ("observed", "p1 AND p2 AND p3 AND p4")))
_LAST = "(SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY idx DESC) = 1)"

SQL: dict[str, str] = {
    **{f"fill_{n}": _sql(_SIG, f"SELECT eval_date, ticker, fill_idx - pos_at AS wait, {_r('price')} AS price FROM ({q})") for n, q in FILLS.items()},
    **{r: _sql([*_SIG, _walk("entry_close")], f"SELECT eval_date, ticker, days, stop_hit, {_r('ret')} AS ret, {_r('excess')} AS excess, {_r('dd')} AS mdd FROM {_measured(_ended(r, 'entry_close'))}") for r in _RULES},
    "exit_variants": _sql([*_SIG, _walk("entry_close"), _EVERY], f"SELECT rule, {_SUM}, {_MORE} FROM {_measured('SELECT * FROM EACHX')} GROUP BY ALL"),
    "exit_regime_detail": _sql([*_SIG, _walk("entry_close"), _EVERY], f"SELECT rule, regime, {_SUM}, {_MORE} FROM {_measured('SELECT * FROM EACHX')} WHERE regime IS NOT NULL GROUP BY ALL"),
    "combos": _tagged(COMBOS),
    "entry_variants_axis": _entry_axis(),
    "climax_partial": _sql(
        [*_SIG, _walk("entry_close"), _LEGS],
        f"""SELECT eval_date, ticker, hit IS NOT NULL AS triggered, held, {_r('ret')} AS ret, {_r('ret - bench')} AS excess, {_r('mdd')} AS mdd FROM (
        SELECT eval_date, ticker, SUM(weight * ret) AS ret, SUM(weight * bench) AS bench, SUM(weight * days) AS held FROM {_measured('SELECT * FROM lg')} GROUP BY ALL) JOIN cl USING (eval_date, ticker) JOIN fall USING (eval_date, ticker)""",
    ),
    "three_leg_positions": _sql(
        [*_SIG, _walk("entry_close"), "ok AS (SELECT eval_date, ticker FROM wd GROUP BY ALL HAVING MAX(k) >= 60)", _THREE],
        f"""SELECT eval_date, ticker, 3 AS n_legs, {_r('held')} AS held, {_r('ret')} AS ret, {_r('ret - bench')} AS excess, {_r('mdd')} AS mdd FROM (
        SELECT eval_date, ticker, SUM(weight * ret) AS ret, SUM(weight * bench) AS bench, SUM(weight * days) AS held FROM {_measured('SELECT * FROM l3')} GROUP BY ALL) JOIN f3l USING (eval_date, ticker)""",
    ),
    "pullback_checks": _sql(_SIG, f"SELECT ticker, idx, peak_idx, depth BETWEEN 10 AND 25 AS p2, p3, p4, {_r('depth')} AS depth_pct, {_r('low_since')} AS pullback_low, {_r('resume')} AS resume_trigger FROM pb WHERE pvt IS NOT NULL"),
    "pullback_funnel": _sql(_SIG, f"SELECT sample, basis, regime, COUNT(*) AS signals, COUNT(*) FILTER (WHERE pvt IS NULL) AS insufficient, {_FUNNEL} FROM (SELECT *, {_BASIS} FROM sg WHERE regime IS NOT NULL) GROUP BY ALL"),
    "pullback_axis": _pullback_axis(),
    "signal_performance": _sql(_PERF, f"SELECT eval_date, ticker, strategy, days, sample, regime, {_r('ret')} AS ret, {_r('excess')} AS excess, {_r('mdd')} AS mdd FROM pr"),
    "state_axis": _sql(_STATED, _cells({"strategy": STRATEGIES, "sample": SAMPLES, "state": STATES, "days": HORIZONS}, _summary("strategy, sample, state, days", "(SELECT * FROM ps WHERE state <> 'undetermined')"))),
    "state_regime_axis": _sql(
        _STATED,
        _cells({"strategy": STRATEGIES, "sample": SAMPLES, "state": STATES, "regime": REGIMES, "days": HORIZONS}, _summary("strategy, sample, state, regime, days", "(SELECT * FROM ps WHERE state <> 'undetermined' AND regime IS NOT NULL)")),
    ),
    "freshness_axis": _sql(
        [*_PERF, _FRESH],
        _cells(
            {"strategy": ("trend", "minervini"), "sample": ("in", "out"), "cohort": ("0d", "1-2d", "3-4d", "5d+", "no_recent_breakout"), "days": (5, 20, 60, 90, 120)},
            _summary("strategy, sample, cohort, days", "(SELECT pr.*, CASE WHEN strategy = 'trend' THEN cc ELSE pc END AS cohort FROM pr JOIN fr ON fr.ticker = pr.ticker AND fr.date = pr.eval_date WHERE strategy IN ('trend', 'minervini'))"),
        ),
    ),
    "policy_variants": _sql([*_STATED, _SIGNED], _ARMS),
    "policy_deltas": _sql(
        [*_STATED, _SIGNED, f"arms AS ({_ARMS})"],
        f"""SELECT *, policy_signals >= least_signals AS sufficient_sample, COALESCE(policy_signals >= least_signals AND excess_delta >= 0 AND win_rate_delta >= 0, FALSE) AS meets_criteria FROM (
        SELECT p.policy, p.signals AS policy_signals, b.signals AS baseline_signals, {_r('p.avg_excess - b.avg_excess', 4)} AS excess_delta, {_r('p.win_rate - b.win_rate', 4)} AS win_rate_delta,
          CAST(CASE p.policy WHEN 'actionable_only_top5' THEN 100 ELSE 50 END AS INT) AS least_signals FROM arms p JOIN arms b ON b.policy = p.policy WHERE p.arm = 'policy' AND b.arm = 'baseline')""",
    ),
    "variant_inverted_u": _sql(_TREND_CTES, f"SELECT eval_date, ticker, score, rank FROM ({_INVERTED})"),
    "variant_adx_gate": _sql(_TREND_CTES, "SELECT eval_date, ticker, score, level, CAST(ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY score DESC, pos) AS INT) AS rank FROM tr3 WHERE signal AND COALESCE(adx14, 0) >= 20"),
    "variant_consensus_weighted": _sql(
        [*_ALL, "a0 AS (SELECT *, CUME_DIST() OVER (PARTITION BY eval_date ORDER BY score) * 100 AS pct FROM trend)", "b0 AS (SELECT *, CUME_DIST() OVER (PARTITION BY eval_date ORDER BY score) * 100 AS pct FROM template)"],
        f"""SELECT COALESCE(a.eval_date, b.eval_date) AS eval_date, COALESCE(a.ticker, b.ticker) AS ticker, CASE WHEN a.ticker IS NOT NULL AND b.ticker IS NOT NULL THEN 2 ELSE 1 END AS stars,
        {_r('COALESCE(a.pct * 0.6::DOUBLE + b.pct * (1 - 0.6::DOUBLE), a.pct, b.pct)', 4)} AS pct FROM a0 a FULL JOIN b0 b ON a.eval_date = b.eval_date AND a.ticker = b.ticker""",
    ),
    "filter_combo": _sql([*_CROSS, FLAGGED], "SELECT eval_date, ticker FROM fg WHERE sufficient AND disparity >= 0 AND vol_trend >= -20 AND close >= w52_high * 0.95::DOUBLE AND slow_k >= 80 AND obv > obv20"),
    "filter_counts": _sql([*_CROSS, FLAGGED], "SELECT eval_date, " + ", ".join(f"COUNT(*) FILTER (WHERE sufficient AND {c}) AS {n}" for n, c in _TOGGLES.items()) + ", COUNT(*) FILTER (WHERE sufficient AND w52_high IS NULL) AS week52_excluded FROM fg GROUP BY eval_date"),
    "atr_percentile_filter": _sql([*_CROSS, FLAGGED], f"SELECT eval_date, ticker, {_r('atr_rank', 4)} AS atr_rank, atr_rank <= 30 AS low, atr_rank >= 70 AS high FROM fg WHERE sufficient"),
    "bars_liquidity_guardrail": _sql(
        [BARS],
        f"""SELECT ticker, CASE WHEN close < 10 THEN 'price' WHEN dollars < 50000 THEN 'dollar volume' END AS reason FROM (
        SELECT *, AVG(close * volume) OVER ({_T} ROWS 19 PRECEDING) AS dollars FROM bars) QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY idx DESC) = 1""",
    ),
    "ticker_sufficiency": _sql([BARS], "SELECT ticker, COUNT(*) AS n_bars, COUNT(*) >= 110 AS sufficient, CASE WHEN COUNT(*) < 110 THEN 'fewer than 110 bars' END AS reason FROM bars GROUP BY ticker"),
    "text_search": _sql([BARS], "SELECT ticker, sector, COUNT(*) AS bars FROM bars WHERE ticker LIKE '%\\_1%' ESCAPE '\\' OR sector LIKE '%\\_1%' ESCAPE '\\' GROUP BY ALL"),
    "fundamental_metrics": _sql([QUARTERS, METRICS], f"SELECT ticker, {_r('eps_yoy', 4)} AS eps_yoy, {_r('revenue_yoy', 4)} AS revenue_yoy, roe, margin_up, accelerating FROM mt"),
    "fundamental_hurdle": _sql([QUARTERS, METRICS], "SELECT ticker, verdict FROM vd"),
    "fundamental_asof": _sql([*_ALL, _HISTORY, _ASOF], "SELECT eval_date, ticker, rank, verdict FROM av"),
    "fundamental_axis": _sql([*_PERF, _HISTORY, _ASOF], _summary("verdict, days", "(SELECT pr.*, verdict FROM pr JOIN av USING (eval_date, ticker) WHERE strategy = 'trend' AND verdict IN ('pass', 'partial', 'fail'))")),
    "recommend_fundamental_split": _sql([*_ALL, QUARTERS, METRICS], "SELECT eval_date, ticker, verdict, COALESCE(verdict, '') <> 'fail' AS visible FROM tg LEFT JOIN vd USING (ticker) WHERE signal"),
    "portfolio_weighted": _sql(_TREND_CTES, f"SELECT eval_date, COUNT(*) AS tickers, {_r('SUM(t.score * sim_return) / NULLIF(SUM(t.score), 0)')} AS weighted_return, {_r('SUM(t.score * volatility) / NULLIF(SUM(t.score), 0)')} AS weighted_volatility FROM trend t JOIN s USING (eval_date, ticker) GROUP BY eval_date"),
    "pie_buckets": _sql(
        _TREND_CTES,
        f"""SELECT eval_date, CASE WHEN n <= 8 OR i < 8 THEN ticker ELSE 'other' END AS slice, {_r('SUM(share)', 4)} AS pct FROM (SELECT *, COUNT(*) OVER d AS n, ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY score DESC, ticker) AS i,
        score / NULLIF(SUM(score) OVER d, 0) * 100 AS share FROM trend WINDOW d AS (PARTITION BY eval_date)) GROUP BY ALL""",
    ),
    "position_plan": _sql(
        _DAILY,
        f"""SELECT ticker, {_r('r')} AS return_pct, {_r('r / 8')} AS r_multiple, r / 8 >= 2 AS break_even, {_r('p * (1 - 0.08::DOUBLE)')} AS stop_fixed, {_r('p - 2.5 * atr14')} AS stop_atr, {_r('m * 0.85::DOUBLE')} AS trailing,
        {_r('GREATEST(p * (1 - 0.08::DOUBLE), m * 0.85::DOUBLE)')} AS effective_stop, (m - p) / p * 100 >= 20 AND r <= (m - p) / p * 100 * 0.5 AS giveback_alert FROM (
        SELECT o.ticker, o.close AS p, (l.close - o.close) / o.close * 100 AS r, l.atr14, (SELECT MAX(close) FROM bars h WHERE h.ticker = o.ticker AND h.idx >= 200) AS m FROM bars o JOIN {_LAST} l USING (ticker) WHERE o.idx = 200)""",
    ),
    "sparkline_change": _sql(
        [BARS],
        f"""SELECT ticker, n AS bars, {_r('CASE WHEN COUNT(*) >= 2 THEN (ARG_MAX(close, idx) / ARG_MIN(close, idx) - 1) * 100 END')} AS change_pct FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY idx DESC) AS back FROM bars)
        JOIN (SELECT UNNEST([21, 63, 126]) AS n) ON back <= n GROUP BY ALL""",
    ),
}
