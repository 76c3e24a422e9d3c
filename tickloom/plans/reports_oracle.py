"""The report queries as SQL, for checking results in another engine."""

from __future__ import annotations

from tickloom.config import HORIZONS, REGIMES, SAMPLES
from tickloom.plans import backtest_oracle, oracle
from tickloom.plans.backtest_oracle import _HISTORY, _INVERTED, _PERF, _RULES
from tickloom.plans.oracle import _ALL, _CROSS, _DAILY, _SAMPLE, BARS, EXITS, FORWARD, REGIME, STATE, _cells, _r, _sql, _summary, _trend

_ST, _BT = oracle.SQL, backtest_oracle.SQL
_BASE = f"(SELECT signals AS base_signals, win_rate AS base_win_rate, avg_excess AS base_avg_excess, median_excess AS base_median_excess FROM ({_ST['strategy_table']}) WHERE strategy = 'trend' AND sample = 'out' AND basis = 'top5' AND quality = 'all' AND days = 60)"
#: Positions of which half ends at a climax, unrounded and with their regime.
_PARTIAL = _BT["climax_partial"].replace(f"{_r('ret - bench')} AS excess", "ret - bench AS excess, regime").replace(f"{_r('mdd')} AS mdd", "mdd").replace("JOIN fall USING (eval_date, ticker)", "JOIN fall USING (eval_date, ticker) JOIN (SELECT eval_date, ticker, regime FROM rec) USING (eval_date, ticker)")
_PARTIAL_BY_REGIME = f"SELECT 'exit_climax_partial', regime, COUNT(*), {_r('AVG((excess > 0)::INT)', 4)}, {_r('AVG(excess)', 4)}, {_r('MEDIAN(excess)', 4)}, {_r('AVG(mdd)', 4)}, {_r('AVG(triggered::INT)', 4)}, {_r('AVG(held)', 4)} FROM ({_PARTIAL}) WHERE regime IS NOT NULL GROUP BY regime"
_X3 = "s3 AS (SELECT s.*, ex.x1, ex.x1_strong, ex.x2, ex.x4, ex.x5, CASE WHEN full_year THEN 8 - n_passed END AS missing, CASE WHEN full_year THEN 8 - n_passed >= 3 END AS x3 FROM s JOIN ex USING (ticker, idx))"
_CODES = ", ".join(f"CASE WHEN x{k} THEN 'X{k}' END" for k in range(1, 6))
_LINES = """ln AS (SELECT s_suppkey AS line, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 19 = 3 THEN '(w/i)' ELSE ' ' || LOWER(n_name) || CASE s_suppkey % 11 WHEN 0 THEN ' (W/I) *' WHEN 1 THEN '**' WHEN 2 THEN '.b' ELSE '' END END AS ticker,
  CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE s_name END AS name, CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE r_name END AS sector,
  CASE s_suppkey % 5 WHEN 0 THEN 'NYSE ARCA' WHEN 1 THEN NULL WHEN 2 THEN ' nasdaq gs ' ELSE 'NASDAQ' END AS exchange
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_TICKER = r"TRIM(RTRIM(TRIM(REGEXP_REPLACE(UPPER(TRIM(ticker)), '\s*\([^)]*\)$', '')), '*'))"
_FRAME = """fq AS (SELECT ticker, date, idx, open, high, low, close, volume, idx % 50 < 48 AS whole, idx % 50 <> 49 AS part FROM bars),
lg AS (SELECT ticker, COUNT(*) FILTER (WHERE whole) AS bars, COUNT(*) FILTER (WHERE part AND NOT whole) AS dropped FROM fq GROUP BY ticker)"""
_TREND_CUSTOM = _trend("default").replace("rsi14 >= 50", "rsi14 >= 48").replace("score >= 70", "score >= 75")
_VARIANTS = f"""
va AS ({_INVERTED}), vb AS (SELECT eval_date, ticker, ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY score DESC, pos) AS rank FROM tr3 WHERE signal AND COALESCE(adx14, 0) >= 20),
ua AS (SELECT *, CUME_DIST() OVER (PARTITION BY eval_date ORDER BY score) * 100 AS pct FROM trend), ub AS (SELECT *, CUME_DIST() OVER (PARTITION BY eval_date ORDER BY score) * 100 AS pct FROM template),
uc AS (SELECT COALESCE(a.eval_date, b.eval_date) AS eval_date, COALESCE(a.ticker, b.ticker) AS ticker, a.rank AS ra, b.rank AS rb, CASE WHEN a.ticker IS NOT NULL AND b.ticker IS NOT NULL THEN 2 ELSE 1 END AS stars,
  {_r('COALESCE(a.pct * 0.6::DOUBLE + b.pct * (1 - 0.6::DOUBLE), a.pct, b.pct)', 8)} AS w FROM ua a FULL JOIN ub b ON a.eval_date = b.eval_date AND a.ticker = b.ticker),
vc AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY stars DESC, w DESC, ra NULLS LAST, rb) AS rank FROM uc),
vl AS (SELECT 'disparity_inverted_u' AS variant, eval_date, ticker FROM va WHERE rank <= 5 UNION ALL SELECT 'adx_gate', eval_date, ticker FROM vb WHERE rank <= 5 UNION ALL SELECT 'consensus_weighted', eval_date, ticker FROM vc WHERE rank <= 5),
vp AS (SELECT variant, COUNT(*) AS signals, {_r('AVG(ret - bench)', 4)} AS e, {_r('AVG((ret > bench)::INT)', 4)} AS w FROM vl JOIN fw ON fw.date = eval_date AND fw.ticker = vl.ticker AND fw.days = 20 JOIN bm ON bm.date = fw.date AND bm.days = 20 CROSS JOIN sp WHERE eval_date >= split GROUP BY variant),
vbase AS (SELECT variant, COUNT(*) AS signals, {_r('AVG(excess)', 4)} AS e, {_r('AVG((excess > 0)::INT)', 4)} AS w FROM pr JOIN (VALUES ('disparity_inverted_u', 'trend'), ('adx_gate', 'trend'), ('consensus_weighted', 'consensus_2star'), ('consensus_weighted', 'consensus_1star')) v(variant, strategy) USING (strategy)
  WHERE rank <= 5 AND sample = 'out' AND days = 20 GROUP BY variant)
"""
_TABLE = _ST["strategy_table"]
_FIGURES = ("win_rate", "avg_excess", "median_excess", "avg_return", "mdd")
_RULESET = f"""
SELECT 'ratesWithinUnit' AS rule, COALESCE(win_rate BETWEEN 0 AND 1, TRUE) AND COALESCE(relaxed_share BETWEEN 0 AND 1, TRUE) AS ok FROM t
UNION ALL SELECT 'fallsWithinUnit', COALESCE(mdd BETWEEN 0 AND 1, TRUE) FROM t
UNION ALL SELECT 'emptyMeansNull', ({' OR '.join(f'{c} IS NULL' for c in _FIGURES)}) = (signals = 0) FROM t
UNION ALL SELECT 'normalIsNotRelaxed', quality <> 'normal' OR COALESCE(relaxed_share, 0) = 0 FROM t
UNION ALL SELECT 'qualitiesAddUp', SUM(CASE WHEN quality = 'all' THEN signals ELSE -signals END) = 0 FROM t GROUP BY strategy, sample, basis, days
UNION ALL SELECT 'topIsPartOfAll', SUM(CASE WHEN basis = 'top5' THEN signals ELSE -signals END) <= 0 FROM t GROUP BY strategy, sample, quality, days
"""


def _fixed(x: str, digits: int) -> str:
    return f"CAST(CAST({_r(x, digits)} AS DECIMAL(18, {digits})) AS VARCHAR)"


def _of(n: int, c: str) -> str:
    return f"MAX(CASE WHEN days = {n} THEN {c} END) AS {c}_{n}"


SQL: dict[str, str] = {
    "template_breakdown": _sql([*_CROSS, EXITS, _X3], "SELECT eval_date, ticker, missing, x3, CASE WHEN full_year THEN x3 AND NOT (t1 AND t5) END AS x3_strong FROM s3"),
    "exit_signal_bundle": _sql(
        [*_CROSS, EXITS, _X3],
        f"SELECT eval_date, ticker, CONCAT_WS(',', {_CODES}) AS codes, CAST({' + '.join(f'COALESCE(x{k}, FALSE)::INT' for k in range(1, 6))} AS BIGINT) AS fired, CAST({' + '.join(f'(x{k} IS NOT NULL)::INT' for k in range(1, 6))} AS BIGINT) AS judged FROM s3",
    ),
    "exit_evidence": _sql(
        [*_CROSS, EXITS, _X3, "xw AS (SELECT xd.ticker, xd.idx, xd.low_ret, b.date AS low_date FROM xd JOIN bars b ON b.ticker = xd.ticker AND b.idx = xd.low_at)"],
        " UNION ALL ".join(
            f"SELECT eval_date, ticker, '{code}' AS code, {strength} AS strength, {text} AS evidence FROM s3 {join} WHERE {code.lower()}"
            for code, strength, text, join in (
                ("X1", "CASE WHEN x1_strong THEN '강' ELSE '중' END", f"'50일선 이탈 (종가 ' || {_fixed('close', 2)} || ' < SMA50 ' || {_fixed('sma50', 2)} || ')' || CASE WHEN x1_strong THEN ' · 거래량 동반' ELSE '' END", ""),
                ("X2", "'중'", "'EMA12가 EMA26을 하향 교차 (최근 5거래일 내)'", ""),
                ("X3", "CASE WHEN t1 AND t5 THEN '중' ELSE '강' END", "'트렌드 템플릿 ' || missing || '개 조건 미충족 (' || CONCAT_WS(', ', " + ", ".join(f"CASE WHEN NOT t{k} THEN 'T{k}' END" for k in range(1, 9)) + ") || ')'", ""),
                ("X4", "'정보'", f"'10거래일 수익률 +' || {_fixed('ret10', 1)} || '% · SMA50 이격 +' || {_fixed('(close - sma50) / sma50 * 100', 1)} || '% — 단기 급등(클라이맥스 런) 패턴 감지'", ""),
                ("X5", "'경고'", f"'돌파 후 최대 낙폭일(' || low_date || ', ' || {_fixed('low_ret * 100', 1)} || '%)이 최근 5거래일 내 + 거래량 동반'", "JOIN xw USING (ticker, idx)"),
            )
        ),
    ),
    "universe_stats": _sql([BARS], f"SELECT COUNT(*) AS tickers, COUNT(*) FILTER (WHERE n < 252) AS short_history, {_r('COUNT(*) FILTER (WHERE n < 252) / NULLIF(COUNT(*), 0)', 4)} AS short_ratio FROM (SELECT COUNT(*) AS n FROM bars GROUP BY ticker) WHERE n >= 110"),
    "effective_samples": f"SELECT strategy, sample, basis, days, signals, {_r('days / 5.0::DOUBLE', 4)} AS overlap_factor, {_r('signals / (days / 5.0::DOUBLE)', 4)} AS effective FROM ({_TABLE}) WHERE quality = 'all'",
    "current_regime": _sql([*_DAILY, oracle.CALENDAR, REGIME], f"SELECT date, {_r('breadth')} AS breadth, regime, transition_date FROM reg WHERE breadth IS NOT NULL ORDER BY date DESC LIMIT 1"),
    "simulation_window": _sql(
        [BARS],
        f"""SELECT ticker, idx, anchor_close, period_high, period_low, {_r('(close / anchor_close - 1) * 100')} AS return_pct FROM (SELECT ticker, idx, close, LAG(close, 62) OVER w AS anchor_close,
        CASE WHEN idx >= 62 THEN MAX(high) OVER (w ROWS 62 PRECEDING) END AS period_high, CASE WHEN idx >= 62 THEN MIN(low) OVER (w ROWS 62 PRECEDING) END AS period_low FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY idx))""",
    ),
    "derived_prices": _sql(_DAILY, f"SELECT ticker, idx, {_r('pvt * (1 + 0.003::DOUBLE)')} AS trigger, {_r('pvt * (1 + 0.05::DOUBLE)')} AS upper, {_r('pvt * (1 - 0.1::DOUBLE)')} AS far_band, {_r('close * (1 - 0.08::DOUBLE)')} AS stop_fixed, {_r('close - 2.5 * atr14')} AS stop_atr FROM f WHERE pvt IS NOT NULL"),
    "exit_deltas": f"""SELECT rule, signals, base_signals, {_r('avg_excess - base_avg_excess', 4)} AS avg_excess_delta, {_r('win_rate - base_win_rate', 4)} AS win_rate_delta FROM (
      SELECT rule, signals, avg_excess, win_rate FROM ({_BT['exit_variants']}) UNION ALL SELECT 'exit_climax_partial', COUNT(*), {_r('AVG(excess)', 4)}, {_r('AVG((excess > 0)::INT)', 4)} FROM ({_PARTIAL}) HAVING COUNT(*) > 0) CROSS JOIN {_BASE}""",
    "exit_regime_baseline": f"""SELECT c.*, b.signals AS base_signals, b.win_rate AS base_win_rate, b.avg_excess AS base_avg_excess, b.median_excess AS base_median_excess, b.mdd AS base_mdd FROM (
      {_cells({"rule": (*_RULES, "exit_climax_partial"), "regime": REGIMES}, f"SELECT rule, regime, signals, win_rate, avg_excess, median_excess, mdd, stop_rate, avg_days FROM ({_BT['exit_regime_detail']}) UNION ALL {_PARTIAL_BY_REGIME}")}) c
      JOIN (SELECT * FROM ({_ST['regime_axis']}) WHERE strategy = 'trend' AND sample = 'out' AND basis = 'top5' AND days = 60) b USING (regime)""",
    "climax_comparison": f"""SELECT 'noExit' AS arm, base_signals AS signals, base_avg_excess AS avg_excess, base_median_excess AS median_excess FROM {_BASE}
      UNION ALL SELECT 'fullClimaxExit', signals, avg_excess, median_excess FROM ({_BT['exit_variants']}) WHERE rule = 'exit_climax'
      UNION ALL SELECT 'partialClimaxExit', COUNT(*), {_r('AVG(excess)', 4)}, {_r('MEDIAN(excess)', 4)} FROM ({_BT['climax_partial']})""",
    "hurdle_intersection": _sql(
        [*_PERF, _HISTORY, "a2 AS (SELECT t.eval_date, t.ticker, h.verdict FROM (SELECT * FROM sig WHERE strategy = 'consensus_2star') t ASOF LEFT JOIN hs h ON h.ticker = t.ticker AND t.eval_date >= h.as_of)"],
        _cells(
            {"sample": SAMPLES, "regime": REGIMES, "hurdle": ("pass", "partial", "partialOrBetter", "fail"), "days": HORIZONS},
            _summary("sample, regime, hurdle, days", "(SELECT pr.*, UNNEST(CASE WHEN verdict = 'fail' THEN ['fail'] ELSE [verdict, 'partialOrBetter'] END) AS hurdle FROM pr JOIN a2 USING (eval_date, ticker) WHERE strategy = 'consensus_2star' AND regime IS NOT NULL AND verdict IN ('pass', 'partial', 'fail'))"),
        ),
    ),
    "variant_evaluation": _sql(
        [*_PERF, _VARIANTS],
        f"""SELECT *, signals >= 100 AND base_signals >= 100 AS sufficient_sample, signals >= 100 AND base_signals >= 100 AND COALESCE(excess_delta > 0 AND win_rate_delta > 0, FALSE) AS meets_criteria FROM (
        SELECT variant, COALESCE(p.signals, 0) AS signals, COALESCE(b.signals, 0) AS base_signals, {_r('p.e - b.e', 4)} AS excess_delta, {_r('p.w - b.w', 4)} AS win_rate_delta
        FROM (SELECT UNNEST(['disparity_inverted_u', 'adx_gate', 'consensus_weighted']) AS variant) n LEFT JOIN vp p USING (variant) LEFT JOIN vbase b USING (variant))""",
    ),
    "consensus_weight_grid": _sql(
        [*_ALL, _VARIANTS.split("uc AS (")[0].split("tr3 WHERE signal AND COALESCE(adx14, 0) >= 20),")[1].strip().rstrip(",")],
        f"""SELECT w AS trend_weight, eval_date, ticker, stars, pct, ROW_NUMBER() OVER (PARTITION BY w, eval_date ORDER BY stars DESC, pct DESC, ra NULLS LAST, rb) AS rank FROM (
        SELECT w, COALESCE(a.eval_date, b.eval_date) AS eval_date, COALESCE(a.ticker, b.ticker) AS ticker, a.rank AS ra, b.rank AS rb, CASE WHEN a.ticker IS NOT NULL AND b.ticker IS NOT NULL THEN 2 ELSE 1 END AS stars,
        {_r('COALESCE(a.pct * w + b.pct * (1 - w), a.pct, b.pct)', 8)} AS pct FROM ua a FULL JOIN ub b ON a.eval_date = b.eval_date AND a.ticker = b.ticker CROSS JOIN (SELECT UNNEST([0.5::DOUBLE, 0.6::DOUBLE, 0.4::DOUBLE]) AS w))""",
    ),
    "portfolio_weights": _sql([*_CROSS, _trend("default")], f"SELECT eval_date, ticker, {_r('score / NULLIF(SUM(score) OVER (PARTITION BY eval_date), 0)')} AS weight FROM trend"),
    "sparkline_points": _sql([BARS], f"SELECT ticker, idx, {_r('COALESCE((close - lo) / NULLIF(hi - lo, 0), 0.5)')} AS y FROM (SELECT *, MIN(close) OVER (PARTITION BY ticker) AS lo, MAX(close) OVER (PARTITION BY ticker) AS hi FROM (SELECT * FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY idx DESC) <= 63))"),
    "confidence_summary": f"""SELECT *, signals_20 = 0 OR win_rate_20 IS NULL OR avg_excess_20 IS NULL AS insufficient_20, signals_60 = 0 OR win_rate_60 IS NULL OR avg_excess_60 IS NULL AS insufficient_60, {_r('signals_60 / 12.0::DOUBLE', 4)} AS effective_60 FROM (
      SELECT CASE strategy WHEN 'consensus_2star' THEN 'consensus' ELSE strategy END AS mode, {', '.join(_of(n, c) for n in (20, 60) for c in ('signals', 'win_rate', 'avg_excess'))}
      FROM ({_TABLE}) WHERE sample = 'out' AND basis = 'top5' AND quality = 'all' AND strategy <> 'consensus_1star' GROUP BY ALL)""",
    "regime_badges": f"SELECT regime, signals, signals >= 50 AS sufficient, CASE WHEN signals >= 50 THEN win_rate END AS win_rate, CASE WHEN signals >= 50 THEN avg_excess END AS avg_excess FROM ({_ST['regime_axis']}) WHERE strategy = 'consensus_2star' AND sample = 'out' AND basis = 'allSignals' AND days = 20",
    "result_invariants": f"WITH t AS ({_TABLE}) SELECT rule, COUNT(*) AS checked, COUNT(*) FILTER (WHERE NOT ok) AS broken FROM ({_RULESET}) GROUP BY rule",
    "trend_recommend_custom": _sql([*_CROSS, _TREND_CUSTOM], "SELECT * FROM trend"),
    "universe_file": _sql([BARS], "SELECT ticker, sector, idx, date, open, high, low, close, volume FROM bars"),
    "constituents": _sql([_LINES], f"SELECT t AS ticker, CASE WHEN name = '' THEN t ELSE name END AS name, CASE WHEN sector = '' THEN 'Unknown' ELSE sector END AS sector FROM (SELECT *, {_TICKER} AS t FROM ln) WHERE t <> '' AND COALESCE(exchange, '') <> 'NYSE ARCA' QUALIFY ROW_NUMBER() OVER (PARTITION BY t ORDER BY line) = 1"),
    "excluded_lines": _sql([_LINES], "SELECT TRIM(ticker) AS ticker, 'other exchange: NYSE ARCA' AS reason FROM ln WHERE ticker IS NOT NULL AND exchange = 'NYSE ARCA'"),
    "cleaned_bars": _sql([BARS, _FRAME], "SELECT ticker, date, open, high, low, close, volume FROM fq JOIN lg USING (ticker) WHERE whole AND bars >= 200"),
    "cleaning_log": _sql([BARS, _FRAME], "SELECT ticker, bars, dropped, CASE WHEN bars = 0 THEN 'no data' WHEN bars < 200 THEN 'fewer than 200 bars: ' || bars || ', and ' || dropped || ' dropped' END AS reason FROM lg"),
    "ticker_admission": _sql(
        [BARS, _LINES, "asked AS (SELECT DISTINCT UPPER(x) AS ticker FROM (SELECT UNNEST([" + _TICKER + ", name]) AS x FROM ln) WHERE x IS NOT NULL)", "kn AS (SELECT ticker, COUNT(*) AS n FROM bars GROUP BY ticker)"],
        "SELECT ticker, COALESCE(n >= 110, FALSE) AS accepted, CASE WHEN n IS NULL THEN 'not in the universe' WHEN n < 110 THEN 'fewer than 110 bars' END AS reason FROM asked LEFT JOIN kn USING (ticker)",
    ),
}
