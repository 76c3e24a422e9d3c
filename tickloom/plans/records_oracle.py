"""The queries on records as SQL, for checking results in another engine."""

from __future__ import annotations

from tickloom.plans.backtest_oracle import METRICS
from tickloom.plans.oracle import _ALL, _CROSS, BARS, QUARTERS, SQL as _ST, TEMPLATE, _r, _sql, _trend


def _round(x: str) -> str:
    return f"CAST(CAST(FLOOR(({x}) + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)"


def _mark(x: str) -> str:
    return f"CASE WHEN {x} THEN '% ✓' ELSE '% ✗' END"


def _signed(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN '+' ELSE '-' END || {_round(f'ABS({x})')}"


_CODES = "CONCAT_WS(',', CASE WHEN eps_yoy IS NULL THEN 'F1' END, CASE WHEN accelerating IS NULL THEN 'F2' END, CASE WHEN revenue_yoy IS NULL THEN 'F3' END, CASE WHEN margin_up IS NULL THEN 'F4' END, CASE WHEN roe IS NULL THEN 'F5' END)"

SQL: dict[str, str] = {
    "trend_reasons": _sql(
        [*_CROSS, _trend("default")],
        f"""SELECT t.eval_date, t.ticker, CONCAT_WS(', ', 'RSI ' || {_round('s.rsi14')}, CASE WHEN NOT signal THEN '매수 신호 미충족 (고득점 특별 편입)' WHEN level = 'strict' THEN 'MACD 골든크로스 (5거래일 이내)'
          WHEN level = 'relaxed10d' THEN 'MACD 골든크로스 (10거래일 이내, 완화 적용)' ELSE 'MACD 0선 위 (골든크로스 조건 완화 적용)' END, CASE WHEN lead3 THEN '주도 섹터 소속' END) AS reasons
        FROM trend t JOIN s ON s.eval_date = t.eval_date AND s.ticker = t.ticker LEFT JOIN sec ON sec.eval_date = t.eval_date AND sec.sector = t.sector""",
    ),
    "template_reasons": _sql(
        [*_CROSS, TEMPLATE],
        f"""SELECT t.eval_date, t.ticker, CONCAT_WS(', ', 'Stage 2 추세', CASE WHEN rs_pct > 70 THEN 'RS 상위 ' || {_round('100 - rs_pct')} || '%' END, CASE WHEN contraction < 1 THEN '변동성 수축 중' END,
          CASE WHEN proximity < 10 THEN '피벗 −' || CAST(CAST({_r('proximity', 1)} AS DECIMAL(12, 1)) AS VARCHAR) || '%' END) AS reasons FROM template t JOIN s ON s.eval_date = t.eval_date AND s.ticker = t.ticker""",
    ),
    "fundamental_reasons": _sql(
        [QUARTERS, METRICS],
        f"""SELECT ticker, CONCAT_WS(', ', COALESCE('EPS ' || {_signed('eps_yoy')} || {_mark('eps_yoy >= 20')}, 'EPS 성장률 판정불가'), COALESCE('매출 ' || {_signed('revenue_yoy')} || {_mark('revenue_yoy >= 20')}, '매출 성장률 판정불가'),
          COALESCE('ROE ' || {_round('roe * 100')} || {_mark('roe >= 0.17::DOUBLE')}, 'ROE 판정불가')) AS reasons FROM mt""",
    ),
    "fundamental_missing": _sql([QUARTERS, METRICS], f"SELECT ticker, n AS quarters, {_CODES} AS missing FROM mt JOIN (SELECT ticker, COUNT(*) AS n FROM quarters GROUP BY ticker) USING (ticker)"),
    "fundamental_errors": _sql(
        [QUARTERS, METRICS],
        f"""SELECT ticker AS id, 'roe' AS path FROM mt WHERE LENGTH(ticker) % 4 = 0 AND roe IS NOT NULL UNION ALL SELECT ticker, 'quarters[0].period' FROM mt WHERE LENGTH(ticker) % 4 = 1
        UNION ALL SELECT ticker, 'missing[' || CASE WHEN {_CODES} = '' THEN 0 ELSE LEN(STRING_SPLIT({_CODES}, ',')) END || ']' FROM mt WHERE LENGTH(ticker) % 4 = 2""",
    ),
    "research_errors": "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 1 THEN 'sentiment' WHEN 2 THEN 'sources' WHEN 3 THEN 'signalPassed' ELSE 'riskFlags[0].type' END AS path FROM supplier WHERE s_suppkey % 5 <> 0",
    "research_check": _sql(
        [*_ALL, "rc AS (SELECT n_name AS ticker, MIN(s_acctbal) < -900 OR MAX(s_acctbal) > 9900 OR AVG(s_acctbal) < 3000 AS against FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0 GROUP BY n_name)"],
        "SELECT eval_date, ticker, CASE WHEN against IS NULL THEN 'none' WHEN against THEN 'flagged' ELSE 'ok' END AS state, NOT COALESCE(against, FALSE) AS shown FROM tg LEFT JOIN rc USING (ticker) WHERE signal",
    ),
    "portfolio_rebalanced": _sql(
        [*_CROSS, _trend("default"), "rw AS (SELECT eval_date, ticker, rank, COUNT(*) OVER (PARTITION BY eval_date) AS n, MAX(CASE WHEN rank = 1 THEN GREATEST(0, LEAST(100, score * 1.5::DOUBLE)) END) OVER (PARTITION BY eval_date) AS v FROM trend)"],
        f"SELECT eval_date, ticker, {_r('100::DOUBLE / n', 1)} AS equal, CASE WHEN n = 1 THEN 100.0::DOUBLE WHEN rank = 1 THEN v ELSE {_r('(100 - v) / (n - 1)', 1)} END AS adjusted FROM rw",
    ),
    "kept_positions": _sql(
        [BARS],
        """SELECT s_suppkey AS line, n_name AS ticker, s_acctbal AS entry_price, CASE WHEN s_suppkey % 3 <> 0 THEN '2000-01-03' END AS entry_date FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE s_suppkey % 7 <> 3 AND s_acctbal > 0 AND n_name IN (SELECT ticker FROM bars)""",
    ),
    "regime_composition": f"""SELECT sample, regime, signals, {_r('signals / NULLIF(SUM(signals) OVER (PARTITION BY sample), 0)', 4)} AS share, avg_excess
      FROM ({_ST['regime_axis']}) WHERE strategy = 'trend' AND basis = 'allSignals' AND days = 20""",
}
