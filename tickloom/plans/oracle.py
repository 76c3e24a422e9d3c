"""The same queries as SQL, for checking results in another engine.

Thresholds, presets and lists of columns are taken from the code under test, and recursive averages use a closed form
that holds for the few thousand bars of the test tables; the tests follow longer series bar by bar instead.
"""

from __future__ import annotations

from tickloom.config import BASES, HORIZONS, PRESETS, QUALITIES, REGIMES, SAMPLES, STRATEGIES
from tickloom.plans.queries import DIGITS, INDICATORS

BARS = """
agg AS (
  SELECT n.n_name AS ticker, CAST(n.n_nationkey AS BIGINT) AS pos, r.r_name AS sector, CAST(l.l_shipdate AS DATE) AS dt,
         CAST(SUM(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS volume
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL),
walk AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS BIGINT) AS idx,
         CAST(SUM(((cents % 401) - 200) * (1 + pos % 3) + (pos * 7) % 13 - 4) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS lp FROM agg),
px AS (SELECT *, FLOOR(100 * EXP(lp / 10000) * 1e4 + 0.5::DOUBLE) / 1e4 AS close FROM walk),
op AS (SELECT *, COALESCE(LAG(close) OVER (PARTITION BY ticker ORDER BY dt), close) AS open FROM px),
bars AS (SELECT ticker, sector, pos, dt AS date, idx, open,
  FLOOR(GREATEST(open, close) * (1 + CAST(cents % 97 AS DOUBLE) / 10000) * 1e4 + 0.5::DOUBLE) / 1e4 AS high,
  FLOOR(LEAST(open, close) * (1 - CAST(cents % 89 AS DOUBLE) / 10000) * 1e4 + 0.5::DOUBLE) / 1e4 AS low, close, volume FROM op)
"""

QUARTERS = """
o AS (SELECT n.n_name AS ticker, n.n_nationkey AS nk, CAST(EXTRACT(YEAR FROM o.o_orderdate) * 4 + EXTRACT(QUARTER FROM o.o_orderdate) - 1 AS BIGINT) AS qn,
             CAST(ROUND(o.o_totalprice * 100) AS BIGINT) AS cents, o.o_orderstatus AS st
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderdate < TIMESTAMP '2001-07-01 00:00:00'),
q AS (SELECT ticker, nk, qn, CAST(SUM(cents) AS DOUBLE) AS rc, CAST(COUNT(*) AS DOUBLE) AS cnt, CAST(SUM(CASE WHEN st = 'F' THEN cents ELSE 0 END) AS DOUBLE) AS fc,
             ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY qn DESC) AS rn FROM o GROUP BY ticker, nk, qn),
quarters AS (SELECT ticker, CAST(rn AS BIGINT) AS rn, qn,
       CASE WHEN nk % 11 <> 7 THEN FLOOR(rc / cnt / 100 * 1e4 + 0.5::DOUBLE) / 1e4 END AS eps, rc / 100 AS revenue,
       FLOOR(fc / rc * 1e4 + 0.5::DOUBLE) / 1e4 AS operating_margin, CASE WHEN nk % 11 <> 7 THEN CAST((nk * 37) % 40 AS DOUBLE) / 100 END AS roe FROM q WHERE rn <= 5)
"""


#: Reserved words in SQL.
_PIVOT, _LEADING = '"pivot"', '"leading"'


def _r(x: str, digits: int = 6) -> str:
    return f"FLOOR(({x}) * 1e{digits} + 0.5::DOUBLE) / 1e{digits}"


def _smooth(x: str, n: int, first: int, alpha: str) -> str:
    s, q = first + n - 1, f"(1 - {alpha})"
    return f"""CASE WHEN idx >= {s} THEN POWER({q}, idx - {s}) * (SUM(CASE WHEN idx BETWEEN {first} AND {s} THEN ({x}) / {n} END) OVER t
      + COALESCE(SUM(CASE WHEN idx > {s} THEN {alpha} * ({x}) * POWER({q}, -(idx - {s})) END) OVER u, 0)) END"""


def _ema(x: str, n: int, first: int = 0) -> str:
    return _smooth(x, n, first, f"(2::DOUBLE / {n + 1})")


def _wilder(x: str, n: int, first: int) -> str:
    return _smooth(x, n, first, f"(1::DOUBLE / {n})")


def _over(fn: str, n: int, back: int = 0) -> str:
    end = f"{back} PRECEDING" if back else "CURRENT ROW"
    return f"{fn} OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN {n - 1 + back} PRECEDING AND {end})"


def _g(n: int, x: str) -> str:
    return f"CASE WHEN idx >= {n - 1} THEN {x} END"


_W = " WINDOW t AS (PARTITION BY ticker), w AS (PARTITION BY ticker ORDER BY idx), u AS (PARTITION BY ticker ORDER BY idx ROWS UNBOUNDED PRECEDING)"
_RANGE14 = f"({_over('MAX(high)', 14)} - {_over('MIN(low)', 14)})"


def _ratio(col: str, n: int, prior: int) -> str:
    a, b = _over(f"AVG({col})", n), _over(f"AVG({col})", prior, n)
    return _g(n + prior, f"({a} - {b}) / NULLIF({b}, 0) * 100")


FEATURES = f"""
f0 AS (SELECT *, LAG(close) OVER w AS pc, LAG(high) OVER w AS phi, LAG(low) OVER w AS plo FROM bars{_W}),
f1 AS (SELECT *, (close - pc) / pc AS ret, close - pc AS diff, CASE WHEN idx > 0 THEN GREATEST(high - low, ABS(high - pc), ABS(low - pc)) END AS tr,
  CASE WHEN idx > 0 THEN CASE WHEN high - phi > plo - low AND high > phi THEN high - phi ELSE 0 END END AS pdm,
  CASE WHEN idx > 0 THEN CASE WHEN plo - low > high - phi AND plo > low THEN plo - low ELSE 0 END END AS mdm,
  {", ".join(f"{_g(n, _over('AVG(close)', n))} AS sma{n}" for n in (20, 50, 150, 200))}, {_g(50, _over('AVG(volume)', 50))} AS vsma50,
  {_ratio('volume', 5, 20)} AS vol_trend, {_ratio('volume', 5, 50)} AS dryup, {_ema('close', 12)} AS ema12, {_ema('close', 26)} AS ema26,
  {_g(252, _over('MAX(high)', 252))} AS w52_high, {_g(252, _over('MIN(low)', 252))} AS w52_low,
  {_g(63, f"({_over('MAX(close)', 63)} - close) / NULLIF({_over('MAX(close)', 63)}, 0) * 100")} AS proximity,
  {_g(252, "2 * ((close / LAG(close, 62) OVER w - 1) * 100) + (close / LAG(close, 125) OVER w - 1) * 100 + (close / LAG(close, 251) OVER w - 1) * 100")} AS rs_raw,
  {_g(63, "(close / LAG(close, 62) OVER w - 1) * 100")} AS sim_return,
  {_g(14, f"(close - {_over('MIN(low)', 14)}) / NULLIF({_RANGE14}, 0) * 100")} AS fast_k,
  CASE WHEN idx >= 63 THEN {_over('MAX(close)', 63, 1)} END AS high63, CASE WHEN idx >= 10 THEN (close / LAG(close, 10) OVER w - 1) * 100 END AS ret10,
  {_g(20, _over('STDDEV_SAMP(close)', 20))} AS boll_sd FROM f0{_W}),
f2 AS (SELECT *, ema12 - ema26 AS macd_line, {_wilder('GREATEST(diff, 0)', 14, 1)} AS gain14, {_wilder('GREATEST(-diff, 0)', 14, 1)} AS loss14,
  {_wilder('tr', 14, 1)} AS atr14, {_wilder('pdm', 14, 1)} AS pdm14, {_wilder('mdm', 14, 1)} AS mdm14, (close - sma20) / NULLIF(sma20, 0) * 100 AS disparity,
  {_g(63, _over('STDDEV_SAMP(ret)', 62))} AS volatility, CASE WHEN idx >= 50 THEN {_over('STDDEV_SAMP(ret)', 10)} / NULLIF({_over('STDDEV_SAMP(ret)', 40, 10)}, 0) END AS contraction,
  CAST(SUM(COALESCE(CAST(SIGN(diff) AS BIGINT) * volume, 0)) OVER u AS BIGINT) AS obv, CASE WHEN {_over('COUNT(fast_k)', 3)} = 3 THEN {_over('AVG(fast_k)', 3)} END AS slow_k,
  sma20 + 2 * boll_sd AS boll_upper, sma20 - 2 * boll_sd AS boll_lower, COALESCE(idx >= 64 AND close > high63 AND pc <= LAG(high63) OVER w, FALSE) AS breakout FROM f1{_W}),
f3 AS (SELECT *, {_ema('macd_line', 9, 25)} AS signal_line, CASE WHEN idx >= 14 THEN CASE WHEN loss14 = 0 THEN 100 ELSE 100 - 100 / (1 + gain14 / loss14) END END AS rsi14,
  atr14 / NULLIF(close, 0) * 100 AS atr_pct,
  CASE WHEN idx >= 14 THEN CASE WHEN atr14 = 0 OR pdm14 + mdm14 = 0 THEN 0 ELSE ABS(pdm14 / atr14 * 100 - mdm14 / atr14 * 100) / (pdm14 / atr14 * 100 + mdm14 / atr14 * 100) * 100 END END AS dx,
  CASE WHEN {_over('COUNT(slow_k)', 3)} = 3 THEN {_over('AVG(slow_k)', 3)} END AS slow_d,
  idx - MAX(CASE WHEN breakout THEN idx END) OVER u AS since_breakout, LAST_VALUE(CASE WHEN breakout THEN high63 END IGNORE NULLS) OVER u AS last_high,
  LAST_VALUE(CASE WHEN breakout THEN COALESCE(volume >= 1.5 * vsma50, FALSE) END IGNORE NULLS) OVER u AS breakout_volume_ok,
  SUM(CASE WHEN breakout THEN 1 ELSE 0 END) OVER u AS segment FROM f2{_W}),
f4 AS (SELECT *, CASE WHEN idx >= 28 THEN {_wilder('dx', 14, 14)} END AS adx14,
  COALESCE(LAG(macd_line) OVER w <= LAG(signal_line) OVER w AND macd_line > signal_line, FALSE) AS gold,
  COALESCE(LAG(ema26) OVER w <= LAG(ema12) OVER w AND ema26 > ema12, FALSE) AS dead FROM f3{_W}),
f AS (SELECT *, idx - MAX(CASE WHEN gold THEN idx END) OVER u AS since_cross, idx - MAX(CASE WHEN dead THEN idx END) OVER u AS since_dead_cross,
  LAG(sma200, 22) OVER w AS sma200_prior,
  CASE WHEN idx >= 63 THEN CASE WHEN close <= high63 THEN high63 WHEN since_breakout <= 21 THEN last_high END END AS pvt FROM f4{_W})
"""

STATE = """
st AS (SELECT *, CASE WHEN idx < 63 THEN 'undetermined' WHEN pvt IS NULL THEN '3' WHEN close <= high63 THEN CASE WHEN close < pvt * (1 - 0.10::DOUBLE) THEN '0' ELSE '1' END
  WHEN close <= pvt * (1 + 0.05::DOUBLE) THEN '2' ELSE '3' END AS state FROM f)
"""

EXITS = """
xa AS (SELECT *, segment > 0 AND since_breakout > 0 AS after, COALESCE(volume >= 1.5 * vsma50, FALSE) AS loud FROM f),
xb AS (SELECT *, MIN(CASE WHEN after THEN ret END) OVER (PARTITION BY ticker, segment ORDER BY idx ROWS UNBOUNDED PRECEDING) AS low_ret FROM xa),
xc AS (SELECT *, CASE WHEN after AND ret = low_ret AND (LAG(CASE WHEN after THEN low_ret END) OVER (PARTITION BY ticker, segment ORDER BY idx) IS NULL
    OR ret < LAG(low_ret) OVER (PARTITION BY ticker, segment ORDER BY idx)) THEN idx END AS new_low FROM xb),
xd AS (SELECT *, MAX(new_low) OVER (PARTITION BY ticker, segment ORDER BY idx ROWS UNBOUNDED PRECEDING) AS low_at,
    LAST_VALUE(CASE WHEN new_low IS NOT NULL THEN loud END IGNORE NULLS) OVER (PARTITION BY ticker, segment ORDER BY idx ROWS UNBOUNDED PRECEDING) AS low_loud FROM xc),
ex AS (SELECT ticker, idx, close < sma50 AS x1, close < sma50 AND volume >= 1.5 * vsma50 AS x1_strong,
  CASE WHEN ema26 IS NOT NULL THEN COALESCE(since_dead_cross < 5, FALSE) END AS x2,
  CASE WHEN sma50 IS NOT NULL THEN ret10 >= 25 AND (close - sma50) / sma50 * 100 >= 25 END AS x4, CASE WHEN after THEN idx - low_at <= 4 AND low_loud END AS x5 FROM xd)
"""

CALENDAR = """
cal AS (SELECT date, idx AS n FROM bars WHERE ticker = (SELECT ticker FROM bars GROUP BY ticker, pos ORDER BY COUNT(*) DESC, pos LIMIT 1)),
grid AS (SELECT date AS eval_date FROM cal WHERE n >= 252 AND n < (SELECT COUNT(*) FROM cal) - 120 AND (n - 252) % 5 = 0)
"""

SNAPSHOT = """
nx AS (SELECT *, LEAD(date) OVER (PARTITION BY ticker ORDER BY idx) AS next_date FROM f),
sn AS (SELECT nx.*, eval_date, idx + 1 >= 110 AS sufficient, idx + 1 >= 252 AS full_year FROM nx JOIN grid ON eval_date >= date AND (next_date IS NULL OR eval_date < next_date)),
s1 AS (SELECT *, CASE WHEN full_year THEN CUME_DIST() OVER (PARTITION BY eval_date, full_year ORDER BY rs_raw) * 100 END AS rs_pct FROM sn),
s2 AS (SELECT *, CASE WHEN full_year THEN COALESCE(close > sma150 AND close > sma200, FALSE) END AS t1, CASE WHEN full_year THEN COALESCE(sma150 > sma200, FALSE) END AS t2,
  CASE WHEN full_year THEN COALESCE(sma200 > sma200_prior, FALSE) END AS t3, CASE WHEN full_year THEN COALESCE(sma50 > sma150 AND sma150 > sma200, FALSE) END AS t4,
  CASE WHEN full_year THEN COALESCE(close > sma50, FALSE) END AS t5, CASE WHEN full_year THEN close >= w52_low * 1.3::DOUBLE END AS t6,
  CASE WHEN full_year THEN close >= w52_high * 0.75::DOUBLE END AS t7, CASE WHEN full_year THEN rs_pct >= 70 END AS t8 FROM s1),
s AS (SELECT *, CAST(t1::INT + t2::INT + t3::INT + t4::INT + t5::INT + t6::INT + t7::INT + t8::INT AS BIGINT) AS n_passed FROM s2),
sec0 AS (SELECT eval_date, sector, AVG(sim_return) AS avg_return, COUNT(*) AS members, MIN(pos) AS first FROM s WHERE sufficient GROUP BY ALL HAVING COUNT(*) >= 2),
sec AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY FLOOR(avg_return * 1e8 + 0.5::DOUBLE) DESC, first) <= 3 AS lead3 FROM sec0)
"""

REGIME = """
br AS (SELECT c.n, c.date, AVG(CASE WHEN close > sma200 THEN 1.0::DOUBLE WHEN sma200 IS NOT NULL THEN 0.0::DOUBLE END) AS v
  FROM cal c LEFT JOIN (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY ticker) AS k FROM f) WHERE k >= 110) x ON x.date = c.date GROUP BY c.n, c.date),
hy AS (
  SELECT n, date, v, CAST(CASE WHEN v IS NULL THEN NULL WHEN v >= 0.55 THEN 'up' WHEN v < 0.40 THEN 'down' ELSE 'neutral' END AS VARCHAR) AS st,
         CASE WHEN v IS NOT NULL THEN date END AS since FROM br WHERE n = 0
  UNION ALL
  SELECT n, date, v, nst, CASE WHEN nst IS NOT DISTINCT FROM st THEN since ELSE date END FROM (
    SELECT b.n, b.date, b.v, h.st, h.since, CASE WHEN b.v IS NULL THEN h.st
      WHEN h.st IS NULL THEN CASE WHEN b.v >= 0.55 THEN 'up' WHEN b.v < 0.40 THEN 'down' ELSE 'neutral' END
      WHEN h.st = 'up' AND b.v < 0.55 THEN 'neutral' WHEN h.st = 'neutral' AND b.v > 0.65 THEN 'up'
      WHEN h.st = 'neutral' AND b.v < 0.40 THEN 'down' WHEN h.st = 'down' AND b.v > 0.50 THEN 'neutral' ELSE h.st END AS nst
    FROM hy h JOIN br b ON b.n = h.n + 1)),
reg AS (SELECT date, v AS breadth, CASE WHEN v IS NOT NULL THEN st END AS regime, CASE WHEN v IS NOT NULL THEN since END AS transition_date FROM hy)
"""


def _trend(preset: str) -> str:
    p = PRESETS[preset]
    return f"""
tr0 AS (SELECT s.*, {_r("GREATEST(0, LEAST(COALESCE(disparity, 0), 15)) / 15::DOUBLE * 60 + GREATEST(0, LEAST(COALESCE(vol_trend, 0), 50)) / 50::DOUBLE * 30 + CASE WHEN COALESCE(lead3, FALSE) THEN 10 ELSE 0 END", 1)} AS score,
  rsi14 >= {p.rsi_min} AND macd_line > 0 AS base FROM s LEFT JOIN sec USING (eval_date, sector) WHERE sufficient),
tr1 AS (SELECT *, base AND COALESCE(since_cross < {p.cross_window}, FALSE) AS p0, base AND COALESCE(since_cross < {p.relaxed_window}, FALSE) AS p1 FROM tr0),
tr2 AS (SELECT *, CASE WHEN SUM(p0::INT) OVER (PARTITION BY eval_date) >= 5 THEN 'strict' WHEN SUM(p1::INT) OVER (PARTITION BY eval_date) >= 5 THEN 'relaxed10d' ELSE 'rsiMacdOnly' END AS level FROM tr1),
tr3 AS (SELECT *, CASE level WHEN 'strict' THEN p0 WHEN 'relaxed10d' THEN p1 ELSE base END AS signal FROM tr2),
tr4 AS (SELECT eval_date, ticker, sector, pos, score, signal, level, ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY score DESC, signal DESC, pos) AS rank FROM tr3 WHERE signal OR score >= {p.high_score}),
trend AS (SELECT * FROM tr4 WHERE rank <= 10)
"""


_VCP = _r(
    "GREATEST(0, LEAST(1, (COALESCE(rs_pct, 0) - 70) / 30)) * 40 + CASE WHEN contraction IS NULL THEN 0 ELSE GREATEST(0, LEAST(1, (1 - LEAST(contraction, 1)) / 0.5::DOUBLE)) * 25 END"
    " + CASE WHEN dryup IS NULL OR dryup > 0 THEN 0 ELSE LEAST(ABS(dryup), 30) / 30::DOUBLE * 15 END + CASE WHEN proximity IS NULL THEN 0 ELSE GREATEST(0, (10 - LEAST(proximity, 10)) / 10::DOUBLE) * 20 END",
    1,
)
TEMPLATE = f"""
te0 AS (SELECT *, SUM((n_passed = 8)::INT) OVER (PARTITION BY eval_date) >= 5 AS strict FROM s WHERE full_year),
template AS (SELECT eval_date, ticker, sector, pos, {_VCP} AS score, CASE WHEN strict THEN 'strict' ELSE 'relaxed7of8' END AS level,
  ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY {_VCP} DESC, pos) AS rank FROM te0 WHERE n_passed >= CASE WHEN strict THEN 8 ELSE 7 END)
"""
LISTS = """
tg AS (SELECT t.*, regime FROM trend t LEFT JOIN reg ON eval_date = date WHERE NOT (COALESCE(regime, '') = 'down' AND level <> 'strict')),
mg AS (SELECT t.*, regime FROM template t LEFT JOIN reg ON eval_date = date WHERE NOT (COALESCE(regime, '') = 'down' AND level <> 'strict')),
ca AS (SELECT *, CUME_DIST() OVER (PARTITION BY eval_date ORDER BY score) * 100 AS pct FROM tg),
cb AS (SELECT *, CUME_DIST() OVER (PARTITION BY eval_date ORDER BY score) * 100 AS pct FROM mg),
co AS (SELECT COALESCE(ca.eval_date, cb.eval_date) AS eval_date, COALESCE(ca.ticker, cb.ticker) AS ticker, CASE WHEN ca.ticker IS NOT NULL AND cb.ticker IS NOT NULL THEN 2 ELSE 1 END AS stars,
  CASE WHEN ca.ticker IS NOT NULL AND cb.ticker IS NOT NULL THEN (ca.pct + cb.pct) / 2 ELSE COALESCE(ca.pct, cb.pct) END AS consensus_pct,
  ca.score AS trend_score, cb.score AS template_score, ca.rank AS trend_rank, cb.rank AS template_rank, COALESCE(ca.level, cb.level) <> 'strict' AS relaxed
  FROM ca FULL JOIN cb ON ca.eval_date = cb.eval_date AND ca.ticker = cb.ticker),
cr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY stars DESC, FLOOR(consensus_pct * 1e8 + 0.5::DOUBLE) DESC, trend_rank NULLS LAST, template_rank) AS rank FROM co),
sig AS (
  SELECT eval_date, ticker, 'trend' AS strategy, ROW_NUMBER() OVER (PARTITION BY eval_date ORDER BY rank) AS rank, level <> 'strict' AS relaxed FROM tg WHERE signal
  UNION ALL SELECT eval_date, ticker, 'minervini', rank, level <> 'strict' FROM mg
  UNION ALL SELECT eval_date, ticker, CASE WHEN stars = 2 THEN 'consensus_2star' ELSE 'consensus_1star' END, rank, relaxed FROM cr)
"""
FORWARD = (
    "fw AS ("
    + " UNION ALL ".join(f"SELECT * FROM (SELECT ticker, date, {h} AS days, LEAD(close, {h}) OVER (PARTITION BY ticker ORDER BY idx) / close - 1 AS ret FROM bars) WHERE ret IS NOT NULL" for h in HORIZONS)
    + "), bm AS (SELECT date, days, AVG(ret) AS bench FROM fw GROUP BY ALL), wp AS (SELECT s.eval_date, s.ticker, p.idx - e.idx AS days, p.close, MAX(p.close) OVER (PARTITION BY s.eval_date, s.ticker ORDER BY p.idx) AS peak FROM (SELECT DISTINCT eval_date, ticker FROM sig) s"
    " JOIN bars e ON e.ticker = s.ticker AND e.date = s.eval_date JOIN bars p ON p.ticker = e.ticker AND p.idx BETWEEN e.idx AND e.idx + 120),"
    " dd AS (SELECT eval_date, ticker, days, MAX((peak - close) / peak) OVER (PARTITION BY eval_date, ticker ORDER BY days) AS mdd FROM wp),"
    " pf AS (SELECT sig.*, fw.days, ret, bench, ret - bench AS excess, dd.mdd FROM sig JOIN fw ON fw.ticker = sig.ticker AND fw.date = sig.eval_date JOIN bm ON bm.date = fw.date AND bm.days = fw.days"
    " JOIN dd ON dd.ticker = sig.ticker AND dd.eval_date = sig.eval_date AND dd.days = fw.days)"
)


def _sql(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(c.strip() for c in ctes) + " " + select


def _summary(keys: str, source: str) -> str:
    return f"""SELECT {keys}, COUNT(*) AS signals, {_r('AVG((excess > 0)::INT)', 4)} AS win_rate, {_r('AVG(excess)', 4)} AS avg_excess,
      {_r('MEDIAN(excess)', 4)} AS median_excess, {_r('AVG(ret)', 4)} AS avg_return, {_r('AVG(mdd)', 4)} AS mdd FROM {source} GROUP BY ALL"""


def _cells(keys: dict[str, tuple], summary: str) -> str:
    """Every combination of the keys' values with its summary, if there is one."""
    grid = " CROSS JOIN ".join(f"(SELECT UNNEST({list(v)}) AS {k})" for k, v in keys.items())
    return f"SELECT * REPLACE (COALESCE(signals, 0) AS signals) FROM (SELECT * FROM {grid}) LEFT JOIN ({summary}) USING ({', '.join(keys)})"


_SAMPLE = "sp AS (SELECT eval_date AS split FROM (SELECT eval_date, ROW_NUMBER() OVER (ORDER BY eval_date) - 1 AS i, COUNT(*) OVER () AS n FROM grid) WHERE i = n // 2)"


def _graded(source: str) -> str:
    """source by sample, basis and quality."""
    return f"""(SELECT x.*, CASE WHEN eval_date >= split THEN 'out' ELSE 'in' END AS sample, b.basis, q.quality FROM {source} x CROSS JOIN sp
      JOIN (SELECT UNNEST(['allSignals', 'top5']) AS basis) b ON b.basis = 'allSignals' OR x.rank <= 5
      JOIN (SELECT UNNEST(['all', 'normal', 'relaxed']) AS quality) q ON q.quality = 'all' OR (q.quality = 'relaxed') = x.relaxed)"""


_DAILY = [BARS, FEATURES]
_CROSS = [*_DAILY, CALENDAR, SNAPSHOT]
_ALL = [*_CROSS, REGIME, _trend("default"), TEMPLATE, LISTS]
_MDD = f"""SELECT eval_date, ticker, days, {_r('MAX((peak - close) / peak)')} AS mdd FROM (
  SELECT t.eval_date, t.ticker, h.days, p.close, MAX(p.close) OVER (PARTITION BY t.eval_date, t.ticker, h.days ORDER BY p.idx ROWS UNBOUNDED PRECEDING) AS peak
  FROM trend t JOIN bars e ON e.ticker = t.ticker AND e.date = t.eval_date CROSS JOIN (SELECT UNNEST([{", ".join(map(str, HORIZONS))}]) AS days) h
  JOIN bars x ON x.ticker = t.ticker AND x.idx = e.idx + h.days JOIN bars p ON p.ticker = t.ticker AND p.idx BETWEEN e.idx AND e.idx + h.days) GROUP BY ALL"""

SQL: dict[str, str] = {
    "bars": _sql([BARS], "SELECT ticker, sector, date, idx, open, high, low, close, volume FROM bars"),
    "quarters": _sql([QUARTERS], "SELECT * FROM quarters"),
    **{k: _sql(_DAILY, "SELECT ticker, idx, " + ", ".join([f"{_r(c, DIGITS.get(k, 6))} AS {c}" for c in rounded] + plain) + " FROM f") for k, (rounded, plain) in INDICATORS.items()},
    "entry_state": _sql([*_DAILY, STATE], f"SELECT ticker, idx, state, {_r('pvt')} AS {_PIVOT}, {_r('pvt * (1 + 0.003::DOUBLE)')} AS trigger, {_r('pvt * (1 + 0.05::DOUBLE)')} AS upper, {_r('pvt * (1 - 0.1::DOUBLE)')} AS far_band FROM st"),
    "exit_signals": _sql([*_DAILY, EXITS], "SELECT * FROM ex"),
    "exit_signal_counts": _sql([*_DAILY, EXITS], "SELECT ticker, " + ", ".join(f"COUNT(*) FILTER (WHERE {x}) AS {x}" for x in ("x1", "x2", "x4", "x5")) + " FROM ex GROUP BY ticker"),
    "trading_calendar": _sql([BARS, CALENDAR], "SELECT date, n FROM cal"),
    "evaluation_dates": _sql([BARS, CALENDAR], "SELECT eval_date FROM grid"),
    "asof_snapshot": _sql(_CROSS, "SELECT eval_date, ticker, date, idx, close, sufficient, full_year FROM s"),
    "trend_template": _sql(_CROSS, f"SELECT eval_date, ticker, {_r('rs_pct')} AS rs_pct, t1, t2, t3, t4, t5, t6, t7, t8, n_passed FROM s"),
    "sector_returns": _sql(_CROSS, f"SELECT eval_date, sector, {_r('avg_return')} AS avg_return, members, lead3 AS {_LEADING} FROM sec"),
    "regime_series": _sql([*_DAILY, CALENDAR, REGIME], f"SELECT date, {_r('breadth')} AS breadth, regime, transition_date FROM reg"),
    **{f"trend_recommend_{p}": _sql([*_CROSS, _trend(p)], "SELECT * FROM trend") for p in PRESETS},
    "template_recommend": _sql([*_CROSS, TEMPLATE], "SELECT * FROM template"),
    "consensus_ranking": _sql(_ALL, f"SELECT eval_date, ticker, stars, {_r('consensus_pct', 4)} AS consensus_pct, trend_score, template_score FROM co"),
    "signals": _sql(_ALL, "SELECT * FROM sig"),
    "benchmark_returns": _sql([BARS, FORWARD.split(", wp AS")[0]], f"SELECT date, days, {_r('bench')} AS bench FROM bm"),
    "max_drawdown": _sql([*_CROSS, _trend("default")], _MDD),
    "strategy_table": _sql(
        [*_ALL, FORWARD, _SAMPLE],
        f"""SELECT c.*, rs.relaxed_share FROM ({_cells({'strategy': STRATEGIES, 'sample': SAMPLES, 'basis': BASES, 'quality': QUALITIES, 'days': HORIZONS}, _summary('strategy, sample, basis, quality, days', _graded('pf')))}) c
        LEFT JOIN (SELECT strategy, sample, basis, quality, {_r('AVG(relaxed::INT)', 4)} AS relaxed_share FROM {_graded('sig')} GROUP BY ALL) rs USING (strategy, sample, basis, quality)""",
    ),
    "regime_axis": _sql(
        [*_ALL, FORWARD, _SAMPLE],
        _cells(
            {"strategy": STRATEGIES, "sample": SAMPLES, "basis": BASES, "regime": REGIMES, "days": HORIZONS},
            _summary("strategy, sample, basis, regime, days", f"(SELECT g.*, regime FROM {_graded('pf')} g JOIN reg ON reg.date = g.eval_date WHERE regime IS NOT NULL AND quality = 'all')"),
        ),
    ),
    "fundamental_history": _sql(
        [
            QUARTERS,
            "g AS (SELECT *, (eps - LEAD(eps) OVER w) / NULLIF(ABS(LEAD(eps) OVER w), 0) * 100 AS eg, (revenue - LEAD(revenue) OVER w) / NULLIF(ABS(LEAD(revenue) OVER w), 0) * 100 AS rg, LEAD(qn) OVER w AS prior FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY rn))",
            "y AS (SELECT a.ticker, a.eps / NULLIF(e.eps, 0) AS f1, a.revenue / NULLIF(e.revenue, 0) AS f3, a.roe AS f5 FROM quarters a LEFT JOIN quarters e ON e.ticker = a.ticker AND e.rn = 5 WHERE a.rn = 1)",
            "h AS (SELECT *, (eg IS NULL OR f1 IS NULL)::INT + (rg IS NULL OR f3 IS NULL)::INT + (f5 IS NULL)::INT AS unknown, COALESCE(eg >= 20 AND f1 IS NOT NULL, FALSE)::INT + COALESCE(rg >= 20 AND f3 IS NOT NULL, FALSE)::INT + COALESCE(f5 >= 0.17::DOUBLE, FALSE)::INT AS ok FROM g JOIN y USING (ticker) WHERE prior IS NOT NULL)",
        ],
        f"""SELECT ticker, qn, CAST(LAST_DAY(MAKE_DATE(qn // 4, (qn % 4 + 1) * 3, 1)) + 45 AS DATE) AS as_of, {_r('eg', 4)} AS eps_growth, {_r('rg', 4)} AS revenue_growth,
        CASE WHEN unknown >= 2 THEN 'insufficientFundamentals' WHEN ok = 3 THEN 'pass' WHEN ok >= 1 THEN 'partial' ELSE 'fail' END AS verdict FROM h""",
    ),
}
