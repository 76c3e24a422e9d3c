"""Why a ticker is listed, in words, and whether research speaks against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import Preset
from tickloom.functions.exprs import half_up
from tickloom.operators.fundamentals import GROWTH, ROE
from tickloom.operators.screening import sector_returns

#: Phrases of published reasons (fixed values).
LEVELS = {
    "strict": "MACD 골든크로스 ({}거래일 이내)",
    "relaxed10d": "MACD 골든크로스 ({}거래일 이내, 완화 적용)",
    "rsiMacdOnly": "MACD 0선 위 (골든크로스 조건 완화 적용)",
}
LEADING, UNSIGNALLED = "주도 섹터 소속", "매수 신호 미충족 (고득점 특별 편입)"
STAGE, STRENGTH, TIGHT, NEAR = "Stage 2 추세", "RS 상위 ", "변동성 수축 중", "피벗 −"
UNKNOWN_EPS, UNKNOWN_REVENUE, UNKNOWN_ROE = "EPS 성장률 판정불가", "매출 성장률 판정불가", "ROE 판정불가"


#: How strong an exit signal is, as published (fixed values): strong, medium, information, warning.
STRONG, MEDIUM, INFORMATION, WARNING = "강", "중", "정보", "경고"


def _fixed(x: Column, digits: int) -> Column:
    return half_up(x, digits).cast(f"decimal(18,{digits})").cast("string")


def exit_evidence(s: DataFrame) -> DataFrame:
    """eval_date, ticker, code, strength, evidence of each exit signal that fires. s: the snapshot with x1 to x5 and what they rest on.

    The phrases are published (fixed values).
    """
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    strong = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), STRONG).otherwise(MEDIUM)
    loud = F.when(F.coalesce("x1_strong", F.lit(False)), " · 거래량 동반").otherwise("")
    missed = F.concat_ws(", ", *[F.when(~F.col(f"t{k}"), f"T{k}") for k in range(1, 9)])
    over = (F.col("close") - F.col("sma50")) / F.col("sma50") * 100
    found = {
        "X1": (F.col("x1"), strong("x1_strong"), text("50일선 이탈 (종가 ", _fixed(F.col("close"), 2), " < SMA50 ", _fixed(F.col("sma50"), 2), ")", loud)),
        "X2": (F.col("x2"), F.lit(MEDIUM), text("EMA12가 EMA26을 하향 교차 (최근 5거래일 내)")),
        "X3": (F.col("x3"), strong("x3_strong"), text("트렌드 템플릿 ", F.col("missing").cast("string"), "개 조건 미충족 (", missed, ")")),
        "X4": (F.col("x4"), F.lit(INFORMATION), text("10거래일 수익률 +", _fixed(F.col("ret10"), 1), "% · SMA50 이격 +", _fixed(over, 1), "% — 단기 급등(클라이맥스 런) 패턴 감지")),
        "X5": (F.col("x5"), F.lit(WARNING), text("돌파 후 최대 낙폭일(", F.col("x5_date").cast("string"), ", ", _fixed(F.col("x5_ret") * 100, 1), "%)이 최근 5거래일 내 + 거래량 동반")),
    }
    each = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(code).alias("code"), how.alias("strength"), why.alias("evidence"))) for code, (x, how, why) in found.items()]))
    return s.select("eval_date", "ticker", F.inline(each))


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("string")


def trend_reasons(listed: DataFrame, s: DataFrame, preset: Preset) -> DataFrame:
    """eval_date, ticker, reasons of the trend list; s: the snapshot that it was drawn from."""
    sectors = sector_returns(s).filter("leading").select("eval_date", "sector", F.lit(LEADING).alias("led"))
    j = listed.join(s.select("eval_date", "ticker", "rsi14"), ["eval_date", "ticker"]).join(sectors, ["eval_date", "sector"], "left")
    crossed = F.when(F.col("level") == "strict", LEVELS["strict"].format(preset.cross_window)).when(F.col("level") == "relaxed10d", LEVELS["relaxed10d"].format(preset.relaxed_window)).otherwise(LEVELS["rsiMacdOnly"])
    rsi = F.concat(F.lit("RSI "), _whole(F.coalesce("rsi14", F.lit(0.0))))
    return j.select("eval_date", "ticker", F.concat_ws(", ", rsi, F.when(F.col("signal"), crossed).otherwise(UNSIGNALLED), "led").alias("reasons"))


def template_reasons(listed: DataFrame, s: DataFrame) -> DataFrame:
    """eval_date, ticker, reasons of the template list: the parts of the score that are not 0."""
    j = listed.join(s.select("eval_date", "ticker", "rs_pct", "contraction", "proximity"), ["eval_date", "ticker"])
    strong = F.when(F.col("rs_pct") > 70, F.concat(F.lit(STRENGTH), _whole(100 - F.col("rs_pct")), F.lit("%")))
    near = F.when(F.col("proximity") < 10, F.concat(F.lit(NEAR), half_up(F.col("proximity"), 1).cast("decimal(12,1)").cast("string"), F.lit("%")))
    return j.select("eval_date", "ticker", F.concat_ws(", ", F.lit(STAGE), strong, F.when(F.col("contraction") < 1, TIGHT), near).alias("reasons"))


def fundamental_reasons(m: DataFrame) -> DataFrame:
    """ticker, reasons of fundamentals.metrics: the three measures of the hurdle, each with whether it is cleared."""

    def part(label: str, shown: Column, cleared: Column, unknown: str) -> Column:
        return F.when(cleared.isNull(), unknown).otherwise(F.concat(F.lit(f"{label} "), shown, F.when(cleared, "% ✓").otherwise("% ✗")))

    signed = lambda c: F.concat(F.when(F.col(c) >= 0, "+").otherwise("-"), _whole(F.abs(c)))
    parts = [
        part("EPS", signed("eps_yoy"), F.col("eps_yoy") >= GROWTH, UNKNOWN_EPS),
        part("매출", signed("revenue_yoy"), F.col("revenue_yoy") >= GROWTH, UNKNOWN_REVENUE),
        part("ROE", _whole(F.col("roe") * 100), F.col("roe") >= ROE, UNKNOWN_ROE),
    ]
    return m.select("ticker", F.concat_ws(", ", *parts).alias("reasons"))


def research_state(listed: DataFrame, research: DataFrame) -> DataFrame:
    """listed with state: none without research (ticker, flags, sentiment), flagged with a flag or a negative sentiment, else ok."""
    r = research.select("ticker", "flags", "sentiment", F.lit(True).alias("researched"))
    against = (F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0) | F.coalesce(F.col("sentiment") == "negative", F.lit(False))
    state = F.when(F.col("researched").isNull(), "none").when(against, "flagged").otherwise("ok")
    return listed.join(r, "ticker", "left").withColumn("state", state).drop("flags", "sentiment", "researched")
