"""Thresholds and presets of the screening rules (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    rsi_min: float
    cross_window: int
    relaxed_window: int
    high_score: float


PRESETS = {
    "conservative": Preset(55, 3, 6, 80),
    "default": Preset(50, 5, 10, 70),
    "aggressive": Preset(45, 10, 20, 60),
}
#: Ranges of a user's own parameters (fixed values); one out of range falls back to the default, by itself.
CUSTOM_RANGES = {"rsiMin": (30, 70), "goldenCrossWindow": (1, 20), "highScoreThreshold": (50, 95)}


def custom_preset(own: dict[str, float]) -> Preset:
    base = PRESETS["default"]
    usual = dict(zip(CUSTOM_RANGES, (base.rsi_min, base.cross_window, base.high_score)))
    rsi, window, score = (own[k] if isinstance(own.get(k), (int, float)) and low <= own[k] <= high else usual[k] for k, (low, high) in CUSTOM_RANGES.items())
    return Preset(rsi, int(window), 2 * int(window), score)


#: Keys of published results (fixed values).
STRATEGIES = ("trend", "minervini", "consensus_2star", "consensus_1star")
SAMPLES, BASES, QUALITIES, REGIMES, STATES = ("in", "out"), ("allSignals", "top5"), ("all", "normal", "relaxed"), ("up", "neutral", "down"), ("0", "1", "2", "3")
COHORTS = ("0d", "1-2d", "3-4d", "5d+", "no_recent_breakout")
MIN_BARS, SIM_WINDOW, YEAR = 110, 63, 252
MIN_RESULTS, MAX_RESULTS = 5, 10
WARMUP, BUFFER_BARS, STEP = 252, 120, 5
HORIZONS = (5, 20, 60, 90, 120)
UP_ENTER, UP_EXIT, DOWN_ENTER, DOWN_EXIT = 0.65, 0.55, 0.40, 0.50
PIVOT_LOOKBACK, BREAKOUT_RECENCY = 63, 21
BUFFER, CHASE, FAR, STOP, ATR_STOP, VOL_MULT = 0.003, 0.05, 0.10, 0.08, 2.5, 1.5
DEPTH_MIN, DEPTH_MAX, RESUME_BARS, RESUME_WINDOW, TRIGGER_WINDOW = 10.0, 25.0, 10, 30, 21
PULLBACK_STOP, PIVOT_STOP, TRAIL, HOLD = 0.98, 0.97, 0.15, 60
