"""Positions that end in legs, against a plain computation of return, benchmark and fall."""

import datetime
import math
import random

from tickloom.operators import paths

DAY = datetime.date(2020, 1, 1)
N = 80


def series() -> dict[str, list[float]]:
    out = {}
    for k, t in enumerate("abc"):
        rng, x = random.Random(k), 50.0
        out[t] = [x := round(x * math.exp(rng.gauss(0, 0.03)), 4) for _ in range(N - 10 * k)]
    return out


#: By position (ticker, bar of entry): its legs. Only the first five are valid.
LEGS = {
    ("a", 5): [],
    ("a", 10): [(3, 0.25), (20, 1 / 3)],
    ("b", 0): [(7, 0.5), (7, 0.5)],
    ("b", 4): [(1, 0.1), (2, 0.2), (5, 0.3), (30, 0.1)],
    ("c", 2): [(15, 0.5)],
    ("a", 20): [(3, 0.7), (9, 0.31)],  # more than the whole
    ("a", 21): [(0, 0.5)],  # ends at the fill
    ("b", 41): [(3, 0.5)],  # the rest leaves the data
    ("c", 25): [(36, 1.0)],  # the leg leaves the data
    ("c", 3): [(2, -0.5)],
}


def plain(x: dict[str, list[float]], ticker: str, at: int, legs: list, last: int):
    rest = 1 - sum(r for _, r in legs)
    if rest < -1e-9 or rest > 1 or any(d < 1 for d, _ in legs):
        return None
    whole = legs + ([(last, rest)] if rest > 1e-9 else [])
    c = x[ticker]
    if any(at + d >= len(c) for d, _ in whole):
        return None
    ret = sum(w * (c[at + d] / c[at] - 1) for d, w in whole)
    bench = sum(w * sum(v[at + d] / v[at] - 1 for v in x.values() if at + d < len(v)) / sum(at + d < len(v) for v in x.values()) for d, w in whole)
    curve = [sum(w * c[at + min(t, d)] / c[at] for d, w in whole) for t in range(max(d for d, _ in whole) + 1)]
    top, fall = curve[0], 0.0
    for v in curve:
        top = max(top, v)
        fall = max(fall, (top - v) / top)
    return len(whole), ret, bench, fall, sum(w * d for d, w in whole)


def test_legs(spark):
    x = series()
    bars = spark.createDataFrame([(t, DAY + datetime.timedelta(i), i, c) for t, v in x.items() for i, c in enumerate(v)], "ticker string, date date, idx long, close double")
    at = [(DAY + datetime.timedelta(i), t, i, x[t][i], "kept") for t, i in LEGS]
    filled = spark.createDataFrame(at + [(DAY, "z", None, None, "unfilled")], "eval_date date, ticker string, fill_idx long, price double, extra string")
    legs = spark.createDataFrame([(DAY + datetime.timedelta(i), t, d, r) for (t, i), own in LEGS.items() for d, r in own], "eval_date date, ticker string, days int, ratio double")
    got = paths.joined_legs(paths.with_benchmark(paths.legged(filled, bars, legs, 30), bars), "extra").collect()
    want = {(DAY + datetime.timedelta(i), t): w for (t, i), own in LEGS.items() if (w := plain(x, t, i, own, 30))}
    assert len(want) == 5 and {(r["eval_date"], r["ticker"]) for r in got} == set(want)
    for r in got:
        n, ret, bench, fall, held = want[r["eval_date"], r["ticker"]]
        assert r["n_legs"] == n and r["extra"] == "kept"
        for c, w in (("ret", ret), ("bench", bench), ("mdd", fall), ("held", held), ("excess", ret - bench)):
            assert abs(r[c] - w) < 1e-12


def test_without_any_legs_a_position_is_held(spark):
    x = series()
    bars = spark.createDataFrame([(t, DAY + datetime.timedelta(i), i, c) for t, v in x.items() for i, c in enumerate(v)], "ticker string, date date, idx long, close double")
    filled = spark.createDataFrame([(DAY, t, 0, v[0]) for t, v in x.items()], "eval_date date, ticker string, fill_idx long, price double")
    legs = spark.createDataFrame([], "eval_date date, ticker string, days int, ratio double")
    whole = {r["ticker"]: r for r in paths.with_benchmark(paths.held(filled, bars, (20,)), bars).collect()}
    got = paths.joined_legs(paths.with_benchmark(paths.legged(filled, bars, legs, 20), bars)).collect()
    assert len(got) == 3
    for r in got:
        assert all(abs(r[c] - whole[r["ticker"]][c]) < 1e-12 for c in ("ret", "excess", "mdd"))
