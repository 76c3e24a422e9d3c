"""Variants as objects: what is registered, what may be, and rankings under several weights."""

import pytest

from tickloom.operators import variants


def test_registry():
    assert {n: v.baseline for n, v in variants.VARIANTS.items()} == {"disparity_inverted_u": ("trend",), "adx_gate": ("trend",), "consensus_weighted": ("consensus_2star", "consensus_1star")}
    for bad in (variants.Variant("adx_gate", ("trend",), None), variants.Variant("new", (), None), variants.Variant("new", ("other",), None)):
        with pytest.raises(ValueError):
            variants.register(bad)
    try:
        assert variants.register(variants.Variant("own", ("minervini",), lambda x: x.template)).apply(variants.Lists(None, None, "t")) == "t"
    finally:
        variants.VARIANTS.pop("own", None)


def test_weights_change_ranks(spark):
    rows = [("2020-01-01", "a", 2, 90.0, 10.0, 1, 3), ("2020-01-01", "b", 2, 20.0, 100.0, 3, 1), ("2020-01-01", "c", 1, 99.0, None, 2, None), ("2020-01-01", "d", 1, None, 99.0, None, 2)]
    both = spark.createDataFrame(rows, "eval_date string, ticker string, stars int, a double, b double, trend_rank int, template_rank int")
    got = {}
    for r in variants.weighted_rankings(both, (0.5, 0.9)).collect():
        got.setdefault(r["trend_weight"], {})[r["rank"]] = r["ticker"]
    assert got == {0.5: {1: "b", 2: "a", 3: "c", 4: "d"}, 0.9: {1: "a", 2: "b", 3: "c", 4: "d"}}
