"""Rules that records of fundamentals and research must keep, checked on their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of what a record may lack (fixed values).
MISSING_CODES = ("F1", "F2", "F3", "F4", "F5")
#: What research may say (fixed values).
SENTIMENTS = ("positive", "neutral", "negative")
ORIGINS = ("recommended", "userRequested")
RISKS = ("earnings_imminent", "litigation", "regulatory", "guidance_cut", "other")
NUMBER, FLAG, TEXT, LIST = "(BIGINT|DOUBLE|DECIMAL|FLOAT).*", "BOOLEAN", "STRING", "ARRAY.*"
FIELDS = {"epsGrowthQoQ_yoy": NUMBER, "epsAccelerating": FLAG, "revenueGrowthQoQ_yoy": NUMBER, "marginImproving": FLAG, "roe": NUMBER}


def _at(v: Column, path: str, kind: str) -> Column:
    """Whether the value at the path is of the kind; false where it is absent."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike(f"^({kind})$"), F.lit(False))


def _text(v: Column, path: str) -> Column:
    return _at(v, path, TEXT) & (F.try_variant_get(v, path, "string") != "")


def _absent(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNull()


def _among(v: Column, path: str, names: tuple[str, ...]) -> Column:
    return _at(v, path, TEXT) & F.coalesce(F.try_variant_get(v, path, "string").isin(*names), F.lit(False))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _broken(rules: dict[str, Column], prefix: Column | None = None) -> Column:
    name = lambda k: F.lit(k) if prefix is None else F.concat(prefix, F.lit(k))
    return F.array_compact(F.array(*[F.when(~ok, name(k)) for k, ok in rules.items()]))


def fundamental_errors(records: DataFrame) -> DataFrame:
    """id, path of each value that breaks a rule, of records (id, json); an unreadable record has the path ''."""
    r = records.select("id", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    quarters, codes = _items(v, "$.quarters"), _items(v, "$.missing")
    numbers = ("eps", "revenue", "operatingMargin")
    top = {"ticker": _text(v, "$.ticker"), **{c: _at(v, f"$.{c}", f"{kind}|VOID") for c, kind in FIELDS.items()}, **{c: _at(v, f"$.{c}", LIST) for c in ("quarters", "missing")}}
    of_quarter = lambda q, i: _broken({"period": _text(q, "$.period"), **{c: _at(q, f"$.{c}", f"{NUMBER}|VOID") for c in numbers}}, F.concat(F.lit("quarters["), i.cast("string"), F.lit("].")))
    of_code = lambda x, i: F.when(~_among(x, "$", MISSING_CODES), F.concat(F.lit("missing["), i.cast("string"), F.lit("]")))
    found = F.concat(_broken(top), F.flatten(F.transform(quarters, of_quarter)), F.array_compact(F.transform(codes, of_code)))
    return r.select("id", F.explode(F.when(v.isNull(), F.array(F.lit(""))).otherwise(found)).alias("path"))


def research_errors(records: DataFrame) -> DataFrame:
    """id, path of each value that breaks a rule, of research items (id, json) with risk flags; an unreadable item has the path ''."""
    r = records.select("id", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    texts = lambda c: _at(v, c, LIST) & F.forall(_items(v, c), lambda x: _at(x, "$", TEXT))
    sources, flags = _items(v, "$.sources"), _items(v, "$.riskFlags")
    signal = _at(v, "$.signalPassed", FLAG) | (_absent(v, "$.signalPassed") & ~_among(v, "$.origin", ORIGINS[:1]))
    top = {
        **{c: _text(v, f"$.{c}") for c in ("ticker", "summary")},
        **{c: texts(f"$.{c}") for c in ("catalysts", "risks")},
        **{c: _absent(v, f"$.{c}") | _at(v, f"$.{c}", f"{TEXT}|VOID") for c in ("institutionalActivity", "analystView")},
        "sentiment": _among(v, "$.sentiment", SENTIMENTS),
        "origin": _among(v, "$.origin", ORIGINS),
        "signalPassed": signal,
        "sources": F.size(sources) > 0,
        "riskFlags": _at(v, "$.riskFlags", LIST),
    }
    inner = lambda c, i: F.concat(F.lit(f"{c}["), i.cast("string"), F.lit("]."))
    of_source = lambda x, i: _broken({**{c: _text(x, f"$.{c}") for c in ("title", "url", "date")}, "operatorProvided": _absent(x, "$.operatorProvided") | _at(x, "$.operatorProvided", FLAG)}, inner("sources", i))
    of_flag = lambda x, i: _broken({"type": _among(x, "$.type", RISKS), "description": _text(x, "$.description")}, inner("riskFlags", i))
    found = F.concat(_broken(top), F.flatten(F.transform(sources, of_source)), F.flatten(F.transform(flags, of_flag)))
    return r.select("id", F.explode(F.when(v.isNull(), F.array(F.lit(""))).otherwise(found)).alias("path"))
