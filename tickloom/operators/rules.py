"""Rules of JSON documents as a tree, compiled to one expression that names each value that breaks one by its path.

A document is a variant; objects are opened field by field and arrays by nested transforms, so a rule costs what the
document holds and no document leaves its row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"


@dataclass(frozen=True)
class Rule:
    """kind: number, flag, text, object, array, numbers (an array of numbers), named_numbers (an object of numbers) or one of `values`.

    nullable: null keeps the rule. optional: an absent value does. only: the rule holds in documents of that version alone.
    empty: a text may be empty.
    """

    kind: str
    fields: dict[str, Rule] = field(default_factory=dict)
    item: Rule | None = None
    values: tuple = ()
    nullable: bool = False
    optional: bool = False
    empty: bool = False
    only: int | None = None

    def __or__(self, more: dict) -> Rule:
        return replace(self, **more)


NUMBER, FLAG, TEXT = Rule("number"), Rule("flag"), Rule("text")
OR_NULL, OPTIONAL = {"nullable": True}, {"optional": True}


def one_of(*values: str | int) -> Rule:
    return Rule("one", values=values)


def an_object(**fields: Rule) -> Rule:
    return Rule("object", fields=fields)


def array_of(item: Rule) -> Rule:
    return Rule("array", item=item)


def _none() -> Column:
    return F.array().cast("array<string>")


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def broken(rule: Rule, v: Column, path: Column, version: Column) -> Column:
    """The paths at and below `path` where v breaks the rule, as an array."""
    kind, here = F.coalesce(F.schema_of_variant(v), F.lit("")), F.array(path)
    all_numbers = lambda items: F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x).rlike(NUMBERS), F.lit(False)))
    if rule.kind == "object":
        below = [broken(r, _get(v, f"$.{k}"), F.concat(path, F.lit(f".{k}" if k else k)), version) for k, r in rule.fields.items()]
        out = F.when(kind.startswith("OBJECT"), F.concat(*below)).otherwise(here)
    elif rule.kind == "array":
        at = lambda x, i: broken(rule.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), version)
        out = F.when(kind.startswith("ARRAY"), F.flatten(F.transform(_get(v, "$", "array<variant>"), at))).otherwise(here)
    else:
        text = F.coalesce(_get(v, "$", "string"), F.lit(""))
        is_number, is_text = kind.rlike(NUMBERS), kind.startswith("STRING")
        known = F.lit(False)
        for x in rule.values:
            known = known | ((is_text & (text == x)) if isinstance(x, str) else (is_number & (_get(v, "$", "double") == float(x))))
        ok = {
            "number": is_number,
            "flag": kind == "BOOLEAN",
            "text": is_text & (F.lit(rule.empty) | (text != "")),
            "numbers": kind.startswith("ARRAY") & F.coalesce(all_numbers(_get(v, "$", "array<variant>")), F.lit(False)),
            "named_numbers": kind.startswith("OBJECT") & F.coalesce(all_numbers(F.map_values(_get(v, "$", "map<string,variant>"))), F.lit(False)),
            "one": F.coalesce(known, F.lit(False)),
        }[rule.kind]
        out = F.when(ok, _none()).otherwise(here)
    if rule.nullable:
        out = F.when(kind == "VOID", _none()).otherwise(out)
    if rule.optional:
        out = F.when(v.isNull(), _none()).otherwise(out)
    if rule.only is not None:
        out = F.when(F.coalesce(version != rule.only, F.lit(True)), _none()).otherwise(out)
    return out


def errors(records: DataFrame, rules: dict[str, Rule], version: str = "$.schemaVersion") -> DataFrame:
    """id, path of each value that breaks a rule, of documents (id, json); one that can't be read, or is no object, has the path ''."""
    r = records.select("id", F.try_parse_json("json").alias("v"))
    v, of = F.col("v"), _get(F.col("v"), version, "double")
    found = F.concat(*[broken(rule, _get(v, f"$.{k}"), F.lit(k), of) for k, rule in rules.items()])
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return r.select("id", F.explode(F.when(whole, found).otherwise(F.array(F.lit("")))).alias("path"))
