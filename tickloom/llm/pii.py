"""Personal data spans by weak supervision, with built-in functions only.

Candidates are spans of a wider grammar than the base rules. Labelers vote on each: a format rule, a gazetteer
(domain endings, calling codes, issuer digits, reserved networks), a validity rule (checksum of cards, parts of
addresses, lengths of the others) and the
context of words before the span; a labeler may abstain. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and its posteriors train a logistic span classifier that also sees shape
features. Spans of the base rules are always kept; the classifier adds others.

Patterns are counted in Spark; the driver fits on the table of distinct patterns, whose size is bounded by the
product of the feature values (at most 4 x 3^4 x 2^3 rows), whatever the input.

Defined results: a null text is empty; spans are code points with the end exclusive; a candidate that overlaps a
base span is never added; repeated rows are each answered, and a null doc_id is passed through; of candidates at one
place the kinds come in the order email, ip, card, phone; a very long text is one row, matched in linear time; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: The base grammar. Possessive forms of the contract's expressions: they match the same spans without backtracking
#: over long runs. After a failure at the start of a run no later start in it can match, hence the look-behinds.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the base: spelled-out and defanged addresses, card numbers with other separators, and telephone
#: numbers in the usual national form. Labelers judge them; no check drops them beforehand.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.:\]])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])){3}[0-9]{1,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z./])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z./])",
    "phone": r"(?<![0-9A-Za-z+])\([0-9]{3}\)[ -]?[0-9]{3}[ -][0-9]{4}(?![0-9A-Za-z])",
}
#: Gazetteers (fixed values).
DOMAIN_ENDINGS = ("com", "org", "net", "edu", "gov", "int", "info", "de", "fr", "es", "uk", "eu", "io", "us", "ca", "it", "nl", "ch", "at")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
CUES = {
    "email": "mail|contact|write|reply|correo|courriel",
    "ip": "ip|host|server|address|addr|gateway",
    "card": "card|visa|credit|amex|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|appel",
}
CONTEXT_CHARS = 32
VOTERS = ("format", "gazetteer", "validity", "context")
SHAPES = ("edge", "digit_heavy", "long")
ROUNDS = 60
MATCH = "array<struct<rank:int,base:boolean,start:int,end:int,span:string,before:string>>"


def _ends(lengths: Column) -> Column:
    """Running sums of an integer array: within blocks of 256 directly, between blocks by a fold."""
    add = lambda a, x: a + x
    zero = F.lit(0)
    sums = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda k: F.aggregate(F.slice(lengths, k * 256 + 1, F.lit(256)), zero, add))
    before = F.aggregate(sums, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    one = F.struct(lengths.alias("n"), before.alias("b"))
    return F.transform(
        lengths, lambda _, i: one["b"][F.floor(i / 256).cast("int")] + F.aggregate(F.slice(one["n"], i - i % 256 + 1, i % 256 + 1), zero, add)
    )


def _matches(kind: str, base: bool) -> Column:
    """Candidates of a kind in column text that pass its checks: array of struct(rank, base, start, end, span, before)."""
    rank = KINDS.index(kind)
    found, gaps = F.col(f"_tl_m_{kind}_{base}"), F.col(f"_tl_g_{kind}_{base}")
    ends = F.col(f"_tl_e_{kind}_{base}")
    every = F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"), F.lit(base).alias("base"), (ends[i] - F.length(x)).alias("start"), ends[i].alias("end"), x.alias("span"), F.right(gaps[i], F.lit(CONTEXT_CHARS)).alias("before")
        ),
    )
    return F.coalesce(F.filter(every, lambda x: valid(kind, x["span"])) if base else every, F.array().cast(MATCH))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and `all`: candidates with the labelers' votes and shape features. docs: doc_id, text."""
    text, kinds = F.col("text"), [(k, True) for k in KINDS] + [(k, False) for k in WIDER]
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pattern = {(k, base): (BASE if base else WIDER)[k] for k, base in kinds}
    has = {k: text.rlike(p) for k, p in pattern.items()}
    d = d.withColumns({f"_tl_m_{k}_{b}": F.when(has[k, b], F.regexp_extract_all("text", F.lit(pattern[k, b]), F.lit(0))) for k, b in kinds})
    d = d.withColumns({f"_tl_g_{k}_{b}": F.when(F.col(f"_tl_m_{k}_{b}").isNotNull(), F.split("text", pattern[k, b], -1)) for k, b in kinds})
    sizes = lambda k, b: F.zip_with(F.col(f"_tl_m_{k}_{b}"), F.slice(F.col(f"_tl_g_{k}_{b}"), F.lit(1), F.size(f"_tl_m_{k}_{b}")), lambda m, g: F.length(m) + F.length(g))
    d = d.withColumns({f"_tl_n_{k}_{b}": sizes(k, b) for k, b in kinds})
    d = d.withColumns({f"_tl_e_{k}_{b}": F.when(F.size(f"_tl_n_{k}_{b}") > 0, _ends(F.col(f"_tl_n_{k}_{b}"))) for k, b in kinds})
    d = d.select("doc_id", F.concat(*[_matches(k, True) for k in KINDS]).alias("own"), F.concat(*[_matches(k, False) for k in WIDER]).alias("more"))
    apart = F.filter("more", lambda x: ~F.exists("own", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return d.select("doc_id", F.transform(F.concat("own", apart), _labelled).alias("all"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum of up to 20 digits: every second digit from the right is doubled and its digits added."""
    padded, total = F.lpad(digits, 20, "0"), F.lit(0)
    doubled = F.translate(padded, "0123456789", "0246813579")
    for i in range(1, 21):
        total = total + F.substring(doubled if i % 2 else padded, i, 1).cast("int")
    return total % 10 == 0


def valid(kind: str, span: Column) -> Column:
    """The check that a match of a kind has to pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "(?:0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])|0++)"
        return span.rlike(rf"^{part}(?:\.{part}){{3}}$")
    d = _digits(span)
    return F.length(d).between(9, 15) if kind == "phone" else F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _labelled(c: Column) -> Column:
    """A candidate with votes (1, 0, -1) and shape features (0, 1)."""
    span, digits = c["span"], _digits(c["span"])
    by_kind = lambda email, ip, card, phone: F.when(c["rank"] == 0, email).when(c["rank"] == 1, ip).when(c["rank"] == 2, card).otherwise(phone)
    cue = by_kind(*[F.lower(c["before"]).rlike(rf"(?:^|[^a-z])(?:{CUES[k]})[a-z-]*[:= ]{{1,3}}[^.]{{0,12}}$") for k in KINDS])
    ending = F.lower(F.regexp_extract(span, r"([A-Za-z0-9-]+)$", 1))
    code = F.substring(digits, 1, 1).isin(*CALLING_CODES) | F.substring(digits, 1, 2).isin(*CALLING_CODES)
    form = by_kind(
        span.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]* ?(?:@|[\[(] ?at ?[\])])"),
        span.rlike(r"^[1-9]|^[23][0-9A-Fa-f]{3}:"),
        span.rlike(r"^(?:[0-9]{12,19}|[0-9]{4}([ ./_-])[0-9]{4}(?:\1[0-9]{1,7}){1,3})$"),
        span.rlike(r"^(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{2,4}\)[ -]?)?[0-9]+(?:[ .-][0-9]+)*$"),
    )
    known = by_kind(ending.isin(*DOMAIN_ENDINGS), ~span.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\."), span.rlike("^[3-6]"), code | ~span.startswith("+"))
    plain_ip = F.regexp_replace(span, r"[\[\]()]|dot", "")
    sound = by_kind(
        F.length(span).between(6, 64),
        valid("ip", F.when(span.contains("[dot]"), F.regexp_replace(span, r"\[dot\]", ".")).otherwise(plain_ip)) | span.contains(":"),
        F.length(digits).between(13, 16) & luhn(digits),
        F.length(digits).between(10, 13),
    )
    votes = [_vote(form, ~form), _vote(known, ~known), _vote(sound, ~sound), _vote(cue, F.lit(False))]
    shapes = [c["before"].rlike(r"[A-Za-z0-9]$"), 2 * F.length(digits) > F.length(span), F.length(span) > 24]
    return F.struct(
        c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["base"].alias("base"), F.array(*votes, *[x.cast("int") for x in shapes]).alias("x")
    )


def _expectation_maximisation(rows: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """Posterior that a span is personal data, by vote pattern; labelers err independently given the truth."""
    total = max(1, sum(n for _, n in rows))
    post = [0.9 if sum(v) > 0 else 0.1 for v, _ in rows]
    for _ in range(ROUNDS):
        mass = [sum(p * n for p, (_, n) in zip(post, rows)), sum((1 - p) * n for p, (_, n) in zip(post, rows))]
        prior = min(max(mass[0] / total, 0.01), 0.99)
        rate = {}
        for j in range(len(VOTERS)):
            for side in (0, 1):
                for vote in (-1, 0, 1):
                    hit = sum((p if side == 0 else 1 - p) * n for p, (v, n) in zip(post, rows) if v[j] == vote)
                    # a labeler is taken to be better than chance
                    rate[j, side, vote] = (hit + (2.0 if (vote == 1) == (side == 0) and vote else 0.5)) / (mass[side] + 3.0)
        new = []
        for v, _ in rows:
            a = math.log(prior) + sum(math.log(rate[j, 0, x]) for j, x in enumerate(v))
            b = math.log(1 - prior) + sum(math.log(rate[j, 1, x]) for j, x in enumerate(v))
            new.append(1 / (1 + math.exp(max(-50.0, min(50.0, b - a)))))
        post = new
    return post


def _logistic(xs: list[list[float]], ys: list[float], ns: list[int]) -> list[float]:
    """Weights of a logistic model of soft labels by gradient steps on counted patterns."""
    w, total = [0.0] * len(xs[0]), float(sum(ns))
    for step in range(400):
        g = [1e-4 * a for a in w]
        for x, y, n in zip(xs, ys, ns):
            z = sum(a * b for a, b in zip(w, x))
            e = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - y) * n / total
            for i, b in enumerate(x):
                g[i] += e * b
        w = [a - 1.0 * b for a, b in zip(w, g)]
    return w


def train(found: DataFrame) -> dict[int, list[float]]:
    """By rank of kind: weights of bias, votes and shapes. found: what candidates() returns."""
    counted = found.select(F.explode("all").alias("c")).groupBy("c.rank", "c.x").count().collect()
    models, k = {}, len(VOTERS)
    for rank in range(len(KINDS)):
        own = sorted((tuple(r["x"]), r["count"]) for r in counted if r["rank"] == rank)
        if own:
            post = _expectation_maximisation([(x[:k], n) for x, n in own])
            models[rank] = _logistic([[1.0, *map(float, x)] for x, _ in own], post, [n for _, n in own])
    return models


def _score(models: dict[int, list[float]], c: Column) -> Column:
    """The classifier's probability of a candidate."""
    out = F.lit(0.0)
    for rank, w in models.items():
        z = F.lit(w[0])
        for i, a in enumerate(w[1:]):
            z = z + c["x"][i] * F.lit(a)
        out = F.when(c["rank"] == rank, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def find_personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id with arrays `base` and `spans` of struct(start, rank, end, base, ...), in order."""
    found = materialize(candidates(docs), "pii")
    models = train(found)
    kept = F.array_sort(F.filter("all", lambda c: c["base"] | (_score(models, c) > least)))
    return found.select("doc_id", kept.alias("spans")).withColumn("base", F.filter("spans", lambda c: c["base"]))


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long")
    return find_personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
