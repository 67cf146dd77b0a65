"""Personal data by weak supervision (native).

Base patterns find what is surely an e-mail address, IP address, card or phone number.  Looser patterns
propose further spans (obfuscated, defanged or unusually written ones).  Over every proposed and base span
labelers vote for, against, or not at all: pattern, checksum, gazetteer, context, neighbours and shape.
Expectation-maximisation estimates how reliable each labeler is for each kind, without labels, and the
resulting probabilities train a span classifier (logistic, one for each kind) that decides.

Texts are read once, row by row: a text's spans with their votes go into a small table, the fit
works on counts of equal vote patterns, and the verdict is applied to that table.  Nothing
is shuffled but counts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "neighbours", "shape")

#: The base patterns (quantifiers are possessive where that changes nothing, so long runs take linear time;
#: a match of an e-mail address or IP address begins where a run of its signs begins or the last match ended).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition that every text with a base match of the kind meets.
MAY_HOLD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][0-9\x20-]{13,}", "phone": r"\+[0-9]"}
#: Looser patterns and what texts with a match meet.  Repetitions are bounded, so no text takes more than linear time.
_AT = r"(?:@|\x20?[(\[{<]\x20?(?:at|AT|@)\x20?[)\]}>]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\.|\x20?[(\[{<]\x20?(?:dot|DOT|\.)\x20?[)\]}>]\x20?|\x20(?:dot|DOT)\x20)"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\x20?\.\x20?|,)[0-9]{1,3}+){3}(?![0-9.])|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.+-])[0-9]{4}(?:[\x20./_-]?[0-9]{4}){2}[\x20./_-]?[0-9]{1,7}(?![0-9])|(?<![0-9.+-])3[47][0-9]{2}[\x20./_-]?[0-9]{6}[\x20./_-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9.+-])(?:\(0?[0-9]{2,4}\)[\x20./-]{0,2}|00[1-9][0-9]{0,2}[\x20./-]|0?[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?:[\x20./-]?[0-9]{2,4})?(?![0-9.])",
}
MAY_BE = {
    "email": r"@|[(\[{<]\x20?(?:at|AT)\x20?[)\]}>]|\x20(?:at|AT)\x20[A-Za-z0-9-]{1,63}(?:\x20?[(\[{<]\x20?|\x20)(?:dot|DOT)",
    "ip": r"[0-9](?:\[\.\]|\(\.\)|\x20?\.\x20?|,)[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    "card": r"[0-9]{4}[\x20./_-]?[0-9]{4}[\x20./_-]?[0-9]{4}|3[47][0-9]{2}[\x20./_-]?[0-9]{6}",
    "phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{3}",
}
#: What makes a span count as written the usual way.
STRICT = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$",
    "ip": r"^(?:[0-9]+\.){3}[0-9]+$",
    "card": r"^(?:[0-9]+|[0-9]{4}(?:\x20[0-9]{4}){2}\x20[0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7})$",
    "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$",
}
#: Gazetteers.
ENDINGS = "com org net edu gov mil int info biz io dev app de fr es it uk eu us ca nl be ch at pl pt br mx ar cl co ru cn jp in au nz se no dk fi ie cz example test invalid localhost".split()
FILES = "png jpg jpeg gif svg pdf txt md html htm css js py java json xml zip tar gz csv exe dll".split()
#: Context words for and against each kind.
FOR = {
    "email": r"e-?mail|mail(?:to)?:|contact|write to|reach (?:me|us)|correo|courriel|kontakt|schreib",
    "ip": r"\bip\b|address|server|host|login|from|client|adresse|direcci",
    "card": r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|cell|fax|contact|whatsapp|anruf|handy|appel|t[eé]l|llam|m[oó]vil",
}
AGAINST = {
    "email": r"git clone|ssh|scp|rsync",
    "ip": r"version|release|\bv\.?$|section|chapter|kapitel|\bver\b",
    "card": r"isbn|order|invoice|serial|tracking|id[:#=]|hash|commit|key|token",
    "phone": r"isbn|version|order|invoice|page|seite|\bid[:#=]|date|year|[$€£]|doi|rfc|issue",
}

ROUNDS = 12
NEWTON_STEPS = 8
#: Prior counts of a labeler's votes that agree, abstain and disagree with the truth.
PRIOR = (6.0, 6.0, 1.5)
PENALTY = 1.0
#: Code points before a span that are its context.
CONTEXT = 32


# ---- expressions over one text ---------------------------------------------------------------------------


def running(lengths: Column) -> Column:
    """Sums of the entries before each entry, in chunks, so a long array takes less than quadratic time."""
    size = 512
    zero = F.array().cast("array<long>")

    def chunk(k):
        part = F.slice(lengths, k * size + 1, F.lit(size))
        start = F.struct(F.lit(0).cast("long").alias("sum"), zero.alias("at"))
        return F.aggregate(part, start, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["at"], F.array(acc["sum"])).alias("at")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), chunk)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<array<long>>").alias("at"))
    total = F.aggregate(
        chunks, start, lambda acc, c: F.struct((acc["sum"] + c["sum"]).alias("sum"), F.concat(acc["at"], F.array(F.transform(c["at"], lambda x: x + acc["sum"]))).alias("at"))
    )
    return F.when(F.size(lengths) > 0, F.flatten(total["at"])).otherwise(zero)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of a string pass the Luhn test."""
    d = F.reverse(digits(x))
    places = F.sequence(F.lit(1), F.length(d))

    def worth(i):
        v = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

    return F.when(F.length(d) == 0, F.lit(False)).otherwise(F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0)


_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def passes(kind: str, x: Column) -> Column:
    """The test that a base match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(_OCTETS)
    n = F.length(digits(x))
    return n.between(8, 15) if kind == "phone" else n.between(16, 19) & F.when(n.between(16, 19), luhn(x)).otherwise(False)


def proposable(kind: str, x: Column) -> Column:
    """What a looser match must meet: a number that fails the cards' checksum is no card, whoever votes for it."""
    return luhn(x) if kind == "card" else F.lit(True)


_SPAN = "array<struct<at:long,end:long,x:string,before:string,after:string>>"


def found(text: Column, pattern: str, condition: str) -> Column:
    """All matches, left to right, with their places in code points, the text before (its end) and the sign after."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(g, m):
        sizes = F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long"))
        return F.transform(
            F.arrays_zip(m.alias("m"), running(sizes).alias("s")),
            lambda p, i: F.struct(
                (p["s"] + F.length(F.get(g, i))).cast("long").alias("at"),
                (p["s"] + F.length(F.get(g, i)) + F.length(p["m"])).cast("long").alias("end"),
                p["m"].alias("x"),
                F.right(F.get(g, i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(g, i + 1), F.lit(1)).alias("after"),
            ),
        )

    return F.when(text.rlike(condition), _let(spans, gaps, matches)).otherwise(F.array()).cast(_SPAN)


def _let(body, *values: Column) -> Column:
    """``body`` over values that are computed once (a one-entry array holds them)."""
    names = [f"v{i}" for i in range(len(values))]
    held = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]))
    return F.element_at(F.transform(held, lambda h: body(*[h[n] for n in names])), 1)


def _vote(for_: Column, against: Column | None = None) -> Column:
    """1 for, -1 against, 0 for neither; an unknown condition is no vote."""
    out = F.when(for_, F.lit(1))
    return (out if against is None else out.when(against, F.lit(-1))).otherwise(F.lit(0))


def votes(kind: str, s: Column) -> list[Column]:
    """The labelers' votes on a span, in the order of ``LABELERS``."""
    x, n = s["x"], F.length(digits(s["x"]))
    before, after = F.lower(s["before"]), s["after"]
    ending = F.lower(F.regexp_extract(x, r"([A-Za-z]{2,63})$", 1))
    tight = before.rlike(r"[\p{L}\p{N}=/_#&?-]$") | after.rlike(r"[\p{L}\p{N}=/_&?]")
    pattern = _vote(x.rlike(STRICT[kind]), F.lit(kind in ("card", "ip")) & ~x.rlike(STRICT[kind]) & x.rlike(r"[/_,]"))
    context = _vote(before.rlike(FOR[kind]) & ~before.rlike(AGAINST[kind]), before.rlike(AGAINST[kind]))
    near = _vote(~tight, tight)
    same = digits(x).rlike(r"([0-9])\1{7,}|01234567|12345678|87654321")
    if kind == "email":
        checksum = _vote(x.rlike(r"[A-Za-z]{2,63}$"), x.rlike(r"\.\.|^\.|[0-9]$"))
        gazetteer = _vote(ending.isin(ENDINGS), ending.isin(FILES) | ~ending.isin(ENDINGS) & ~x.contains("@"))
        shape = _vote(F.length(x).between(6, 80), F.length(x) < 6)
    elif kind == "ip":
        plain = F.regexp_replace(F.regexp_replace(x, r"[\x20()\[\]]", ""), ",", ".")
        six = x.contains(":")
        checksum = _vote(six | plain.rlike(_OCTETS), ~six & ~plain.rlike(_OCTETS))
        gazetteer = _vote(six | plain.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), plain.rlike(r"^0|^(?:22[4-9]|2[3-9][0-9])\."))
        shape = _vote(six | plain.rlike(r"[0-9]{2}.*\.[0-9]{2}"), x.rlike(r",|\x20") | plain.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$|(?:^|\.)0[0-9]"))
    elif kind == "card":
        checksum = _vote(n.between(13, 19) & F.when(n.between(13, 19), luhn(x)).otherwise(False), F.lit(True))
        gazetteer = _vote(digits(x).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"), F.lit(True))
        shape = _vote(n.isin(15, 16) & ~same, same | ~n.between(13, 19))
    else:
        checksum = _vote(n.between(9, 15), ~n.between(8, 15))
        gazetteer = _vote(x.rlike(r"^\+|^00[1-9]"), x.rlike(r"^(?:19|20)[0-9]{2}[\x20./-]"))
        shape = _vote(x.rlike(r"\(|^\+|[0-9]-[0-9]+-[0-9]") & ~same, same | x.rlike(r"[./].*-|-.*[./]"))
    return [pattern, checksum, gazetteer, context, near, shape]


def _flags(s: Column) -> list[Column]:
    """Further inputs of the classifier: separators of several sorts, bracketed signs, a long span."""
    x = s["x"]
    signs = F.size(F.array_distinct(F.split(F.regexp_replace(x, r"[^\x20./()\[\]@:-]", ""), "")))
    return [(signs > 2).cast("int"), x.rlike(r"[(\[{<]").cast("int"), (F.length(x) > 24).cast("int")]


N_FLAGS = 3


def spans_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (struct of all columns but the text) and for each kind ``<kind>`` (base spans) and ``<kind>_more`` (proposed
    ones that touch no base span of any kind): places, votes and flags."""
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), body.alias("body"))
    passing = lambda kind: lambda s: passes(kind, s["x"])
    rows = rows.withColumns({k: F.filter(found(F.col("body"), BASE[k], MAY_HOLD[k]), passing(k)) for k in KINDS})
    worth = lambda kind: lambda s: proposable(kind, s["x"])
    rows = rows.withColumns({f"{k}_more": F.filter(found(F.col("body"), LOOSE[k], MAY_BE[k]), worth(k)) for k in KINDS}).drop("body")
    taken = F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["at"], s["end"])) for k in KINDS])
    rows = rows.withColumn("taken", taken)

    def judged(kind, name, free):
        spans = F.col(name)
        if free:
            spans = F.filter(spans, lambda s: ~F.exists(F.col("taken"), lambda b: (b["at"] < s["end"]) & (s["at"] < b["end"])))
        described = lambda s: F.struct(
            s["at"].alias("at"), s["end"].alias("end"), F.array(*[v.cast("byte") for v in votes(kind, s)]).alias("votes"), F.array(*[f.cast("byte") for f in _flags(s)]).alias("flags")
        )
        return F.transform(spans, described).alias(name)

    return rows.select("row", *[judged(k, k, False) for k in KINDS], *[judged(k, f"{k}_more", True) for k in KINDS])


# ---- the fit: expectation-maximisation and the classifier, on counts of equal spans ----------------------


def pattern_counts(spans: DataFrame) -> DataFrame:
    """``kind`` (place in ``KINDS``), votes ``v0``.., flags ``f0``.. and the number ``n`` of spans alike."""
    pattern = lambda i: lambda s: F.struct(F.lit(i).alias("kind"), s["votes"].alias("v"), s["flags"].alias("f"))
    both = [F.transform(F.concat(F.col(k), F.col(f"{k}_more")), pattern(i)) for i, k in enumerate(KINDS)]
    flat = spans.select(F.explode(F.concat(*both)).alias("s"))
    names = [F.col("s.v")[i].cast("int").alias(f"v{i}") for i in range(len(LABELERS))] + [F.col("s.f")[i].cast("int").alias(f"f{i}") for i in range(N_FLAGS)]
    flat = flat.select(F.col("s.kind").alias("kind"), *names)
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("n"))


def _array(values) -> str:
    """An SQL array of doubles."""
    return "array(" + ", ".join(f"{float(v)!r}D" for v in np.asarray(values, float).ravel()) + ")"


def _probability(raw: str) -> str:
    return f"1 / (1 + exp(-greatest(least({raw}, 30D), -30D)))"


def _vote_odds(bias: np.ndarray, weight: np.ndarray) -> str:
    """SQL for the log odds that the labelers' votes on a pattern give."""
    m = len(LABELERS)
    return " + ".join([f"get({_array(bias)}, kind)", *[f"get({_array(weight)}, (kind * {m} + {j}) * 3 + v{j} + 1)" for j in range(m)]])


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over the vote patterns: log odds of each kind (before any vote), and of each kind, labeler
    and vote (-1, 0, 1).

    It starts from the votes' majority; prior counts hold labelers to be right more often than wrong, so few
    spans leave them near that.  Every step is one aggregation, of which a row for each kind comes back."""
    k, m = len(KINDS), len(LABELERS)
    bias = np.zeros(k)
    weight = np.tile(np.array([-1.0, 0.0, 1.0]), (k, m, 1))
    cells = ", ".join(f"sum(if(v{j} = {v}, {side}, 0D))" for side in ("yes", "no") for j in range(m) for v in (-1, 0, 1))
    for _ in range(rounds):
        parts = counts.withColumn("p", F.expr(_probability(_vote_odds(bias, weight)))).selectExpr("*", "p * n AS yes", "(1 - p) * n AS no")
        sums = parts.groupBy("kind").agg(F.sum("yes").alias("a"), F.sum("no").alias("b"), F.expr(f"array({cells})").alias("s"))
        met = {r["kind"]: r for r in sums.collect()}
        for i in range(k):
            yes, no = np.array(met[i]["s"]).reshape(2, m, 3) if i in met else np.zeros((2, m, 3))
            yes, no = yes + np.array(PRIOR[::-1]), no + np.array(PRIOR)
            weight[i] = np.log(yes / yes.sum(axis=1, keepdims=True)) - np.log(no / no.sum(axis=1, keepdims=True))
            bias[i] = math.log((met[i]["a"] + 1) / (met[i]["b"] + 1)) if i in met else 0.0
    return bias, weight


def span_classifier(counts: DataFrame, bias: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the logistic classifiers (kind by input: one, votes, flags), fitted by Newton steps to the
    probabilities that the labelers' reliabilities give; gradient and curvature are aggregations over the patterns."""
    x = ["1", *[f"v{j}" for j in range(len(LABELERS))], *[f"f{j}" for j in range(N_FLAGS)]]
    k, d = len(KINDS), len(x)
    data = counts.withColumn("t", F.expr(_probability(_vote_odds(bias, weight))))
    gradient = ", ".join(f"sum(n * (t - p) * {a})" for a in x)
    curve = ", ".join(f"sum(n * p * (1 - p) * {x[i]} * {x[j]})" for i in range(d) for j in range(i, d))
    w = np.zeros((k, d))
    for _ in range(NEWTON_STEPS):
        raw = " + ".join(f"get({_array(w[:, i])}, kind) * {a}" for i, a in enumerate(x))
        step = data.withColumn("p", F.expr(_probability(raw))).groupBy("kind")
        for r in step.agg(F.expr(f"array({gradient})").alias("g"), F.expr(f"array({curve})").alias("h")).collect():
            upper = np.zeros((d, d))
            upper[np.triu_indices(d)] = r["h"]
            full = upper + np.triu(upper, 1).T + PENALTY * np.eye(d)
            w[r["kind"]] += np.linalg.solve(full, np.array(r["g"]) - PENALTY * w[r["kind"]])
    return w


def find_personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``row`` (struct of all columns but the text), for each kind ``n_<kind>`` (base spans) and ``<kind>`` (all spans:
    array of ``at, end`` in code points, end exclusive, in order).

    Base spans stay.  A proposed span is added when its classifier gives ``threshold`` or more and no span of an
    earlier kind touches it.  Reliabilities are estimated from all spans of the table.  Null texts are
    empty; texts of any length are searched whole; equal texts get equal spans; an empty table, or one without
    any span, gives rows without spans; null or repeated keys and extra columns of any name
    are carried in ``row``."""
    spans = staged(spans_of(docs, text), "pii-spans")
    counts = staged(pattern_counts(spans).coalesce(1), "pii-patterns")
    w = span_classifier(counts, *reliabilities(counts))
    limit = math.log(threshold / (1 - threshold))
    place = lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"))


    def accepted(i, earlier):
        def test(s):
            x = [F.lit(1), *[s["votes"][j] for j in range(len(LABELERS))], *[s["flags"][j] for j in range(N_FLAGS)]]
            good = reduce(lambda a, b: a + b, [F.lit(float(c)) * v for c, v in zip(w[i], x, strict=True)]) >= limit
            return good if earlier is None else good & ~F.exists(F.col(earlier), lambda b: (b["at"] < s["end"]) & (s["at"] < b["end"]))

        return test

    out, earlier = spans, None
    for i, kind in enumerate(KINDS):
        out = out.withColumn(f"{kind}_added", F.transform(F.filter(F.col(f"{kind}_more"), accepted(i, earlier)), place))
        before = F.col(f"{kind}_added") if earlier is None else F.concat(F.col(earlier), F.col(f"{kind}_added"))
        earlier = f"{kind}_sofar"
        out = out.withColumn(earlier, before)
    return out.select(
        "row",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        *[F.transform(F.col(k), place).alias(f"{k}_base") for k in KINDS],
        *[F.array_sort(F.concat(F.transform(F.col(k), place), F.col(f"{k}_added"))).alias(k) for k in KINDS],
    )


def listed(columns: dict[str, Column]) -> Column:
    """Spans as ``kind:start:end``, by kind and start, joined by commas."""
    written = lambda kind: lambda s: F.concat_ws(":", F.lit(kind), s["at"].cast("string"), s["end"].cast("string"))
    parts = [F.transform(c, written(k)) for k, c in columns.items()]
    return F.array_join(F.concat(*parts), ",")
