"""Personal data by weak supervision (DataFrame operations only).

Candidates are the base matches of e-mail addresses, IPv4 addresses, payment cards and phone numbers, those that fail their
check, and looser spellings (obfuscated addresses, numbers without a country prefix, unusual separators). Labelers vote on
each: the form (check passed, failed, or a loose spelling), a gazetteer (top-level domains, issuer prefixes, calling codes,
reserved networks), words of the context before it, and its shape. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how likely each pattern is personal data; these likelihoods train a
logistic span classifier, which decides on the loose candidates; one that its context speaks against (an order number, a
version) is never added. Base findings that pass their check always stay.

The number of vote patterns is fixed by the labelers (at most 4 kinds times 81), so the driver gets a table of bounded size
whatever the input; everything else is column expressions, without a shuffle of texts.

Defined results: a null or empty text has no findings; an added span that overlaps a base one, or an earlier added one, is
dropped; repeated rows are each scanned; input columns are kept, those added replace columns of the same name.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN
from .spans import folded, located, ordered, scan

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "context", "shape")
#: Fixed patterns: base matches, and looser spellings.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[.\x20-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
}
#: Fixed gazetteers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|us|eu|ch|at|nl|be|se|pl|br|mx|in|jp|cn|ru|au|ca"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|62|65)"
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|2[2-5][0-9])\."
#: Fixed context words.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|kontakt|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|telefono|whatsapp)\b",
}
AGAINST = r"(?i)(?:\bversion|\bv|\border|\binvoice|\bisbn|\bref|\bbuild|\bsection|\bfig|\bticket|#)[\s:.#]*$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """The base finding's own check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, "\\."), lambda p: (F.length(part(p)) <= 3) & (part(p).cast("int") <= 255))
    d = _digits(m)
    if kind == "card":
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    return F.length(d).between(10, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, m: Column, before: Column, loose: bool) -> Column:
    d, context = _digits(m), before
    form = F.lit(0) if loose else F.when(_valid(kind, m), 1).otherwise(-1)
    same = F.length(F.regexp_replace(d, "^(.)\\1*", "")) == 0
    if kind == "email":
        top = F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1))
        gazetteer = _vote(top.rlike(f"^(?:{DOMAINS})$"), top.rlike("^[0-9]+$"))
        shape = _vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}[^A-Za-z0-9._%+-]"), m.rlike(r"\.\.|^[._%+-]"))
    elif kind == "ip":
        plain = F.regexp_replace(m, "[^0-9]+", ".")
        gazetteer = _vote(~plain.rlike(RESERVED), plain.rlike(r"^(?:0|2[4-9][0-9])\."))
        shape = _vote(F.forall(F.split(plain, "\\."), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255)), F.lit(True))
    elif kind == "card":
        gazetteer = _vote(d.rlike(ISSUERS), F.lit(True))
        shape = _vote(F.length(d).between(14, 19) & ~same & m.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}(?:\D{1,2}[0-9]{4}){3}|[0-9]{4}\D[0-9]{6}\D[0-9]{5})$"), F.lit(True))
    else:
        gazetteer = F.lit(0) if loose else _vote(d.rlike(CALLING), F.lit(True))
        shape = _vote(F.length(d).between(10, 15) & ~same, F.lit(True))
    words = _vote(context.rlike(FOR[kind]), context.rlike(AGAINST))
    return F.concat_ws(",", form, gazetteer, words, shape)


_CANDIDATE = "array<struct<start:int,end:int,votes:string>>"


def candidates(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with, by kind, own columns of base findings and of candidates (start, end, votes)."""
    patterns = {**BASE, **{f"loose_{k}": v for k, v in LOOSE.items()}}
    found = scan(docs, text, patterns)

    def place(kind: str, loose: bool) -> Column:
        # A number of few digits is no candidate at all for a card.
        long = (lambda m, b: F.length(_digits(m)) >= 12) if kind == "card" else (lambda m, b: F.lit(True))
        return located(OWN + ("loose_" if loose else "") + kind, lambda m, b: {"votes": _votes(kind, m, b, loose)}, long, _CANDIDATE)

    found = found.withColumns({f"{OWN}{'l' if loose else 'c'}_{k}": place(k, loose) for k in KINDS for loose in (False, True)})
    return found.drop(*[OWN + k for k in patterns])


class Model:
    """weights[kind]: intercept, then for each labeler the weight of a vote for and of a vote against."""

    def __init__(self, weights: dict[str, list[float]], reliability: dict[str, list[tuple[float, float]]]):
        self.weights, self.reliability = weights, reliability

    def chance(self, kind: str, votes: Column) -> Column:
        w, v = self.weights[kind], F.split(votes, ",")
        z = F.lit(w[0])
        for i in range(len(LABELERS)):
            z = z + F.when(v[i] == "1", w[1 + 2 * i]).when(v[i] == "-1", w[2 + 2 * i]).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


#: By labeler: how reliable it is taken to be beforehand, and as how many votes that counts. A number that fails its own
#: check is seldom what it looks like.
TRUST = {"form": (0.98, 400.0), "gazetteer": (0.7, 20.0), "context": (0.8, 20.0), "shape": (0.7, 20.0)}


def _em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50):
    """Posteriors of vote patterns, and each labeler's chance to be right where it votes, for both classes. The votes counted
    in beforehand settle which class is which."""
    def start(v):
        return 1 / (1 + math.exp(-sum(v)))

    post = [start(v) for v, _ in patterns]
    right = []
    for _ in range(rounds):
        right = []
        for i, name in enumerate(LABELERS):
            pair, (trust, weight) = [], TRUST[name]
            for truth, sign in ((1, 1), (0, -1)):
                mass = [n * (p if truth else 1 - p) for (v, n), p in zip(patterns, post)]
                votes = sum(m for m, (v, _) in zip(mass, patterns) if v[i])
                good = sum(m for m, (v, _) in zip(mass, patterns) if v[i] == sign)
                pair.append((good + trust * weight) / (votes + weight))
            right.append(tuple(pair))
        total = sum(n for _, n in patterns)
        prior = (sum(n * p for (_, n), p in zip(patterns, post)) + 1) / (total + 2)
        post = []
        for v, _ in patterns:
            z = math.log(prior / (1 - prior))
            for i, x in enumerate(v):
                if x:
                    yes, no = right[i]
                    z += math.log(yes / (1 - no)) if x > 0 else math.log((1 - yes) / no)
            post.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
    return post, right


def _logistic(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 400, rate: float = 0.5, penalty: float = 1e-3) -> list[float]:
    """Weights fitted to (votes, likelihood, number) rows by gradient descent."""
    w = [0.0] * (1 + 2 * len(LABELERS))
    total = sum(n for *_, n in rows)
    sparse = [([0] + [1 + 2 * i + (x < 0) for i, x in enumerate(v) if x], p, n / total) for v, p, n in rows]
    for _ in range(steps):
        grad = [penalty * x for x in w]
        for at, p, n in sparse:
            error = n * (1 / (1 + math.exp(-sum(w[i] for i in at))) - p)
            for i in at:
                grad[i] += error
        w = [x - rate * g for x, g in zip(w, grad)]
    return w


def fit(docs: DataFrame, *, text: str = "text") -> Model:
    """Reliabilities and the span classifier, from the votes on every candidate in docs."""
    found = candidates(docs.select(F.col(text).alias("text")))
    every = F.concat(*[F.transform(F.col(f"{OWN}{x}_{k}"), (lambda kind: lambda c: F.struct(F.lit(kind).alias("kind"), c["votes"].alias("votes")))(k)) for k in KINDS for x in "cl"])
    counts = found.select(F.explode(every).alias("c")).groupBy("c.kind", "c.votes").count().collect()
    by = defaultdict(list)
    for r in sorted(counts):
        by[r["kind"]].append((tuple(map(int, r["votes"].split(","))), r["count"]))
    weights, reliability = {}, {}
    for kind in KINDS:
        if not by[kind]:
            weights[kind], reliability[kind] = [-1.0] + [1.0, -1.0] * len(LABELERS), []
            continue
        post, reliability[kind] = _em(by[kind])
        weights[kind] = _logistic([(v, p, n) for (v, n), p in zip(by[kind], post)])
    return Model(weights, reliability)


def annotate(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with ``base`` and ``spans``: sorted arrays of (start, rank, end, kind)."""
    found = candidates(docs, text=text)
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    base = {k: plain(F.filter(F.col(f"{OWN}c_{k}"), lambda x: x["votes"].startswith("1,"))) for k in KINDS}
    found = found.withColumn(OWN + "base", ordered(base))
    base = F.col(OWN + "base")

    def added(kind: str) -> Column:
        against = lambda x: F.split(x["votes"], ",")[LABELERS.index("context")] == "-1"
        good = lambda x: ~x["votes"].startswith("1,") & ~against(x) & (model.chance(kind, x["votes"]) >= threshold)
        return plain(F.filter(F.concat(F.col(f"{OWN}c_{kind}"), F.col(f"{OWN}l_{kind}")), good))

    found = found.withColumn(OWN + "more", ordered({k: added(k) for k in KINDS}))
    more = F.filter(F.col(OWN + "more"), lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))

    def apart(acc, x):
        new = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(x["start"] >= acc["at"], new).otherwise(acc)

    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    more = folded(more, F.struct(F.lit(0).alias("at"), none.alias("out")), apart, none)
    spans = F.when(F.size(OWN + "more") == 0, base).otherwise(F.sort_array(F.concat(base, more)))
    out = found.withColumn("spans", spans).withColumn("base", base)
    return out.drop(*[c for c in out.columns if c.startswith(OWN)])
