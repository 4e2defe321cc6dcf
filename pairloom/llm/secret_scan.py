"""Secret scan with multipart credential linking (DataFrame operations only).

Base findings stand by themselves: an assignment to a password-like name with a value of 12 characters or more, an access
identifier, a hexadecimal run of 16 or more. Weak candidates are reported only next to what completes them:

* an identifier (12 or more capitals and digits, both present; or a name such as user or client_id set to a value) needs a
  secret in its scope;
* a secret (a token of 20 or more characters with a capital, a small letter and a digit; or a password-like name set to a
  shorter value of 6 or more) needs an identifier or an endpoint (URL or host with port) in its scope.

Two parts are in each other's scope if at most ``SCOPE`` code points lie between the end of the one and the start of the
other, however long they are and wherever in the text. This is an interval join inside each text: the scopes of a kind of
part are merged first, of which a text then holds no more than one for every two ``SCOPE`` of its length, so a text with
very many parts costs no pairs, and nothing is shuffled.

Defined results: a null or empty text has no findings; weak findings inside a base one are dropped; repeated rows are each
scanned; columns of the input are kept, those added replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN
from .spans import SPAN, located, masked, ordered, scan

SCOPE = 511
KINDS = ("assign", "access", "hex")
_VALUE = r"[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
#: Fixed patterns of the findings and the weak parts.
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)" + _VALUE,
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{16,}+",
    "id": r"(?<![A-Za-z0-9])[A-Z0-9]{12,}+(?![a-z])",
    "login": r"(?<![A-Za-z0-9])(?i:user|username|login|client_?id|access_?key(?:_?id)?|account)" + _VALUE,
    "token": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    "endpoint": r"https?://[^\s\"'<>]++|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}(?![0-9])",
}


def _value(match: Column, kind: str) -> Column:
    return F.regexp_extract(match, "(?s)^.*?" + PATTERNS[kind], 1)


def _near(spans: Column) -> Column:
    """What is in the scope of one of the spans: (start, end) in order, those that touch made one."""
    wide = F.sort_array(F.transform(spans, lambda x: F.struct((x["start"] - SCOPE).alias("start"), (x["end"] + SCOPE).alias("end"))))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touching = F.coalesce(x["start"] <= last["end"], F.lit(False))
        return F.when(touching, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(wide, F.expr(f"cast(array() as {SPAN})"), step)


def _join(spans: Column, near: Column) -> Column:
    """The spans that reach into one of near."""
    return F.filter(spans, lambda x: F.exists(near, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"])))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that are not inside one of base."""
    inside = lambda x: F.exists(base, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))
    return F.when(F.size(base) == 0, spans).otherwise(F.filter(spans, lambda x: ~inside(x)))


def find_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with ``base`` and ``spans``: sorted arrays of (start, rank, end, kind)."""
    found = scan(docs, text, PATTERNS)
    every = lambda m, b: {}
    size = lambda m, kind: F.length(_value(m, kind))
    keep = {
        "assign": lambda m, b: size(m, "assign") >= 12,
        "access": lambda m, b: F.length(m) >= 18,
        "hex": lambda m, b: F.lit(True),
        "short": lambda m, b: (size(m, "assign") >= 6) & (size(m, "assign") < 12),
        "id": lambda m, b: _all(m, "[0-9]", "[A-Z]"),
        "login": lambda m, b: size(m, "login") >= 3,
        "token": lambda m, b: _all(m, "[0-9]", "[A-Z]", "[a-z]"),
        "endpoint": lambda m, b: F.lit(True),
    }
    columns = {k: OWN + ("assign" if k == "short" else k) for k in keep}
    found = found.withColumns({f"{OWN}s_{k}": located(columns[k], every, f, SPAN) for k, f in keep.items()})
    found = found.drop(*set(columns.values()))
    s = {k: F.col(f"{OWN}s_{k}") for k in keep}
    found = found.withColumn(OWN + "base", ordered({k: s[k] for k in KINDS}))
    ids, secrets = F.concat(s["access"], s["id"], s["login"]), F.concat(s["assign"], s["hex"], s["short"], s["token"])
    # Only texts with two kinds of parts can link anything.
    maybe = (F.size(F.concat(s["id"], s["login"], s["short"], s["token"])) > 0) & ((F.size(ids) > 0).cast("int") + (F.size(secrets) > 0).cast("int") + (F.size(s["endpoint"]) > 0).cast("int") > 1)
    found = found.withColumns({OWN + "maybe": maybe, OWN + "to_secret": F.when(maybe, _near(secrets)), OWN + "to_id": F.when(maybe, _near(F.concat(ids, s["endpoint"])))})
    base, to_secret, to_id = F.col(OWN + "base"), F.col(OWN + "to_secret"), F.col(OWN + "to_id")
    weak = {
        "assign": _apart(_join(s["short"], to_id), base),
        "access": _apart(_join(F.concat(s["id"], s["login"]), to_secret), base),
        "token": _apart(_join(s["token"], to_id), base),
    }
    weak = {k: F.when(F.col(OWN + "maybe"), v).otherwise(F.expr(f"cast(array() as {SPAN})")) for k, v in weak.items()}
    every_kind = {"assign": F.concat(s["assign"], weak["assign"]), "access": F.concat(s["access"], weak["access"]), "hex": s["hex"], "token": weak["token"]}
    out = found.withColumn("spans", ordered(every_kind)).withColumn("base", base)
    return out.drop(*[c for c in out.columns if c.startswith(OWN)])


def _all(m: Column, *sets: str) -> Column:
    out = F.lit(True)
    for s in sets:
        out = out & m.rlike(s)
    return out


def redact(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every finding in the text replaced by its kind in brackets, and the length column brought up to date."""
    kept = docs.columns
    plain = docs.withColumnsRenamed({c: f"{OWN}in_{c}" for c in ("base", "spans") if c in kept})
    found = find_secrets(plain, text=text)
    safe = F.coalesce(F.col(text), F.lit(""))
    clean = masked(safe, F.col("spans"), lambda x: F.concat(F.lit("["), x["kind"], F.lit("]")))
    found = found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text)))
    if n_chars in kept:
        found = found.withColumn(n_chars, F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col(n_chars)))
    found = found.drop("base", "spans").withColumnsRenamed({f"{OWN}in_{c}": c for c in ("base", "spans") if c in kept})
    return found.select(*kept)
