"""Personal data by weak supervision.

Base spans are exact: one pattern a kind (email, ip, card, phone) and its check
of digits. Further candidates come from wider patterns. Labelers (pattern and
check, gazetteer, context, shape) vote for, against or not at all on every span;
expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and gives each pattern a probability; a naive Bayes
classifier over span features is trained on these probabilities and decides
which candidates are added. Base spans always stay.

Everything over data is DataFrame functions on the row's own text. The vote and
feature patterns are small categories, so their counts (bounded by the product
of the categories, whatever the number of rows) are the only thing that reaches
the driver, and the classifier returns as a column expression: two passes over
the texts, no shuffle but the counts.

Patterns start a run of letters or digits only at its first sign or where the
last match ended, and repeat possessively, which gives the same matches as the
plain forms in linear time on any text.

Defined results: a null text is an empty one, without spans; repeated rows give
equal results; without any spans the classifier adds none; an empty table gives
an empty table; other columns pass through, those named like a result are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import fresh, whole_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
BASE_PATTERNS = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++){3}+",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Wider forms: written-out addresses, IPv6, card-like groups, phones without +.
WIDE_PATTERNS = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++[ ]?(?:\\(at\\)|\\[at\\]|\\{{at\\}})[ ]?[A-Za-z0-9-]++"
             "(?:[ ]?(?:\\.|\\(dot\\)|\\[dot\\]|\\{dot\\})[ ]?[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": "(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}(?![0-9])",
    "phone": "(?<![0-9A-Za-z.+)-])(?:\\([0-9]{2,4}\\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
LEFT = 24
# Words before a span that speak for its kind, or for a plain number.
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "\\bip\\b|server|host|address|adresse|login",
    "card": "card|visa|master|amex|credit|kredit|carte|tarjeta|konto|zahlung",
    "phone": "phone|\\btel|mobile|\\bcell|call|fax|handy|anruf|t[eé]l[eé]|m[oó]vil|llama",
}
PLAIN = "version|\\bv$|isbn|issn|order|invoice|page|chapter|part|serial|\\bno[.]? ?$|#$|[$€£] ?$|=\\s*\"?$"
# Endings of common mail domains, first digits of card issuers.
DOMAIN_ENDS = "\\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|at|ch|it|nl)$"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
LABELERS = ("check", "gazetteer", "context", "shape")
FEATURES = ("kind", "checked", "listed", "cue", "digits", "length", "edges", "signs")
ROUNDS = 50
SMOOTH = 0.5


def found(text: Column, pattern: str, hint: Column) -> Column:
    """All matches, leftmost first, as structs (s, e, v, left, next): the text is
    split at them, and the parts' lengths add up to the positions. ``hint`` is a
    cheap condition without which the pattern cannot match."""
    kind = "array<struct<s:int,e:int,v:string,left:string,next:string>>"

    def placed(x):
        values, gaps = x["v"], x["g"]
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            F.sequence(F.lit(0), F.size(values) - 1), start,
            lambda a, i: F.struct(
                (a["at"] + F.length(F.get(gaps, i)) + F.length(F.get(values, i))).alias("at"),
                F.array_append(a["starts"], a["at"] + F.length(F.get(gaps, i))).alias("starts")),
            lambda a: a["starts"])
        return F.transform(F.arrays_zip(starts.alias("s"), values.alias("v")), lambda m, i: F.struct(
            m["s"].alias("s"), (m["s"] + F.length(m["v"])).alias("e"), m["v"].alias("v"),
            F.lower(F.right(F.get(gaps, i), F.lit(LEFT))).alias("left"),
            F.left(F.get(gaps, i + 1), F.lit(1)).alias("next")))

    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    both = lambda v: F.get(F.transform(
        F.array(F.struct(v.alias("v"), F.split(text, pattern, -1).alias("g"))), placed), 0)
    each = F.get(F.transform(F.array(matches), lambda v: F.when(
        F.size(v) > 0, both(v)).otherwise(F.array().cast(kind))), 0)
    return F.when(hint, each).otherwise(F.array().cast(kind))


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]++", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    n = F.length(d)

    def value(i):
        x = F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def checked(kind: str, v: Column) -> Column:
    """The check that a base span of the kind has to pass."""
    d = digits_of(v)
    if kind == "ip":
        return F.forall(F.split(v, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


HINTS = {"email": "[@]", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]"}
WIDE_HINTS = {"email": "at[)\\]}]", "ip": ":", "card": "[0-9]{4}", "phone": "[0-9]{4}"}


def base_spans(text: Column, kind: str) -> Column:
    all_found = found(text, BASE_PATTERNS[kind], text.rlike(HINTS[kind]))
    return F.filter(all_found, lambda m: checked(kind, m["v"]))


def wide_spans(text: Column, kind: str, taken: Column) -> Column:
    """Candidates beside the base spans: none that shares a sign with one."""
    all_found = found(text, WIDE_PATTERNS[kind], text.rlike(WIDE_HINTS[kind]))
    return F.filter(all_found, lambda m: ~F.exists(
        taken, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))


def _sign(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(kind: str, m: Column) -> dict[str, Column]:
    """Each labeler's vote on a span of ``kind``: 1, -1, or 0 for none."""
    v, d = m["v"], digits_of(m["v"])
    no = F.lit(False)
    cue = m["left"].rlike(CUES[kind])
    plain = m["left"].rlike(PLAIN) & ~cue
    if kind == "email":
        check, listed = _sign(v.contains("@"), no), _sign(F.lower(v).rlike(DOMAIN_ENDS), no)
        shape = _sign(F.length(v) <= 64, F.length(v) > 128)
    elif kind == "ip":
        check = _sign(v.contains(".") | v.contains(":"), no)
        listed = _sign(no, v.rlike("^(?:0|127|255)\\."))
        shape = _sign(F.length(v).between(7, 39), F.length(v) > 39)
    elif kind == "card":
        passes = F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
        check, listed = _sign(passes, ~passes), _sign(d.rlike(ISSUERS), d.rlike("^0"))
        shape = _sign(F.length(d) == 16, F.length(d) < 13)
    else:
        check = _sign(F.length(d).between(9, 15), F.length(d) < 7)
        listed = _sign(v.startswith("+"), no)
        shape = _sign(v.rlike("[ ().-]"), v.rlike("[0-9]{12}"))
    return {"check": check, "gazetteer": listed, "context": _sign(cue, plain), "shape": shape}


def features(kind: str, m: Column) -> dict[str, Column]:
    """Small categories that describe a span and what stands next to it."""
    v, d = m["v"], digits_of(m["v"])
    vote = votes(kind, m)
    edge = F.concat(
        F.when(m["left"].rlike("\\p{L}$"), "a").when(m["left"].rlike("[\\p{N}._/=\"-]$"), "n").otherwise("-"),
        F.when(m["next"].rlike("\\p{L}"), "a").when(m["next"].rlike("[\\p{N}_/=\"-]"), "n").otherwise("-"))
    return {
        "kind": F.lit(kind), "checked": vote["check"].cast("string"), "listed": vote["gazetteer"].cast("string"),
        "cue": vote["context"].cast("string"),
        "digits": F.least(F.length(d), F.lit(20)).cast("string"),
        "length": F.least(F.floor(F.length(v) / 8), F.lit(8)).cast("string"), "edges": edge,
        "signs": F.concat(F.when(v.contains("+"), "+").otherwise(""), F.when(v.contains("("), "(").otherwise(""),
                          F.when(v.contains("-"), "-").otherwise(""), F.when(v.contains(" "), "_").otherwise(""),
                          F.when(v.contains("."), ".").otherwise("")),
    }


def with_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict, dict]:
    """Adds one array column a kind of base spans and one of wider candidates;
    returns their names by kind too."""
    t = fresh("text")
    base, wide, taken = ({k: fresh(f"{n}_{k}") for k in KINDS} for n in ("base", "wide", "taken"))
    every = fresh("every")
    out = docs.withColumn(t, whole_text(text))
    out = out.withColumns({base[k]: base_spans(F.col(t), k) for k in KINDS})
    out = out.withColumn(every, F.concat(*base.values()))
    out = out.withColumns({wide[k]: wide_spans(F.col(t), k, F.col(every)) for k in KINDS})
    return out.drop(t, every), base, wide


def pattern_counts(docs: DataFrame, text: str = "text") -> list[dict]:
    """How many spans of the table show each pattern of votes and features."""
    out, base, wide = with_spans(docs.select(text), text)

    def described(kind: str, names: dict) -> Column:
        return F.transform(names[kind], lambda m: F.struct(
            *[c.alias(f"v_{n}") for n, c in votes(kind, m).items()],
            *[c.alias(f"f_{n}") for n, c in features(kind, m).items()]))

    spans = F.concat(*[described(k, names) for k in KINDS for names in (base, wide)])
    keys = [f"v_{n}" for n in LABELERS] + [f"f_{n}" for n in FEATURES]
    rows = (out.select(F.explode(spans).alias("m")).groupBy(*[F.col("m")[k].alias(k) for k in keys])
            .agg(F.count(F.lit(1)).alias("n")).collect())
    return sorted((r.asDict() for r in rows), key=lambda r: [str(r[k]) for k in keys])


def estimate(rows: list[dict], rounds: int = ROUNDS) -> tuple[list[float], dict]:
    """Expectation-maximisation: each pattern's probability of being personal
    data, and each labeler's rates of voting for, when it votes, on spans that
    are (``hit``) and are not (``false``). It starts from the majority."""
    def clamp(p):
        return min(max(p, 1e-4), 1 - 1e-4)

    vote = [[r[f"v_{n}"] for n in LABELERS] for r in rows]
    p = [clamp(0.5 + 0.4 * sum(v) / len(v)) for v in vote]
    rates: dict = {}
    for _ in range(rounds):
        prior = clamp(sum(q * r["n"] for q, r in zip(p, rows, strict=True)) / max(1, sum(r["n"] for r in rows)))
        for j, name in enumerate(LABELERS):
            hit, false = [SMOOTH * 2, SMOOTH], [SMOOTH, SMOOTH * 2]  # a labeler is held better than chance
            for q, v, r in zip(p, vote, rows, strict=True):
                if v[j]:
                    hit[v[j] < 0] += q * r["n"]
                    false[v[j] < 0] += (1 - q) * r["n"]
            rates[name] = {"hit": clamp(hit[0] / sum(hit)), "false": clamp(false[0] / sum(false))}
        odds = []
        for v in vote:
            x = math.log(prior / (1 - prior))
            for j, name in enumerate(LABELERS):
                a, b = rates[name]["hit"], rates[name]["false"]
                x += (math.log(a / b) if v[j] > 0 else math.log((1 - a) / (1 - b)) if v[j] < 0 else 0.0)
            odds.append(x)
        p = [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in odds]
    return p, rates


def train(rows: list[dict], p: list[float]) -> tuple[float, dict]:
    """Naive Bayes weights from patterns with probabilities: the prior's log
    odds, and by (feature, value) its log likelihood ratio."""
    yes = sum(q * r["n"] for q, r in zip(p, rows, strict=True)) + SMOOTH
    no = sum((1 - q) * r["n"] for q, r in zip(p, rows, strict=True)) + SMOOTH
    sums: dict = {}
    for q, r in zip(p, rows, strict=True):
        for f in FEATURES:
            s = sums.setdefault((f, r[f"f_{f}"]), [SMOOTH, SMOOTH])
            s[0] += q * r["n"]
            s[1] += (1 - q) * r["n"]
    return math.log(yes / no), {k: math.log(a / yes) - math.log(b / no) for k, (a, b) in sorted(sums.items())}


def fit(docs: DataFrame, text: str = "text") -> tuple[float, dict]:
    rows = pattern_counts(docs, text)
    return train(rows, estimate(rows)[0]) if rows else (-1.0, {})


def is_personal(kind: str, m: Column, model: tuple[float, dict]) -> Column:
    """The trained classifier's decision on a span, as a column expression."""
    prior, weights = model
    total = F.lit(prior)
    for name, value in features(kind, m).items():
        known = [(v, w) for (f, v), w in weights.items() if f == name]
        term = None
        for v, w in known:
            term = (F.when if term is None else term.when)(value == v, F.lit(w))
        if term is not None:
            total = total + term.otherwise(F.lit(0.0))
    return total >= 0


def detect(docs: DataFrame, model: tuple[float, dict], text: str = "text") -> tuple[DataFrame, dict, str]:
    """Adds one array column of base spans a kind, and one of all spans (kind,
    s, e) ordered by kind as listed, then start; returns the names."""
    out, base, wide = with_spans(docs, text)
    all_spans = fresh("spans")

    def of_kind(kind: str) -> Column:
        added = F.filter(wide[kind], lambda m: is_personal(kind, m, model))
        place = lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))
        sorted_ = F.array_sort(F.concat(F.transform(base[kind], place), F.transform(added, place)))
        return _named(kind, sorted_)

    out = out.withColumn(all_spans, F.concat(*[of_kind(k) for k in KINDS]))
    return out.drop(*wide.values()), base, all_spans


def _named(kind: str, spans) -> Column:
    return F.transform(spans, lambda m: F.struct(
        F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(
        ":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts by kind, the digest of the base spans, and all spans."""
    results = (*[f"n_{k}" for k in KINDS], "base_sha256", "spans")
    columns = [c for c in docs.columns if c not in results or c == text]
    out, base, spans = detect(docs, fit(docs, text), text)
    plain = F.concat(*[_named(k, base[k]) for k in KINDS])
    return out.select(
        *columns, *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, spans that
    overlap by the first one's; ``n_chars`` is set anew where there is one."""
    columns = docs.columns
    out, base, spans = detect(docs, fit(docs, text), text)
    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    whole = F.col(text)

    def put(a, m):
        part = F.concat(F.substring(whole, a["at"] + 1, m["s"] - a["at"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))
        return F.struct(
            F.when(m["s"] < a["at"], a["parts"]).otherwise(F.array_append(a["parts"], part)).alias("parts"),
            F.greatest(a["at"], m["e"]).alias("at"))

    cleaned = F.when(F.size(spans) > 0, F.aggregate(ordered, start, put, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substring(whole, a["at"] + 1, F.length(whole))))).otherwise(whole)
    out = out.withColumn(text, cleaned)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    return out.select(*columns)
