"""Quality rules as a short-circuit cascade.

A rule is a named rejection condition over the columns of ``measure``. On a
bounded sample each rule's cost (seconds a row) and selectivity (share of rows
it rejects) are measured; the cascade then tests the rules in the order of
rejections per second and stops at the first that rejects. The order changes
the work, never the verdict. Everything is JVM-side column expressions over the
row's own text: no shuffle, no Python.

Defined results: a null text counts as an empty one (no words: it fails the
base rule of ten words); any other column may be null, clash with names used
here (the measures are kept in one struct column of a fresh name) or be absent;
repeated rows are judged alike; an empty table gives an empty table, in the
order in which the rules were given.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import fresh, whole_text, words_of, SPACES

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Rule:
    """``reject(m)`` gives the condition, ``m(name)`` being a measure."""
    name: str
    reject: object


@dataclass(frozen=True)
class RuleEstimate:
    rule: Rule
    seconds_per_row: float
    rejected_share: float

    @property
    def rejection_per_cost(self) -> float:
        return self.rejected_share / max(self.seconds_per_row, 1e-9)


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words lying in a ``width``-word window that the text holds
    twice or more (the first occurrence counts too).

    Window hashes settle texts without any repeated window; where two hashes
    agree the windows themselves are compared, so the count is exact. Linear
    without repeats, n log n with them.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[
        F.get(words, i + k) for k in range(width)]))
    exact = _covered(F.array_sort(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", F.slice(words, i + 1, width)).alias("w"), i.alias("i")))), width)
    return (F.when(n < width + 1, F.lit(0))
            .when(F.size(F.array_distinct(hashes)) == n - (width - 1), F.lit(0))
            .otherwise(exact).cast("long"))


def _covered(by_window: Column, width: int) -> Column:
    """Words under the equal neighbours of a sorted array of (w, i)."""
    def repeated(s):
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k:
                     F.coalesce(F.get(s, k - 1)["w"] == F.get(s, k)["w"], F.lit(False))
                     | F.coalesce(F.get(s, k + 1)["w"] == F.get(s, k)["w"], F.lit(False))),
            lambda k: F.get(s, k)["i"])

    def total(starts):
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"),
                                  i.alias("last")),
            lambda a: a["n"])

    # one-element arrays stand in for "let": each value is computed once
    return F.get(F.transform(F.array(by_window), lambda s: total(F.array_sort(repeated(s)))), 0)


def measure(docs: DataFrame, text: str = "text"):
    """``docs`` with the base measures under fresh names, and what gives a
    measure by its plain name. A measure that only rules need is no column but
    an expression over the row's text: it is computed where a rule's branch
    mentions it, and only for rows that reach that branch."""
    t, w = fresh("text"), fresh("words")
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    length_of = lambda others: F.length(F.regexp_replace(t, others, "")).cast("long")
    out = docs.withColumn(t, whole_text(text)).withColumn(w, words_of(F.col(t)))
    base = {
        "n_words": F.size(w),
        "word_chars": F.length(F.concat_ws("", w)),
        "n_symbols": length_of("[^#*$%&|<>]++"),
        "n_dup_lines": F.get(F.transform(
            F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 0),
        "n_repeat_words": repeated_window_words(F.col(w)),
    }
    by_rule = {
        "n_lines": F.size(lines).cast("long"),
        "n_stutter": F.size(F.filter(F.col(w), lambda x, i: x == F.get(F.col(w), i - 1))).cast("long"),
        "n_letters": length_of("[^\\p{L}]++"),
        "n_upper": length_of("[^\\p{Lu}]++"),
        "n_shouts": length_of("[^!]++"),
        "text": F.col(t),
    }
    names = {k: fresh(k) for k in base}
    out = out.withColumns({names[k]: v.cast("long") for k, v in base.items()})
    return out, lambda k: by_rule[k] if k in by_rule else F.col(names[k])


def base_failed(m) -> Column:
    return (m("n_words") < MIN_WORDS) | (
        100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words"))


#: The rules beyond the base ones. Each compares whole-text counts.
RULES = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("stutter", lambda m: 10 * m("n_stutter") > 3 * m("n_words")),
    Rule("shouting", lambda m: 2 * m("n_upper") > m("n_letters")),
    Rule("exclamation", lambda m: 4 * m("n_shouts") > m("n_words")),
    Rule("few_letters", lambda m: 10 * m("n_letters") < 6 * m("word_chars")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words"))
         | (m("word_chars") > 20 * m("n_words"))),
)


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = 2000,
                 seed: int = 7) -> list[RuleEstimate]:
    """Measures every rule on a seeded sample of about ``sample_rows`` rows
    (fixed bound, whatever the table) and returns the rules ordered by
    rejections per second, best first. Gains within a factor of two count as
    equal and keep the given order, so that timings that wander do not turn it.

    Each rule is timed from the raw text, as if it ran first, so a rule over a
    costly measure pays for it; a run before makes the code.
    """
    total = docs.count()
    if total == 0:
        return [RuleEstimate(r, 0.0, 0.0) for r in rules]
    sample = docs.sample(min(1.0, sample_rows / total), seed=seed).persist()
    try:
        n = max(1, sample.count())
        measured, m = measure(sample)
        found = []
        for rule in rules:
            tried = measured.select(F.sum(rule.reject(m).cast("long")).alias("hits"))
            tried.first()
            began = time.perf_counter()
            hits = tried.first()["hits"]
            found.append(RuleEstimate(rule, (time.perf_counter() - began) / n, (hits or 0) / n))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda e: -math.frexp(e.rejection_per_cost)[1] if e.rejection_per_cost else math.inf)


def first_rejection(m, ordered) -> Column:
    """Name of the first rule, in cascade order, that rejects; null if none.
    ``CASE WHEN`` stops at the first true branch and rules hold their own
    measures, so later rules cost nothing for rows already rejected."""
    chain = None
    for rule in ordered:
        chain = (F.when if chain is None else chain.when)(rule.reject(m), F.lit(rule.name))
    return chain if chain is not None else F.lit(None).cast("string")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "base_failed", "kept", "rejected_by")


def judge(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept`` and ``rejected_by`` (the first
    rejecting rule in the planned order, which may differ between runs, unlike
    ``kept``; ``base`` for the base ones). Input columns of those names are
    replaced."""
    ordered = [e.rule for e in plan_cascade(docs, rules, sample_rows)]
    columns = [c for c in docs.columns if c not in RESULTS]
    out, m = measure(docs)
    reason = F.when(base_failed(m), F.lit("base")).otherwise(first_rejection(m, ordered))
    out = out.withColumn("rejected_by", reason)
    return out.select(*columns, *[m(c).alias(c) for c in RESULTS[:5]], base_failed(m).alias("base_failed"),
                      F.col("rejected_by").isNull().alias("kept"), "rejected_by")


SQL = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select rid, i, array_to_string(w[i:i + 4], ' ') as g
    from (select rid, w, unnest(generate_series(1, len(w) - 4)) as i from w where len(w) >= 5)),
r as (select rid, count(distinct i + k) as n_repeat_words
    from (select rid, i, count(*) over (partition by rid, g) as c from g), (select unnest(range(5)) as k)
    where c > 1 group by rid),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) as n_stutter,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as n_letters,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as n_upper,
    length(regexp_replace(text, '[^!]+', '', 'g')) as n_shouts
    from w left join r using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or 10 * n_stutter > 3 * n_words
        or 2 * n_upper > n_letters or 4 * n_shouts > n_words or 10 * n_letters < 6 * word_chars
        or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from b"""
