import re
import time

import pytest
from pyspark.sql import functions as F

from loanlens.llm import quality_rules as qr

SPACES = "[ \t\n\x0b\x0c\r]+"


def brute(text):
    t = text or ""
    words = [w for w in re.split(SPACES, t) if w]
    lines = [x for x in t.split("\n") if re.split(SPACES, x) != [""] and any(re.split(SPACES, x))]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


TEXTS = [None, "", "   \n\t", "one", "a b c d e", "a b c d e a b c d e", "a " * 40,
         "x y z w v u " * 7 + "x y z", "line\nline\nline\n\n", "é😀 ß\x0bß\x0cç\r\nend", "#*$ %& |<>",
         "nbsp\xa0joins and so on", "word " * 20000, "w%d " * 3 + " ".join(f"w{i}" for i in range(5000))]


def test_measures_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in qr.judge(df).collect()}
    for i, t in enumerate(TEXTS):
        n, chars, signs, dup, rep = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, signs, dup, rep), t
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)


def test_order_changes_no_verdict_and_cascade_stops_early(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    planned = qr.plan_cascade(docs)
    assert sorted(e.rule.name for e in planned) == sorted(r.name for r in qr.RULES)
    scores = [e.rejection_per_cost for e in planned]
    assert all(a >= b / 2 for a, b in zip(scores, scores[1:]))
    out, m = qr.measure(docs)
    a = out.select(qr.first_rejection(m, qr.RULES).isNull().alias("k"), "doc_id")
    b = out.select(qr.first_rejection(m, qr.RULES[::-1]).isNull().alias("k"), "doc_id")
    assert a.exceptAll(b).isEmpty()
    # a rule behind one that always rejects is never evaluated
    broken = qr.Rule("broken", lambda m: F.raise_error(F.lit("evaluated")).cast("boolean"))
    always = qr.Rule("always", lambda m: m("n_words") >= 0)
    got = out.select(qr.first_rejection(m, (always, broken)).alias("r")).distinct().collect()
    assert [r.r for r in got] == ["always"]


def test_measures_of_later_rules_are_not_computed(spark):
    """A rule's own measure is part of its branch: it runs on the rows that
    reach the rule, and on no other."""
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = {"clean": clean, "junk": clean.upper() + " BOOM", "few": "BOOM few words"}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    trap = qr.Rule("trap", lambda m: F.when(m("text").contains("BOOM"), F.raise_error(F.lit("computed")).cast("boolean"))
                   .otherwise(F.lit(False)))
    out, m = qr.measure(df)

    def verdicts(rules):
        reason = F.when(qr.base_failed(m), F.lit("base")).otherwise(qr.first_rejection(m, rules))
        return {r.name: r.by for r in out.select("name", reason.alias("by")).collect()}

    by_name = {r.name: r for r in qr.RULES}
    assert verdicts([by_name["shouting"], trap]) == {"clean": None, "junk": "shouting", "few": "base"}
    with pytest.raises(Exception, match="computed"):
        verdicts([trap, by_name["shouting"]])
    plan = qr.judge(df, sample_rows=10).select("kept")._jdf.queryExecution().optimizedPlan().toString()
    upper = [line for line in plan.splitlines() if "p{Lu}" in line]
    assert len(upper) == 1 and "CASE WHEN" in upper[0]  # only inside the cascade


def test_clean_text_stays_and_junk_goes(spark):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    junk = {"symbols": " ".join(f"w{i}$$$" for i in range(60)), "shouting": clean.upper(),
            "stutter": " ".join(w for w in clean.split() for _ in range(2)),
            "few_letters": " ".join(str(10 ** 6 + i) for i in range(60))}
    df = spark.createDataFrame([("clean", clean), ("once_more", clean + "\n" + "Line.\nLine."), *junk.items()],
                               "name string, text string")
    kept = {r.name: r.kept for r in qr.judge(df).collect()}
    assert kept == {"clean": True, "once_more": True} | dict.fromkeys(junk, False)


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_words string, kept string, words string"
    empty = qr.judge(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns.count("kept") == 1
    rows = [(1, "a b", "x", "y", None), (1, "a b", "x", "y", None), (None, None, None, None, None)]
    out = qr.judge(spark.createDataFrame(rows, schema)).collect()
    assert [r.n_words for r in out] == [2, 2, 0] and [r.words for r in out] == [None] * 3


def test_repeats_stay_near_linear(spark):
    text = " ".join(f"w{i % 50000}" for i in range(200000))
    began = time.time()
    r = qr.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_repeat_words == 200000 and time.time() - began < 60
