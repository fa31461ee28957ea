import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loanlens.llm import spelling

DOCS = "doc_id long, text string, word string, n int, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def brute(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(w, v) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(spark, rows, **options):
    got = spelling.variants(frame(spark, rows), **options).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def corpus(seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("aeinrstéÉ÷") for _ in range(draw.randint(4, 8))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = draw.choice(base[:int(draw.random() ** 2 * 59) + 1])
            k = draw.randrange(len(w))
            words.append(draw.choice([w] * 8 + [w.upper(), w[:k] + w[k + 1:], w[:k] + draw.choice("aeX") + w[k:],
                                               w[:k] + draw.choice("ns") + w[k + 1:], w[::-1]]))
        rows.append((i, draw.choice([" ", ", ", "_", "1"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"node_rows": 40}), (3, {"node_rows": 1})])
def test_against_all_pairs(spark, seed, options):
    """Large nodes are opened level by level, down to the gapped words."""
    rows = corpus(seed)
    want = brute(rows)
    assert found(spark, rows, **options) == want
    assert sum(v[0] is not None for v in want.values()) > 20


def test_words_of_the_same_letters(spark):
    words = ["".join(p) for p in __import__("itertools").permutations("abcde")] + ["abcdea", "abcd", "xbcde", "xbcdea"]
    rows = [(i, " ".join(words)) for i in range(5)]
    want = brute(rows)
    assert found(spark, rows) == want and found(spark, rows, node_rows=10) == want


def test_one_edit_against_distance():
    draw = random.Random(3)
    for _ in range(4000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)


def test_pairs_of_a_node_at_every_table_size(monkeypatch):
    """The search by subtrees, by tables and by parts of tables finds the same."""
    import numpy as np
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 6))) for _ in range(250)} | {"a" * 90, "a" * 91})
    vec = np.array([[w.count(c) for c in "abc"] for w in words])
    want = {(a, b) for a in words for b in words if a < b and distance(a, b) == 1}
    for size in (1, 30, 500, 10 ** 6):
        monkeypatch.setattr(spelling, "MEETINGS_AT_ONCE", size)
        monkeypatch.setattr(spelling, "PAIRS_AT_ONCE", 1 + size // 3)
        # every word visits as itself and from every budget that leads to the top node
        i, j = spelling.node_pairs(words, vec, np.zeros(len(words), np.int64))
        got = [tuple(sorted((words[a], words[b]))) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == want


def test_nulls_repeated_rows_long_texts_and_ties(spark):
    rows = [(None, "Alpha alpha ALPHA alphb alphb alphb"), (None, None), (1, ""), (2, "gamma " * 30_000 + "x" * 5000),
            (2, "gamma " * 3 + "gamme " * 3 + "gammi " * 3), (2, "gamma " * 3), (3, ("q" * 5000 + " ") * 3),
            (3, "École école ÉCOLE École " * 3), (4, "amber " * 40 + "ambxr " * 9 + "abxr abxrs abxrs abxrs " * 4)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got["alpha"][:2] == (None, "alpha") and got["alpha"][3] == 1  # as frequent as its near word: no form
    assert got["École"][3] == 1
    assert got["abxrs"][:2] == (None, "abxrs") and got["ambxr"][:2] == ("amber", "amber")
    chain = [(1, "amber " * 40 + "ambxr " * 15 + "ambxrs " * 4)]
    assert found(spark, chain) == brute(chain) and found(spark, chain)["ambxrs"][:2] == ("ambxr", "amber")


def test_empty_table_and_no_frequent_words(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, "once only words here")]) == {}


def test_chains_lead_to_the_last_form(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5")]
    out = dict(spelling.roots(spark.createDataFrame(links, "word string, form string")).collect())
    assert set(out.values()) == {"w37"} and len(out) == 38
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_groups_hold_every_letter_once(spark):
    words = spark.createDataFrame([("zebra",), ("école",), ("aaaaa",)], "word string")
    dealt = spelling.letter_groups(words)
    assert sorted("".join(dealt)) == sorted(set("zebraécoleaaaaa")) and len(dealt) == spelling.GROUPS
    v = words.select(spelling.group_counts(F.col("word"), dealt).alias("v")).collect()
    assert [sum(r.v) for r in v] == [5, 5, 5]
