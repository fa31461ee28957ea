import random
import re

from loanlens.llm import license_scan as ls


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w, starts, labels = words(text), [], set()
    for phrase, label in ls.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


FIXED = [None, "", "the", "Released under the MIT License.", "THE-MIT_LICENSE the mit license the mit license",
         "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc by nc", "the mit licenseé", "éthe mit license",
         "the mİt license", "the miT licenſe", "apacHe license version 2", "x " * 30000 + "cc by nc", "\x00the\x7fmit license"]


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in ls.scan(df).collect()}


def test_base_places_match_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = "the The mit MIT license apache version 2 cc by nc é".split()
    texts = FIXED + ["".join(rnd.choice(vocabulary) + rnd.choice(" \n-.") for _ in range(40)) for _ in range(300)]
    rows = scanned(spark, texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
       " documentation files (the Software)")


def test_spans_survive_words_put_in_or_left_out(spark):
    w = MIT.split()
    altered = [" ".join(w[:8] + ["really"] + w[8:]), " ".join(w[:9] + w[10:]), " ".join(w[:5] + ["x", "y"] + w[5:])]
    spread = " filler words in between here ".join(" ".join(w[i:i + 3]) for i in range(0, len(w), 3))
    rows = scanned(spark, [MIT, *altered, " ".join(w[:5]), spread, "GNU General Public License, version 3."])
    assert [rows[i].labels for i in range(7)] == ["mit"] * 4 + ["", "", "gpl-3"]
    assert rows[0].score == 1.0 and 0.6 <= rows[1].score <= 1 and rows[0].base_labels == ""


def test_copies_share_a_result(spark):
    rows = [(1, FIXED[3], "x"), (1, FIXED[3], "x"), (None, FIXED[3], None), (4, None, None)]
    out = ls.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted(r.n_base for r in out) == [0, 1, 1, 1]


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string, key string")).count() == 0


#: The three phrases as the contract states them.
CONTRACT = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def test_base_phrases_are_those_of_the_contract(spark):
    assert ls.PHRASES == CONTRACT
    texts = ["Released under the MIT License.", "the MIT license", "x the MIT license, under the MIT license y",
             "Under the Apache License, Version 2.0", "under CC-BY-NC", "under the the mit license",
             "under the mit license under the mit license"]
    want = [(1, 1, 1, "mit"), (0, None, None, ""), (1, 4, 4, "mit"), (1, 2, 2, "apache-2"), (1, 1, 1, "cc-by-nc"),
            (0, None, None, ""), (2, 0, 4, "mit")]
    rows = scanned(spark, texts)
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in map(rows.get, range(len(texts)))] == want
    assert [rows[i].labels for i in range(len(texts))] == ["mit"] * 3 + ["apache-2", "cc-by-nc", "mit", "mit"]
