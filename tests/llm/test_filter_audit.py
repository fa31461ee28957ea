import itertools
import random

from pyspark.sql import functions as F

from loanlens.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask string, part int, n long"
LABELS = "doc_id long, quality int, toxic int, good string"


def brute(rows, labels):
    """The report, each document sent through every order."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    report = {}
    for i, text, lang in rows:
        text, part = text or "", lang or ""
        words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text) if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                r = report.setdefault((part, "".join(order), step), [0] * 7)
                now = fails[x] and not gone
                r[2] += fails[x] and gone
                r[3] += fails[x] and sum(fails.values()) == 1
                gone = gone or fails[x]
                r[0] += not gone
                r[1] += now
                r[4] += now and i in good
                r[5] += now and i in toxic
    for part in {p for p, _, _ in report}:
        for x in "ABCDE":
            total = sum(r[1] for (p, o, s), r in report.items() if p == part and o[s - 1] == x)
            for (p, o, s), r in report.items():
                if p == part and o[s - 1] == x:
                    r[6] = total
    return report


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, 5) for r in rows], SCHEMA)
    said = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    out = filter_audit.audit(docs, said).collect()
    assert len({(r.part, r.filter_order, r.step) for r in out}) == len(out)
    return {(r.part, r.filter_order, r.step): [r[m] for m in (*filter_audit.MEASURES, "shapley")] for r in out}


def test_every_order_against_documents_sent_through_it(spark):
    draw = random.Random(5)
    kinds = [lambda: " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(110)),
             lambda: " ".join(f"w{draw.randrange(30)}" for _ in range(120)),
             lambda: " ".join(f"W{draw.choice('ABC')}{draw.randrange(99999)}" for _ in range(130)),
             lambda: "short # text", lambda: "SHORT", lambda: "a copy that many rows share " * 4]
    rows = [(i, draw.choice(kinds)(), draw.choice(["en", "de", None])) for i in range(90)]
    rows += [(200 + i, draw.choice(rows)[1], "en") for i in range(30)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 240, 2)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_nulls_ties_and_repeated_rows(spark):
    long = "word " * 40_000 + "#"
    rows = [(None, None, None), (None, "", "en"), (3, "", "en"), (3, "", "en"), (3, "", "de"), (4, None, "en"),
            (5, long, "en"), (9, long, None), (9, "other", "en"), (-1, long, "fr"), (-1, long, "fr")]
    labels = [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9, 1, None), (77, 1, 1)]
    got = audited(spark, rows, labels)
    assert got == brute(rows, labels)
    assert got["en", "EABCD", 1][1] == 2  # ids 4 and 5; id 3 is nobody's later copy


def test_words_split_at_ascii_space_only(spark):
    nbsp = " ".join("x" * 100)
    assert audited(spark, [(1, nbsp, "en")], []) == brute([(1, nbsp, "en")], [])


def test_empty_table(spark):
    assert audited(spark, [], []) == {}


def test_hot_text_meets_as_counts(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"))
    none = spark.createDataFrame([], LABELS)
    r = filter_audit.audit(docs, none).where("filter_order = 'EABCD' and step = 1").first()
    assert (r.kept, r.removed) == (1001, 1999)
