import hashlib
import random
import re
import time

from loanlens.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        total = sum(x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9) for i, x in enumerate(map(int, reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if passes(k, m.group())]


FIXED = [None, "", "a@b.co_x@d.e", "1.2.3.4.5.6.7.8", "é" * 50 + "😀a.b@c.de", "0001.002.3.255 256.1.1.1",
         "mail x@y.z.w, 10.0.0.1, 4111 1111 1111 1111, +1 (017) 555-7713", "4111111111111112", "+1 2 3 4 5 6 7 8 9",
         "tel: (017) 555-7713 today", "joe (at) example (dot) com", "a@b a@@b.c @x.y", "1-2-3 4", "9" * 40]


def texts():
    rnd = random.Random(5)
    signs = "0123456789" * 3 + "..@@+-- ()ab_%\né😀"
    return FIXED + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(800)]


def test_base_spans_match_plain_patterns(spark):
    all_texts = texts()
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in enumerate(all_texts):
        want, r = brute(t), rows[i]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {tuple(s) for s in spans} >= {(k, str(a), str(b)) for k, a, b in want}
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in spans]
        assert order == sorted(order)


def test_unreliable_labelers_are_found_out():
    rng, rows = random.Random(1), {}
    for _ in range(4000):
        true = rng.random() < 0.5
        right = {"check": 0.97, "gazetteer": 0.9, "context": 0.5, "shape": 0.85}
        v = tuple((1 if true else -1) * (1 if rng.random() < right[n] else -1) for n in pii.LABELERS)
        rows[v] = rows.get(v, 0) + 1
    counted = [{f"v_{n}": x for n, x in zip(pii.LABELERS, v)} | {"n": n} for v, n in sorted(rows.items())]
    p, rates = pii.estimate(counted)
    assert abs(rates["context"]["hit"] - rates["context"]["false"]) < 0.1
    assert rates["check"]["hit"] > 0.9 > 0.2 > rates["check"]["false"]
    by = {tuple(r[f"v_{n}"] for n in pii.LABELERS): q for r, q in zip(counted, p)}
    assert by[(1, 1, 1, 1)] > 0.9 and by[(-1, -1, -1, -1)] < 0.1


def test_classifier_adds_likely_spans_only(spark):
    plenty = [f"call +1 (20{i % 10}) 555-0{100 + i}" for i in range(60)] + ["serial 1234567890123456 here"] * 20
    plenty += [f"write to user.{i}@mail.example.com" for i in range(60)]
    df = spark.createDataFrame([(t,) for t in plenty + FIXED], "text string")
    spans = {r.text: r.spans for r in pii.report(df).collect()}
    assert spans["tel: (017) 555-7713 today"] == "phone:5:19"
    assert spans["joe (at) example (dot) com"] == "email:0:26"
    assert spans["serial 1234567890123456 here"] == "" and spans["4111111111111112"] == ""


def test_redaction(spark):
    rows = [(1, "mail x@y.z.w, 10.0.0.1 and é 4111 1111 1111 1111!", "k", 0), (2, None, "k", 0), (3, "clean é text", "k", 0),
            (4, "+10.0.0.1234567 x", "k", 0)]
    out = {r.doc_id: r for r in pii.redact(spark.createDataFrame(
        rows, "doc_id long, text string, spans string, n_chars long")).collect()}
    assert out[1].text == "mail [EMAIL], [IP] and é [CARD]!" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean é text" and out[3].spans == "k"
    assert out[4].text == "[PHONE] x"


def test_long_runs_are_linear(spark):
    hard = ["a" * 300000, "1" * 300000, "a.b" * 100000 + "@", "1." * 100000, "x@" + "a." * 100000, "+1" + " (" * 100000]
    began = time.time()
    rows = pii.report(spark.createDataFrame([(t,) for t in hard], "text string")).collect()
    assert time.time() - began < 60 and sum(r.n_ip for r in rows) == 25000


def test_empty_table(spark):
    out = pii.report(spark.createDataFrame([], "doc_id long, text string, n_ip string"))
    assert out.count() == 0 and dict(out.dtypes)["n_ip"] == "bigint"
