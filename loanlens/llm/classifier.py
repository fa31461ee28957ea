"""Quality classifier: Bradley-Terry ranking of documents.

Every document's strength is linear in text features. Training pairs set a
document labelled good against one labelled bad; logistic loss on the
difference of their features makes the good one win. The threshold is a
quantile of the training scores: as many documents fall below it as are
labelled bad. Scores are the strengths through a logistic curve placed so that
the threshold scores ``CUT``.

Only texts feed the score. Features are JVM-side expressions over the row's own
text; training takes every labelled row outside the held-out fold (callers may
ask for a bounded hash sample with ``max_labelled``), and scoring is one pass
over all documents without a shuffle. Features of labelled rows, their ranks and
the pairs are tables; the driver sees the weights and the threshold.

Defined results: a null text is an empty one and is scored like any other;
labels that are null are ignored, several of one document are averaged (half or
more is good); with no labels, or only one kind, every document scores ``CUT``;
repeated rows score alike; an empty table gives an empty table; other columns
pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import SPACES, fresh, whole_text, words_of
from loanlens.operators.ranking import exact_quantiles
from loanlens.session import materialize

CUT = 0.3
#: Up to this many labels go to the texts; more meet the texts' features.
BROADCAST_LABELS = 1_000_000
#: Pairs that one task of the fit sums.
PAIRS_A_TASK = 100_000
#: Decimals of a weight: sums of several tasks differ in the last digits with their order.
WEIGHT_DIGITS = 9
ROUNDS = 4
REGULARISATION = 1e-3
FOLDS = 5
RESULTS = ("held_out", "strength", "score", "predicted")


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether an id is kept from training; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def text_features(text: Column, words: Column) -> Column:
    """Array of doubles: junk shows in signs, capitals, stuttered and repeated
    words and lines. Shares are drawn by a few units to what is usual, so that
    very short texts are not taken for extreme ones; length itself is no feature."""
    n = F.size(words).cast("double")
    count = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]++", "")).cast("double")
    chars = F.length(text) + 20.0
    letters = count("\\p{L}") + 20.0
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    dup_lines = F.get(F.transform(F.array(lines), lambda x: (
        F.size(x) - F.size(F.array_distinct(x))) / (F.size(x) + 3.0)), 0)
    stutter = F.size(F.filter(words, lambda x, i: x == F.get(words, i - 1)))
    return F.array(
        count("#*$%&<>") / chars,
        count("|") / chars,
        count("!?") / chars,
        count("\\p{Lu}") / letters,
        stutter / (n + 4.0),
        (F.size(F.array_distinct(words)) + 4.0) / (n + 4.0),
        dup_lines,
        (F.length(F.concat_ws("", words)) + 20.0) / (n + 4.0) / 10.0,
    )


def with_features(docs: DataFrame, text: str, name: str) -> DataFrame:
    t, w = fresh("text"), fresh("words")
    return (docs.withColumn(t, whole_text(text)).withColumn(w, words_of(F.col(t)))
            .withColumn(name, text_features(F.col(t), F.col(w))).drop(t, w))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str,
                    max_labelled: int | None = None) -> DataFrame:
    """(id, good, features) of the labelled training rows: all of them, or about
    ``max_labelled`` by a hash of their id."""
    known = (labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
             .groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).alias("good")))
    n = known.count()
    if max_labelled is not None and n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < int(
            max_labelled / n * 1_000_000))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    if n <= BROADCAST_LABELS:  # the labels go to the texts
        rows = with_features(rows.join(F.broadcast(known), "_id"), "_text", "x")
    else:  # only ids and features are dealt out, no text
        rows = with_features(rows, "_text", "x").select("_id", "x").join(known, "_id")
    return rows.select("_id", "good", "x")


def preference_pairs(sample: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pair, label, features): feature differences of good and bad documents,
    each pair with a number of its own. In each round every document of the larger
    kind meets one of the smaller; every other pair is turned round, so both
    outcomes occur. Ranks come from one global sort by kind and hash: a row's rank
    is its place among its kind's rows of its partition behind those of earlier
    partitions (a window over partitions x kinds)."""
    stamped = materialize(sample.orderBy("good", F.xxhash64("_id"), "_id", F.xxhash64("x")).select(
        "good", "x", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "ranked-sample")
    per = stamped.groupBy("good", "_p").agg(F.count(F.lit(1)).alias("_rows"), F.min("_m").alias("_m0"))
    before = Window.partitionBy("good").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    places = per.select("good", "_p", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_m0")).alias("_o"),
                        F.sum("_rows").over(Window.partitionBy("good")).alias("_n"))
    # one row a partition and kind: at most two for each partition
    ranked = stamped.join(F.broadcast(places), ["good", "_p"]).withColumn("_rank", F.col("_o") + F.col("_m"))
    good, bad = (ranked.where(F.col("good") == v).select(F.col("x").alias(n), F.col("_rank").alias(f"r_{n}"),
                                                          F.col("_n").alias(f"n_{n}"))
                 for v, n in ((True, "g"), (False, "b")))
    sizes = ranked.agg(F.max(F.when(F.col("good"), F.col("_n"))).alias("g"),
                       F.max(F.when(~F.col("good"), F.col("_n"))).alias("b")).first()
    many, few = ("g", "b") if (sizes["g"] or 0) >= (sizes["b"] or 0) else ("b", "g")
    sides = {"g": good, "b": bad}
    meets = sides[many].withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn(
        "other", (F.col(f"r_{many}") + F.col("round") * 7919) % F.lit(max(1, sizes[few] or 0)))
    pairs = meets.join(sides[few], F.col("other") == F.col(f"r_{few}"))
    turned = (F.col(f"r_{many}") + F.col("round")) % 2
    difference = F.zip_with("g", "b", lambda a, b: F.when(turned == 0, a - b).otherwise(b - a))
    number = F.col("round") * F.col(f"n_{many}") + F.col(f"r_{many}")
    return pairs.select(number.alias("pair"), (1 - turned).cast("double").alias("label"),
                        array_to_vector(difference).alias("features"))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text",
        doc_id: str = "doc_id", max_labelled: int | None = None) -> tuple[list[float], float]:
    """(weights, threshold): a document's strength is weights . features. Learnt
    from every labelled training row unless ``max_labelled`` bounds them."""
    sample = materialize(labelled_sample(docs, labels, label, text, doc_id, max_labelled), "labelled")
    kinds = {r["good"]: r["n"] for r in sample.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return [], 0.0
    # pairs are dealt to tasks by their number and summed there in one order; what is left to chance is
    # the order of the tasks' sums, which the rounding takes away
    tasks = -(-max(kinds.values()) * ROUNDS // PAIRS_A_TASK)
    pairs = preference_pairs(sample).repartition(tasks, "pair").sortWithinPartitions("pair").persist()
    try:
        model = LogisticRegression(fitIntercept=False, regParam=REGULARISATION, maxIter=60).fit(pairs)
    finally:
        pairs.unpersist()
    weights = [round(float(w), WEIGHT_DIGITS) for w in model.coefficients]
    bad_share = kinds[False] / (kinds[True] + kinds[False])
    strengths = sample.select(strength(F.col("x"), weights).alias("s"))
    return weights, exact_quantiles(strengths, "s", [bad_share])[0]


def strength(features: Column, weights: list[float]) -> Column:
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.get(features, i) * F.lit(w)
    return total


def classify(docs: DataFrame, weights: list[float], threshold: float, *, text: str = "text",
             doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out``, ``strength``, ``score`` and ``predicted``
    (1 if the strength reaches the threshold, so if the score reaches CUT)."""
    x = fresh("x")
    columns = [c for c in docs.columns if c not in RESULTS]
    out = with_features(docs.select(*columns), text, x).withColumn("strength", strength(F.col(x), weights)).drop(x)
    gap = F.col("strength") - F.lit(threshold)
    curve = F.lit(1.0) / (1.0 + F.lit((1 - CUT) / CUT) * F.exp(-gap))
    # at the threshold the curve gives CUT up to rounding; the sign of the gap decides
    out = out.withColumn("score", F.when(gap >= 0, F.greatest(curve, F.lit(CUT))).otherwise(
        F.least(curve, F.lit(CUT - 1e-12))))
    return out.withColumn("held_out", held_out(F.col(doc_id))).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, weights: list[float], threshold: float, **columns) -> DataFrame:
    """The documents of ``docs`` that are predicted good, in its own columns.

    The counts observed on the way also hold the filter above the scores: pushed
    below them it would compute a document's features once for every place where
    the score mentions them."""
    kept = [F.col(c) for c in docs.columns]
    verdict, row = fresh("verdict"), fresh("row")
    whole = docs.select(F.struct(*kept).alias(row), *[F.col(c) for c in {
        columns.get("text", "text"), columns.get("doc_id", "doc_id")}])
    scored = classify(whole, weights, threshold, **columns).withColumn(verdict, F.col("predicted") == 1)
    counted = scored.observe("quality classifier", F.count(F.lit(1)).alias("scored"),
                             F.count_if(F.col(verdict)).alias("kept"))
    return counted.where(F.col(verdict)).select(*[F.col(row)[c].alias(c) for c in docs.columns])
