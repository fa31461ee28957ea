"""Toxicity by compression distance.

Two zstandard dictionaries are learned, one from toxic text and one from ordinary
text. A window (a run of ``window_words`` words, one by default) is compressed
with either; the bytes that the toxic dictionary saves over the ordinary one
are its distance. A document's distances become a few numbers: its largest
distances, and how many and what share of its windows reach thresholds that few
ordinary windows reach. A logistic curve over them, calibrated on documents
that the dictionaries did not see, gives the score, which is ``CUT`` where a
clean document lost weighs as much as a toxic one missed.

The ordinary dictionary is trained on the windows of ordinary documents, and
again with those that the first pair of dictionaries took for toxic. A toxic
document is mostly ordinary text, so the toxic dictionary holds the same and
what toxic windows hold beyond it: letter groups found in many more toxic than
ordinary documents than chance allows, which ordinary training leaves out.

Learning uses a sample of labelled rows whose size does not grow with the table:
at most about ``max_labelled`` documents of each kind, taken by a hash of the
id, none longer than ``max_chars``. It is gathered on the driver; two thirds of
it make the dictionaries and one third calibrates.
Scoring is one pass over all documents without a shuffle: every window of every
whole text is measured, and a worker remembers the distance of windows that
recur (a bounded cache).

Defined results: a null text is an empty one; a text without words scores like
one without toxic windows; null labels are ignored, several of one document are
averaged (half or more is toxic); null ids are held out and never learned from;
with no labels, or one kind only, every score is 0; repeated rows score alike;
an empty table gives an empty table; other columns pass through, those named
like a result are replaced.
"""

from __future__ import annotations

import collections
import math
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import whole_text

CUT = 0.5
HELD_OUT_FOLDS = 5
MAX_LABELLED = 1_500
MAX_CHARS = 50_000
#: One document of so many calibrates, the others are what the dictionaries hold.
PARTS = 3
CLEAN_WEIGHT = 3.0  # a clean document taken for toxic counts as this many toxic ones missed
WORD = re.compile(r"[^\W\d_]+")
#: Letters (with the spaces around a word) that a toxic window is known by.
GROUP_LETTERS = range(4, 13)
MIN_DOCUMENTS = 3
MIN_GAIN = 25.0  # twice the log likelihood ratio of "more in toxic documents"
MIN_RATIO = 4.0
SIZE = 4096
LEVEL, MIN_MATCH = 9, 4
#: Bytes saved from which windows are counted.
THRESHOLDS = (2, 3, 4)
N_NUMBERS = 3 + 2 * len(THRESHOLDS)
#: Follows every window and ends both dictionaries: without it zstandard would
#: store so short an input as it is, and look for no match in its last bytes.
TAIL = bytes(range(1, 25))
CACHE_ENTRIES = 500_000
RESULTS = ("held_out", "score", "predicted")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(True))


def windows(text: str, words: int = 1) -> list[str]:
    found = WORD.findall(text.lower())
    if words == 1:
        return [f" {w} " for w in found]
    return [f" {' '.join(found[i:i + words])} " for i in range(max(1, len(found) - words + 1))] if found else []


def letter_groups(text: str, n: int) -> set[str]:
    return {text[i:i + n] for i in range(len(text) - n + 1)}


def gain(v: int, o: int, toxic: int, ordinary: int) -> float:
    """Twice the log likelihood ratio of ``v`` toxic and ``o`` ordinary documents
    against a share by chance; 0 where they are not clearly more toxic ones."""
    if v < MIN_DOCUMENTS or v * ordinary < MIN_RATIO * o * toxic:
        return 0.0
    share = toxic / (toxic + ordinary)
    return 2 * (v * math.log(v / ((v + o) * share)) + (o * math.log(o / ((v + o) * (1 - share))) if o else 0))


def telling_groups(toxic: list[set[str]], ordinary: list[set[str]]) -> list[str]:
    """Letter groups found in more toxic documents than chance allows. The one
    of largest gain comes first; then those that still stand out among the
    windows without it, and so on."""
    # windows begin and end with a space: two spaces mark where one ends
    texts = [["".join(sorted(ws)) for ws in side] for side in (toxic, ordinary)]
    both: dict[str, list[int]] = {}
    for n in GROUP_LETTERS:
        own = collections.Counter(g for text in texts[0] for g in letter_groups(text, n))
        own = {g: v for g, v in own.items() if v >= MIN_DOCUMENTS and "  " not in g}
        other = collections.Counter(g for text in texts[1] for g in letter_groups(text, n) & own.keys())
        both |= {g: [v, other[g]] for g, v in own.items()
                 if gain(v, other[g], len(toxic), len(ordinary)) >= MIN_GAIN}
    holding = {w: [g for n in GROUP_LETTERS for g in letter_groups(w, n) if g in both] for w in set().union(*toxic)}
    left = [{w for w in ws if holding[w]} for ws in toxic]
    windows_of = [collections.Counter(g for w in ws for g in holding[w]) for ws in left]
    found: list[str] = []
    while both:
        best = max(both, key=lambda g: (round(gain(*both[g], len(toxic), len(ordinary)), 6), len(g), g))
        if gain(*both[best], len(toxic), len(ordinary)) < MIN_GAIN:
            break
        found.append(best)
        for ws, counts in zip(left, windows_of, strict=True):
            for w in [w for w in ws if best in w]:
                ws.remove(w)
                for g in holding[w]:
                    counts[g] -= 1
                    if not counts[g] and g in both:
                        both[g][0] -= 1
        both.pop(best)
    return found


def trained(samples: list[str], size: int, whole: list[str]) -> bytes:
    """Dictionary trained on the samples. Its trainer leaves things out and
    refuses few samples: those of ``whole``, in falling importance, are added
    where they are missing, as far as half the size again allows."""
    try:
        content = zstandard.train_dictionary(size, [s.encode() for s in samples]).as_bytes()
    except zstandard.ZstdError:
        content = b""
    more = b""
    for s in map(str.encode, whole):
        if s not in content and s not in more and len(more) + len(s) <= size // 2:
            more = s + more  # the most important stand last, at the smallest distance
    return content + more


def extended(ordinary: bytes, groups: list[str]) -> tuple[bytes, bytes]:
    """(toxic, ordinary): the ordinary dictionary going on with the toxic groups
    (zstandard's trainer leaves out most of what so few windows hold), and as it is."""
    more = "".join(reversed(groups)).encode()[-SIZE:]
    return ordinary + more + TAIL, ordinary + TAIL


def by_frequency(counts: collections.Counter) -> list[str]:
    return sorted(counts, key=lambda s: (-counts[s], s))


class Measure:
    """Distance of windows: bytes saved by the toxic dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.sides = [self._compressor(d) for d in (ordinary, toxic)]
        self.known: dict[str, int] = {}

    @staticmethod
    def _compressor(content: bytes):
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=64, dict_size=len(content), min_match=MIN_MATCH,
            write_checksum=False, write_content_size=False, write_dict_id=False)
        # as raw content: letters cost a byte each in both, only matches differ
        as_raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=as_raw, compression_params=how)

    def __call__(self, found: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        out = np.empty(len(found), np.int64)
        for i, w in enumerate(found):
            d = self.known.get(w)
            if d is None:
                data = w.encode("utf-8", "replace") + TAIL
                ordinary, toxic = (len(c.compress(data)) for c in self.sides)
                d = self.known[w] = ordinary - toxic
            out[i] = d
        return out


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one belongs to the constant
    window_words: int = 1

    def measure(self) -> Measure:
        return Measure(self.toxic, self.ordinary)

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return curve(x @ self.weights[:-1] + self.weights[-1])


def curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def numbers(distances: np.ndarray) -> list[float]:
    """A document's numbers from its windows' distances."""
    n = len(distances)
    top = np.sort(np.append(distances, [0, 0, 0]))[::-1][:3]
    above = [(distances >= t).sum() for t in THRESHOLDS]
    return [*map(float, top), *map(math.log1p, above), *(math.sqrt(k / (n + 20)) for k in above)]


def dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, bytes]:
    """(toxic dictionary, ordinary dictionary)."""
    groups = telling_groups([set(ws) for ws in toxic], [set(ws) for ws in ordinary])
    counts = collections.Counter(w for ws in ordinary for w in set(ws))
    telling = {w for w in counts if any(g in w for g in groups)}
    usual = [w for ws in ordinary for w in dict.fromkeys(ws) if w not in telling][:100_000]
    # toxic text is ordinary text and more: the toxic dictionary goes on where the ordinary one ends
    o = trained(usual, SIZE, [])
    words = sorted(counts)
    mistaken = collections.Counter({w: counts[w] for w, d in zip(words, Measure(*extended(o, groups))(words), strict=True)
                                    if d >= 2 and w not in telling})
    return extended(trained(usual, SIZE, by_frequency(mistaken)), groups)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic curve, both kinds counting equally in all.
    More toxic windows never make a text less toxic: numbers that would count
    against it get no weight."""
    own = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    used = np.arange(x.shape[1])
    while True:
        z = np.column_stack([x[:, used], np.ones(len(x))])
        w, penalty = np.zeros(z.shape[1]), np.append(np.full(len(used), ridge), 1e-6)
        for _ in range(50):
            p = curve(z @ w)
            step = np.linalg.solve((z * (own * p * (1 - p))[:, None]).T @ z + np.diag(penalty),
                                   z.T @ (own * (p - y)) + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[used], out[-1] = w[:-1], w[-1]
            return out
        used = used[w[:-1] > 0]


def learn(texts: list[str], toxic: list[int], window_words: int = 1) -> Model | None:
    """A model of a bounded sample; none where a kind is missing."""
    y = np.array(toxic, dtype=np.int64)
    if y.sum() == 0 or y.sum() == len(y):
        return None
    found = [windows(t, window_words) for t in texts]
    part = np.zeros(len(y), np.int64)
    for kind in (0, 1):  # each part holds both kinds
        part[y == kind] = np.arange((y == kind).sum()) % PARTS
    first, second = part > 0, part == 0
    if len(set(y[first])) < 2:  # a kind of one document serves for both
        first = np.ones(len(y), bool)
    pick = lambda kind: [ws for ws, k in zip(found, first & (y == kind), strict=True) if k]
    toxic_dictionary, ordinary_dictionary = dictionaries(pick(1), pick(0))
    measure = Measure(toxic_dictionary, ordinary_dictionary)
    features = np.array([numbers(measure(found[i])) for i in np.flatnonzero(second)])
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    w = logistic((features - mean) / scale, y[second])
    w[-1] -= math.log(CLEAN_WEIGHT)
    return Model(toxic_dictionary, ordinary_dictionary, mean, scale, w, window_words)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str,
                    max_labelled: int, max_chars: int) -> DataFrame:
    """(text, toxic) of at most about ``max_labelled`` training rows of each
    kind; ids that occur more than once are no training rows."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(
        F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("_id", F.lit("toxicity sample")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(v) for y, n in (sizes or {0: 1}).items()
                           for v in (y, int(1_000_000 * min(1.0, max_labelled / n)))])
    known = known.where(draw < share[F.col("_y")])
    rows = docs.select(F.col(doc_id).alias("_id"), whole_text(text).alias("_t")).join(F.broadcast(known), "_id")
    rows = rows.where(F.char_length("_t") <= max_chars)
    once = rows.groupBy("_id", "_y").agg(F.min("_t").alias("text"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.select("_id", "text", F.col("_y").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
        max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS, window_words: int = 1) -> Model | None:
    sample = labelled_sample(docs, labels, label, text, doc_id, max_labelled, max_chars)
    rows = sorted(sample.collect(), key=lambda r: r["_id"])  # bounded by its two parameters
    return learn([r["text"] for r in rows], [r["toxic"] for r in rows], window_words)


def classify(docs: DataFrame, model: Model | None, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    kept = [c for c in docs.columns if c not in RESULTS]
    out = docs.select(*kept, held_out(F.col(doc_id)).alias("held_out"))
    if model is None:
        return out.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))  # two dictionaries of some KB

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        name, own = shared.value
        measure = _MEASURES.get(name)
        if measure is None:
            _MEASURES.clear()
            measure = _MEASURES[name] = own.measure()
        rows = [numbers(measure(windows(t, own.window_words))) for t in texts]
        return pd.Series(own.scores(np.array(rows).reshape(-1, N_NUMBERS)))

    out = out.withColumn("score", score(whole_text(text)))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


#: The worker's own measure: later tasks go on with the windows it knows.
_MEASURES: dict[str, Measure] = {}
