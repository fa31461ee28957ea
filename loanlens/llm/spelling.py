"""Spelling variants by a trie over letter-group counts.

Letters are dealt into groups of about equal use; a word's vector holds how
many of its letters fall into each group. One replaced code point takes one
from a group and adds one to another (or changes nothing), one inserted code
point adds one. So in a trie that arranges words by their successive group
counts, the near words of a word stand on paths that spend at most one surplus
and one deficit. Each pair is met once: the shorter word looks for the longer
one, of two equally long the one whose first difference is the surplus, and of
two with one vector the smaller.

The upper part of the trie is walked by Spark: a word's row is copied to every
node that its budget reaches, rows meet at nodes by a shuffle, and nodes with
more than ``node_rows`` rows are opened to their children, again and again.
A leaf that is still too large (very many words made of the same letters)
is opened once more, by the word with one code point left out; such a node
holds at most one word for each letter. Below that, each task builds the trie
of one node's words and searches it depth first, all visitors of a node
together; words met at a leaf are compared. No node's rows, hence no task's,
grow with the vocabulary, and no word is left out.

Defined results: a null text has no words; a null ``doc_id`` is the empty text
in the hashed string; runs of any length are words, and no text is cut; words
that occur equally often are never each other's form; of equally frequent near
words the smallest in code-point order is the form; a form occurs at least
twice as often as its word, so chains end; rows repeating an id count alike
(their runs hash alike); an empty table gives an empty one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import whole_text
from loanlens.session import materialize

LETTER_RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
DROP_EVERY = 97
GROUPS, FIRST_DEPTH, STEP = 16, 4, 4
NODE_ROWS = 100_000
#: Meetings of visitors and words that a task looks at in one table, words that
#: it compares at a time, and the longest word that it keeps in a table.
MEETINGS_AT_ONCE, PAIRS_AT_ONCE, TABLE_CHARS = 200_000, 50_000, 64
#: What a path has spent: nothing, the surplus, the surplus and then the deficit.
EVEN, LONGER, REPLACED = 0, 1, 2


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_counts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of the letter runs; a run whose hash with its document's id
    ``drop_every`` divides loses one code point."""
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(whole_text(text), F.lit(LETTER_RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).where(F.char_length("word") >= min_chars)
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters in groups of about equal use, most used letter first. The
    counts are one row a letter of the alphabet."""
    used = words.select(F.explode(F.split("word", "")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    dealt, load = [""] * groups, [0] * groups
    for r in sorted(used.collect(), key=lambda r: (-r["n"], r["x"])):
        g = load.index(min(load))
        dealt[g], load[g] = dealt[g] + r["x"], load[g] + r["n"]
    return dealt


def group_counts(word: Column, groups: list[str]) -> Column:
    left = lambda g: F.char_length(F.translate(word, g, ""))
    return F.array(*[(F.char_length(word) - left(g)).cast("int") if g else F.lit(0) for g in groups])


def reached(rows: DataFrame, first: int, last: int) -> DataFrame:
    """``rows`` (path, spent, vec, ...) copied to all nodes that groups
    ``first`` to ``last - 1`` lead to within the budget."""
    way = lambda s, count, spent: F.struct(
        F.concat(s["path"], count.cast("string"), F.lit(",")).alias("path"), spent.alias("spent"))

    def go(ways: Column, count: Column) -> Column:
        more = F.transform(ways, lambda s: F.filter(F.array(
            way(s, count, s["spent"]),
            F.when(s["spent"] == EVEN, way(s, count + 1, F.lit(LONGER))),
            F.when((s["spent"] == LONGER) & (count > 0), way(s, count - 1, F.lit(REPLACED))),
        ), lambda x: x.isNotNull()))
        return F.flatten(more)

    start = F.array(F.struct("path", "spent"))
    ways = F.aggregate(F.slice("vec", first + 1, last - first), start, go)
    kept = [c for c in rows.columns if c not in ("path", "spent")]
    return rows.select(*kept, F.explode(ways).alias("way")).select(*kept, "way.path", "way.spent")


def gapped(rows: DataFrame) -> DataFrame:
    """Rows of full leaves, copied to their words with one code point left out.
    Equally long near words share the gap's place and the rest; a shorter word
    is the rest of a longer one."""
    n = F.char_length("word")
    rest = lambda i: F.concat(F.substr(F.col("word"), F.lit(1), i - 1),
                              F.substr(F.col("word"), i + 1, n))
    places = F.sequence(F.lit(1), n)
    same = F.transform(places, lambda i: F.concat(i.cast("string"), F.lit("|"), rest(i)))
    longer = F.transform(F.array_distinct(F.transform(places, rest)), lambda x: F.concat(F.lit("|"), x))
    keys = (F.when(F.col("spent") == LONGER, F.array(F.concat(F.lit("|"), "word")))
            .when(F.col("spent") == REPLACED, same).otherwise(F.concat(same, longer)))
    kept = [c for c in rows.columns if c != "path"]
    return rows.select(*kept, "path", F.explode(keys).alias("key")).select(
        *kept, F.concat("path", "key").alias("path"))


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one code point inserted, deleted or
    replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class Letters:
    """Compares many pairs of a node's words at a time; words too long for the
    table of code points are compared one by one."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        short = np.array([w if len(w) <= TABLE_CHARS else "" for w in words] + ["xx"])
        self.table = short.view(np.uint32).reshape(len(short), -1)

    def near(self, i: np.ndarray, j: np.ndarray, spent: np.ndarray) -> np.ndarray:
        """Which of the pairs (visitor i, word j) differ by one edit that agrees
        with what the path has spent."""
        out = (self.length[j] - self.length[i] == (spent == LONGER))
        for k in np.flatnonzero(out & (np.maximum(self.length[i], self.length[j]) > TABLE_CHARS)):
            out[k] = one_edit(self.words[i[k]], self.words[j[k]])
        rest = np.flatnonzero(out & (np.maximum(self.length[i], self.length[j]) <= TABLE_CHARS))
        for at in np.array_split(rest, len(rest) // PAIRS_AT_ONCE + 1):
            a, b = self.table[i[at]], self.table[j[at]]
            unlike = a != b
            # an inserted code point: from the first place that differs on, all is moved by one
            moved = np.logical_and(a[:, :-1] != b[:, 1:], np.logical_or.accumulate(unlike, axis=1)[:, :-1]).any(axis=1)
            out[at] = np.where(spent[at] == LONGER, ~moved, unlike.sum(axis=1) == 1)
        return out


def node_pairs(words: list[str], vec: np.ndarray, spent: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of near words at one node, each once. ``vec`` holds the
    counts that the node leaves open; rows with nothing spent are the node's
    own words and, like the others, its visitors.

    The search goes depth first, a subtree with all visitors whose budget
    reaches it; a subtree with few meetings is searched as one table of them."""
    own = np.flatnonzero(spent == EVEN)
    depth = vec.shape[1]
    if depth:
        own = own[np.lexsort(vec[own].T[::-1])]
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    letters, found = Letters(words), []

    def step(more, has):
        up, down = (more == 1) & (has == EVEN), (more == -1) & (has == LONGER)
        return (more == 0) | up | down, np.where(up, LONGER, np.where(down, REPLACED, has))

    def meet(lo, hi, level, who, has):
        """All meetings of a subtree, group after group."""
        if level < depth:
            go, now = step(vec[own[lo:hi], level][None, :] - vec[who, level][:, None], has[:, None])
            i, j = np.nonzero(go)
            i, j, now = who[i], own[lo + j], now[i, j]
        else:
            i, j, now = np.repeat(who, hi - lo), np.tile(own[lo:hi], len(who)), np.repeat(has, hi - lo)
        for g in range(level + 1, depth):
            go, now = step(vec[j, g] - vec[i, g], now)
            i, j, now = i[go], j[go], now[go]
        once = (now != EVEN) | (order[i] < order[j])
        i, j, now = i[once], j[once], now[once]
        if len(i):
            ok = letters.near(i, j, now)
            found.append(np.stack([i[ok], j[ok]]))

    stack = [(0, len(own), 0, np.arange(len(words)), spent)]
    while stack:
        lo, hi, level, who, has = stack.pop()
        if (hi - lo) * len(who) <= MEETINGS_AT_ONCE:
            meet(lo, hi, level, who, has)
        elif level == depth or hi - lo == 1:
            n = max(1, MEETINGS_AT_ONCE // (hi - lo))
            for k in range(0, len(who), n):
                meet(lo, hi, level, who[k:k + n], has[k:k + n])
        else:
            counts = vec[own[lo:hi], level]
            starts = np.flatnonzero(np.diff(counts, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], hi - lo), strict=True):
                go, now = step(counts[a] - vec[who, level], has)
                if go.any():
                    stack.append((lo + a, lo + b, level + 1, who[go], now[go]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _search(batches):
    """Nodes one after another: a partition's rows come sorted by path."""
    def found(parts: list[pa.RecordBatch]):
        node = pa.Table.from_batches(parts).combine_chunks()
        words, n = node["word"].to_pylist(), node["n"].to_numpy()
        vec = node["vec"].chunk(0)
        counts = vec.flatten().to_numpy().reshape(len(words), -1)[:, node["depth"][0].as_py():]
        i, j = node_pairs(words, counts.astype(np.int64), node["spent"].to_numpy().astype(np.int64))
        word = pa.array(words)
        for a, b in ((i, j), (j, i)):
            if len(a):
                yield pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), pa.array(n[b])],
                                                 ["word", "near", "near_n"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        runs = pc.run_end_encode(batch["path"])
        lo = 0
        for path, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if kept and kept[0]["path"][0].as_py() != path:
                yield from found(kept)
                kept = []
            kept.append(batch.slice(lo, hi - lo))
            lo = hi
    if kept:
        yield from found(kept)


def near_words(words: DataFrame, groups: list[str], node_rows: int = NODE_ROWS) -> DataFrame:
    """(word, near, near_n): every near word of every word of ``words`` (word, n)."""
    depths = [*range(FIRST_DEPTH, len(groups), STEP), len(groups)]
    rows = words.select("word", "n", group_counts(F.col("word"), groups).alias("vec"),
                        F.lit("").alias("path"), F.lit(EVEN).alias("spent"))
    settled, before = [], 0
    for depth in depths:
        rows = materialize(reached(rows, before, depth), "trie-nodes")
        nodes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("spent").alias("least"))
        # a node without a word of its own is no node
        nodes = nodes.where((F.col("least") == EVEN) & (F.col("rows") > 1)).drop("least")
        nodes = materialize(nodes, "trie-sizes")
        small = nodes.where(F.col("rows") <= node_rows).select("path")
        settled.append(rows.join(small, "path").withColumn("depth", F.lit(depth)))
        large = nodes.where(F.col("rows") > node_rows).select("path")
        if large.isEmpty():
            break
        rows, before = rows.join(large, "path"), depth
    else:
        settled.append(gapped(rows).withColumn("depth", F.lit(len(groups))))
    pairs = [x.select("path", "depth", "word", "n", "vec", "spent").repartition("path")
             .sortWithinPartitions("path").mapInArrow(_search, "word string, near string, near_n long") for x in settled]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form): each round doubles the steps
    that a row has gone, so there are as many as a chain's length has digits
    in base 2, and forms at least twice as frequent keep chains short."""
    steps = materialize(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not steps.where("moved").isEmpty():
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(steps.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return steps.select("word", "root")


def variants(docs: DataFrame, *, node_rows: int = NODE_ROWS, ratio: int = RATIO, **columns) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``."""
    words = materialize(word_counts(docs, **columns), "words")
    near = near_words(words, letter_groups(words), node_rows)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    words = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(words.where(F.col("form").isNotNull()))
    return words.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
