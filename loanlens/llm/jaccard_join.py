"""N-gram Jaccard join by chosen paths.

Texts become sets of five-word shingles; texts with the same set are one class
and are represented once. In each of several runs the sets are split
recursively: at a node a set goes on through the shingles whose shared hash
falls below 1 / (threshold * size), so similar sets are likely to go the same
way. A bucket of at most ``bucket`` sets is settled by brute force; larger ones
are split again, and at the last level dealt into pairs of blocks, which is
exact. The number of runs follows from the target recall: a pair just at the
threshold survives all levels of one run with a known probability.

Inside a bucket, pairs whose 128-byte sketches could reach the threshold link
their sets; each connected group of such candidates is then verified whole, by
exact intersections of the shingle sets (large groups in pairs of blocks). So a
pair is verified once, also if it met in no bucket but through others, links are
counted without writing pairs, and no group of near copies is ever spelled out
as all its pairs.

Defined results: null and wordless texts have no shingles, link to nothing and
are classes of their own; texts under five words are one shingle; repeated rows
and copies are links of each other; a null id counts as an id only if its class
has no other; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm import shingles
from loanlens.llm.common import SPACES, fresh, whole_text
from loanlens.llm.components import components
from loanlens.llm.tokenizing import slices
from loanlens.session import ensure_checkpoint_dir, materialize

THRESHOLD = 0.8
RECALL = 0.999
LEVELS = 3
#: Sets in a bucket that is settled by brute force, and in a block of one that no split made small.
BUCKET = 256
#: Shingles, and sets, in a block of a candidate group.
BLOCK_SHINGLES = 300_000
BLOCK_SETS = 1024
SEED = 11

FEATURES = ("doc_id string, text_key binary, key binary, n int, sketch binary, "
            "p1 array<long>, p2 array<long>, q2 array<int>, p3 array<long>, q3 array<int>")


def runs_needed(recall: float = RECALL, levels: int = LEVELS) -> int:
    """A pair at the threshold shares one chosen shingle a node on average, the
    chance to share none being 1/e; surviving ``levels`` of them follows."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def features(docs: DataFrame, text: str, doc_id: str, threshold: float, runs: int, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in slices(texts):
                rows = []
                for s in shingles.shingle_sets(texts[lo:hi], width):
                    if len(s):
                        (p1, _), (p2, q2), (p3, q3) = shingles.chosen_paths(s, runs, LEVELS, threshold, SEED)
                        rows.append((shingles.set_key(s), len(s), shingles.sketch(s), p1.view(np.int64),
                                     p2.view(np.int64), q2, p3.view(np.int64), q3))
                    else:
                        rows.append((None, 0, None, None, None, None, None, None))
                out = pd.DataFrame(rows, columns=["key", "n", "sketch", "p1", "p2", "q2", "p3", "q3"])
                out.insert(0, "doc_id", b["doc_id"].iloc[lo:hi].array)
                out.insert(1, "text_key", b["text_key"].iloc[lo:hi].array)
                yield out

    # ids cross as text: pandas has no long with nulls
    found = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.unhex(F.md5(whole_text(text))).alias("text_key"),
                        whole_text(text).alias("text")).mapInPandas(run, FEATURES)
    return found.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)[doc_id]))


def _block_pairs(rows: DataFrame, group: list[str], blocks: str, by: str) -> DataFrame:
    """Deals the rows of a group into ``blocks`` blocks and copies each to the
    pairs (i, j), i <= j, of blocks that hold its own, ``_b``."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(by), F.col(blocks)))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return rows.withColumns({"_lo": F.least("_b", "_j"), "_hi": F.greatest("_b", "_j")}).drop("_j")


def leaves(classes: DataFrame, bucket: int) -> DataFrame:
    """The buckets to settle: rows (path, _lo, _hi, _b, key)."""
    level = classes.select("key", F.posexplode("p1").alias("at", "path"))
    found = None
    for depth in range(1, LEVELS + 1):
        if depth > 1:
            level = level.checkpoint()  # counted and joined: computed once
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
        level = level.join(sizes, "path").checkpoint()
        small = level.where(F.col("members") <= bucket).select(
            "path", *[F.lit(0).cast("long").alias(c) for c in ("_lo", "_hi", "_b")], "key")
        found = small if found is None else found.union(small)
        if depth < LEVELS:
            deeper = classes.select("key", F.posexplode(f"p{depth + 1}").alias("next", "child"), f"q{depth + 1}")
            deeper = deeper.select("key", "next", "child", F.get(f"q{depth + 1}", F.col("next")).alias("at"))
            level = (level.where(F.col("members") > bucket).select("key", "at").join(deeper, ["key", "at"])
                     .select("key", F.col("next").alias("at"), F.col("child").alias("path")))
    large = level.where(F.col("members") > bucket).withColumn(
        "_blocks", F.ceil(F.col("members") / bucket).cast("long"))
    return found.union(_block_pairs(large, ["path"], "_blocks", "key").select("path", "_lo", "_hi", "_b", "key"))


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each index of a symmetric matrix of links, the least one connected."""
    root, own = np.arange(len(linked)), linked | np.eye(len(linked), dtype=bool)
    while True:
        least = np.where(own, root[None, :], len(root)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _candidate_edges(threshold: float):
    """Edges that connect what a bucket's alike pairs connect. In a pair of two
    blocks, each block's own pairs were settled elsewhere: only edges that join
    parts of the blocks are given."""
    def run(batches):
        for b in batches:
            out = set()
            for lo, hi, members in zip(b["_lo"], b["_hi"], b["members"], strict=True):
                members = sorted(members, key=lambda m: (m["_b"] != lo, m["key"]))
                s = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(members), -1)
                linked = np.concatenate([shingles.alike(s[i:i + 16], s, threshold) for i in range(0, len(s), 16)])
                root, part = _roots(linked), np.arange(len(s))
                if lo != hi:
                    side = np.array([m["_b"] == lo for m in members])
                    part = _roots(linked & (side[:, None] == side[None, :]))
                out.update((members[i]["key"], members[r]["key"])
                           for i, r in enumerate(root) if part[i] == i and r != i)
            yield pd.DataFrame(sorted(out), columns=["a", "b"])
    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Shingles of one set only are left
    out; the others make 0/1 columns, multiplied a slice at a time."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    renumbered = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = renumbered[column[keep]], owner[keep]
    out = np.zeros((m, m))
    width = max(1, 4_000_000 // m)
    starts = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if b > a:
            dense = np.zeros((m, width), np.float32)
            dense[owner[a:b], column[a:b] - k * width] = 1
            out += dense @ dense.T
    return out


def _verify(threshold: float):
    """A group's exact links: one row a set, its linked documents here and its
    least linked set (itself without any)."""
    def run(batches):
        for b in batches:
            out = []
            for lo, hi, members in zip(b["_lo"], b["_hi"], b["members"], strict=True):
                members = sorted(members, key=lambda m: (m["_b"] != lo, m["key"]))
                sets = [np.frombuffer(m["shingles"], np.uint64) for m in members]
                sizes = np.array([len(s) for s in sets])
                both = intersections(sets)
                linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                if lo != hi:  # pairs within one block are counted where it meets itself
                    side = np.array([m["_b"] == lo for m in members])
                    linked &= side[:, None] != side[None, :]
                documents = linked @ np.array([m["documents"] for m in members], dtype=np.int64)
                root = _roots(linked)
                out += [(m["key"], members[r]["key"], int(d))
                        for m, r, d in zip(members, root, documents, strict=True) if d]
            yield pd.DataFrame(out, columns=["a", "b", "links"])
    return run


def _shingled(width: int):
    def run(batches):
        for b in batches:
            texts = b["text"].tolist()
            sets = [s.tobytes() for lo, hi in slices(texts) for s in shingles.shingle_sets(texts[lo:hi], width)]
            out = b.drop(columns="text")
            out["shingles"] = sets
            yield out
    return run


def verified(docs: DataFrame, text: str, classes: DataFrame, groups: DataFrame, threshold: float,
             width: int) -> DataFrame:
    """(a, b, links) of the candidate groups' sets, from the texts themselves."""
    members = (groups.select(F.col("node").alias("key"), "component")
               .join(classes.select("key", "n", "documents", "text_key"), "key"))
    members = members.join(members.groupBy("component").agg(
        F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS))
        .cast("long").alias("_blocks")), "component")
    texts = docs.select(F.unhex(F.md5(whole_text(text))).alias("text_key"), whole_text(text).alias("text"))
    whole = (members.join(texts, "text_key").groupBy("key", "component", "documents", "_blocks")
             .agg(F.first("text").alias("text"))
             .mapInPandas(_shingled(width), "key binary, component binary, documents long, _blocks long, shingles binary"))
    dealt = _block_pairs(whole, ["component"], "_blocks", "key")
    return (dealt.groupBy("component", "_lo", "_hi")
            .agg(F.collect_list(F.struct("key", "documents", "_b", "shingles")).alias("members"))
            .select("_lo", "_hi", "members")
            .mapInPandas(_verify(threshold), "a binary, b binary, links long"))


def similarity_classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                       threshold: float = THRESHOLD, recall: float = RECALL, width: int = shingles.WIDTH,
                       bucket: int = BUCKET) -> DataFrame:
    """One row a document: ``doc_id``, ``text_key`` (MD5 of the text),
    ``class_key`` (null without words), ``class_id`` (least id of all documents
    connected by links; its own without any), ``n_links`` (other documents of
    similarity ``threshold`` or more, copies included) and ``n_copies``."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    per_doc = materialize(features(docs, text, doc_id, threshold, runs_needed(recall), width), "shingle-features")
    classes = materialize(
        per_doc.where(F.col("key").isNotNull()).groupBy("key").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("p1").alias("p1"),
            F.first("p2").alias("p2"), F.first("q2").alias("q2"), F.first("p3").alias("p3"),
            F.first("q3").alias("q3"), F.min("text_key").alias("text_key"), F.min("doc_id").alias("least_id"),
            F.count(F.lit(1)).alias("documents")), "shingle-classes")
    buckets = leaves(classes, bucket).join(classes.select("key", "sketch"), "key")
    edges = (buckets.groupBy("path", "_lo", "_hi")
             .agg(F.collect_list(F.struct("key", "_b", "sketch")).alias("members"))
             .select("_lo", "_hi", "members").mapInPandas(_candidate_edges(threshold), "a binary, b binary"))
    links = materialize(verified(docs, text, classes, components(edges), threshold, width), "links")
    found = (classes.select("key", "least_id", "documents")
             .join(components(links.select("a", "b")).withColumnRenamed("node", "key"), "key", "left")
             .join(links.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")), "key", "left")
             .withColumn("component", F.coalesce("component", "key")))
    least = found.groupBy("component").agg(F.min("least_id").alias("class_id"))
    found = found.join(least, "component").select(
        "key", F.col("component").alias("class_key"), "class_id", F.col("documents").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.col("documents") - 1).alias("n_links"))
    return (per_doc.select("doc_id", "text_key", "key").join(found, "key", "left")
            .select("doc_id", "text_key", "class_key",
                    F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")))


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class: that of least id (null ids
    last; of equal ones the least text digest, of repeated rows any). Wordless
    texts all stay."""
    row = fresh("row")
    text_key = F.md5(whole_text(text))
    classes = similarity_classes(docs, text=text, doc_id=doc_id, **options).where(F.col("class_key").isNotNull())
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                    F.lower(F.hex("text_key")).alias("text_key"))
    keepers = classes.groupBy("class_key").agg(F.min(name).alias("k")).select(
        _row_name(F.col("k")["id"], F.col("k")["text_key"]).alias(row))
    # only the rows' names were compared; the texts move once, to meet the keepers
    wordless = F.btrim(whole_text(text), F.lit(SPACES)) == ""
    kept = (docs.where(~wordless).withColumn(row, _row_name(F.col(doc_id), text_key))
            .join(keepers, row, "left_semi").dropDuplicates([row]).drop(row))
    return kept.union(docs.where(wordless))


def _row_name(doc_id: Column, text_key: Column) -> Column:
    return F.md5(F.concat(text_key, F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


#: DuckDB SQL of the query over ``documents``: every shared shingle, every pair.
SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
    from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (s) where a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b, shared = x.n and x.n = y.n as same from p join n x on x.doc_id = a join n y on y.doc_id = b
    where shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select doc_id, least(doc_id, coalesce((select min(b) from r where r.a = doc_id), doc_id)) as class_id,
    (select count(*) from l where l.a = doc_id) as n_links,
    1 + (select count(*) from l where l.a = doc_id and same) as n_copies from documents"""
