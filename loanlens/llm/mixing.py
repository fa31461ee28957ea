"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in equal blocks. Sources get integer block quotas by highest
quotients ``target / (2k + 1)``; each source deals its quota on to its shards
the same way, by shard size; inside a shard the documents lie in seeded order,
cut into blocks, and the quota takes the run of consecutive blocks (round the
shard) that starts at a seeded block: whole passes first, then the run. As the
order is seeded the run is a random sample, and only the documents at its ends
are cut.

A source is split into shards of about ``shard_words`` words by a hash of the
row, so a source with a third of all rows becomes many shards and no window
holds more than one shard. Only one row a source and one row a shard are ever
ranked together.

Defined results: null texts have size 0 and are never taken; the null source is
a source of its own, ordered last; a null id hashes as the text ``null``;
repeated rows are separate rows (equal rows may swap places, the multiset of
results stays); a table without words takes nothing; other columns pass
through, columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import fresh, whole_text, word_count
from loanlens.session import ensure_checkpoint_dir

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
SEED = "mix-0"
#: A block is at most this part of the smallest source's target.
PRECISION = 100
#: Source and shard totals of more rows are joined by a shuffle.
BROADCAST_ROWS = 20_000


def sainte_lague(parties: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``quota``: of each group's ``seats``, those that a party gets by the
    highest quotients ``votes / (2k + 1)``, at most its ``cap``; equal quotients
    go to the party first by ``order``.

    A divisor slightly too large gives every party seats it is sure of, one
    slightly too small bounds what it can get, so only the few quotients between
    (a constant number for each party on average) are listed and ranked.
    """
    whole = Window.partitionBy(group)
    share = F.col("votes") / F.col("_all")
    p = parties.withColumns({"_all": F.sum("votes").over(whole), "_n": F.count(F.lit(1)).over(whole)})
    sure = F.floor(share * (F.col("seats") - F.col("_n") / 2) + 0.5) - 1
    most = F.floor(share * (F.col("seats") + F.col("_n") / 2) + 0.5) + 1
    p = p.withColumns({
        "_sure": F.when(F.col("_all") > 0, F.least(F.greatest(sure, F.lit(0)), F.col("cap"))).otherwise(0).cast("long"),
        "_most": F.when(F.col("_all") > 0, F.least(F.greatest(most, F.lit(0)), F.col("cap"))).otherwise(0).cast("long"),
    })
    p = p.withColumn("_left", F.col("seats") - F.sum("_sure").over(whole))
    contested = (p.where(F.col("_most") > F.col("_sure"))
                 .withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)))
                 .withColumn("_q", F.col("votes") / (2 * F.col("_k") + 1)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_q"), *order, "_k"))
    won = (contested.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
           .groupBy(group, *order).agg(F.count(F.lit(1)).alias("_won")))
    return (p.join(won, [group, *order], "left")
            .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
            .drop("_all", "_n", "_sure", "_most", "_left", "_won"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source (``key``, ``source``, ``source_size``) -> ``weight`` and
    ``target``: the budget shared by weight, no target above ``max_repeats``
    sizes, the excess shared on by weight (water filling). The windows rank one
    row a source, not documents."""
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("_rn", F.row_number().over(
        every.orderBy(F.col("source").isNull(), "source")))
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.get(pick, (F.col("_rn") - 1) % len(weights)))
    s = s.withColumns({"_cap": F.lit(float(max_repeats)) * F.col("source_size"),
                       "_t": F.lit(budget) * F.sum("source_size").over(every),
                       "_w": F.sum("weight").over(every)})
    before = every.orderBy(F.col("_cap") / F.col("weight"), "_rn").rowsBetween(
        Window.unboundedPreceding, -1)
    s = s.withColumn("_level", (F.col("_t") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / (F.col("_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source not above its cap sets the level of all that follow
    s = s.withColumn("_open", F.min(F.when(
        F.col("_cap") / F.col("weight") >= F.col("_level"),
        F.struct((F.col("_cap") / F.col("weight")).alias("r"), F.col("_rn"), F.col("_level")))).over(every))
    return s.withColumn("target", F.coalesce(
        F.least(F.col("weight") * F.col("_open")["_level"], F.col("_cap")), F.col("_cap"))
    ).drop("_rn", "_cap", "_t", "_w", "_level", "_open")


RESULTS = ("source_size", "target", "taken", "whole_passes", "cut_from", "cut_to", "cut2_from", "cut2_to")


def _small(table: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast if it is counted to have few rows; else
    the join shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mix(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", *,
        weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """``docs`` (with its word count in ``size``) plus ``source_size``,
    ``target``, ``taken``, ``whole_passes`` (times the document is taken whole)
    and ``cut_from``/``cut_to``, ``cut2_from``/``cut2_to`` (word ranges taken
    once more; empty ranges have equal ends)."""
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))
    name = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    kept = [c for c in docs.columns if c not in RESULTS]
    # input columns travel in one struct, so that none can clash
    d = docs.select(F.struct(*kept).alias("_in"), F.col(source).alias("source"), key.alias("_key"),
                    name.alias("_name"), F.col(size).cast("long").alias("_size"))

    sizes = d.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"))
    d = d.drop("source")
    every = Window.partitionBy(F.lit(0))
    s = source_targets(sizes, weights, budget, max_repeats)
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(
        F.when(F.col("target") > 0, F.col("target"))).over(every) / PRECISION))).cast("long"))
    s = s.withColumns({
        "block": F.coalesce("block", F.lit(1)), "votes": F.col("target"), "all": F.lit(0),
        "n_shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")})
    s = s.withColumns({
        "seats": F.floor(F.sum("target").over(every) / F.col("block") + 0.5).cast("long"),
        "cap": max_repeats * F.ceil(F.col("source_size") / F.col("block")).cast("long")})
    s = sainte_lague(s, "all", ["_key"]).select(
        "_key", "source_size", "target", "block", "n_shards", F.col("quota").alias("_source_quota")).checkpoint()

    d = d.join(_small(s.select("_key", "source_size", "target", "block", "n_shards")), "_key")
    d = d.withColumn("_shard", F.conv(F.substring("_name", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    shards = (d.groupBy("_key", "_shard").agg(F.sum("_size").alias("shard_size"))
              .join(s.select("_key", "block", F.col("_source_quota").alias("seats")), "_key"))
    shards = shards.withColumns({
        "votes": F.col("shard_size").cast("double"),
        "_blocks": F.ceil(F.col("shard_size") / F.col("block")).cast("long")})
    shards = shards.withColumn("cap", max_repeats * F.col("_blocks"))
    shards = sainte_lague(shards, "_key", ["_shard"])
    first = F.conv(F.substring(F.md5(F.concat(
        F.lit(seed + "|"), "_key", F.lit("|"), F.col("_shard").cast("string"))), 1, 8), 16, 10).cast("long")
    shards = shards.select(
        "_key", "_shard", "_blocks",
        F.when(F.col("_blocks") > 0, F.col("quota").cast("long") - F.col("quota") % F.col("_blocks"))
        .otherwise(0).alias("_whole"),
        F.when(F.col("_blocks") > 0, F.col("quota") % F.col("_blocks")).otherwise(0).alias("_run"),
        F.when(F.col("_blocks") > 0, first % F.col("_blocks")).otherwise(0).alias("_first"))
    shards = shards.withColumn("_passes", F.when(F.col("_blocks") > 0, F.floor(
        F.col("_whole") / F.col("_blocks"))).otherwise(0).cast("long")).checkpoint()

    order = Window.partitionBy("_key", "_shard").orderBy("_name", "_size")
    d = d.withColumn("_end", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_start", F.col("_end") - F.col("_size")).join(
        _small(shards), ["_key", "_shard"])
    run_end = F.col("_first") + F.col("_run")
    ranges = {
        "cut": (F.col("_first") * F.col("block"), F.least(run_end, F.col("_blocks")) * F.col("block")),
        "cut2": (F.lit(0), F.greatest(F.lit(0), run_end - F.col("_blocks")) * F.col("block"))}
    inside = lambda x: F.least(F.greatest(x - F.col("_start"), F.lit(0)), F.col("_size"))
    for c, (lo, hi) in ranges.items():
        d = d.withColumn(f"{c}_from", inside(lo).cast("long"))
        d = d.withColumn(f"{c}_to", F.greatest(F.col(f"{c}_from"), inside(hi)).cast("long"))
    taken = (F.col("_passes") * F.col("_size") + F.col("cut_to") - F.col("cut_from")
             + F.col("cut2_to") - F.col("cut2_from"))
    d = d.withColumns({"whole_passes": F.col("_passes"), "taken": taken})
    return d.select(*[F.col("_in")[c].alias(c) for c in kept], *RESULTS)


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: each document once for each whole pass, and once more
    with the words of its cut ranges (white space after a word stays with it).
    Columns of ``docs``; ``n_chars`` is set anew where there is one."""
    columns, own = docs.columns, fresh("row")
    m = mix(docs.select(F.struct(*columns).alias(own), *[F.col(c) for c in ("doc_id", "source")],
                        word_count(whole_text(text)).alias("_mix_size")), "_mix_size", **options)
    whole = F.col(own)[text]
    pieces = F.regexp_extract_all(whole, F.lit("(?s)[^ \\t\\n\\x0B\\f\\r]++[ \\t\\n\\x0B\\f\\r]*+"), 0)
    in_cut = lambda i: ((i >= F.col("cut_from")) & (i < F.col("cut_to"))
                        | (i >= F.col("cut2_from")) & (i < F.col("cut2_to")))
    n_cut = F.col("cut_to") - F.col("cut_from") + F.col("cut2_to") - F.col("cut2_from")
    part = F.when(n_cut == F.col("_mix_size"), whole).otherwise(
        F.array_join(F.filter(pieces, lambda _, i: in_cut(i)), ""))
    copies = F.concat(
        F.when(F.col("whole_passes") > 0, F.array_repeat(F.lit(0), F.col("whole_passes").cast("int")))
        .otherwise(F.array().cast("array<int>")),
        F.when(n_cut > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    out = m.withColumn("_copy", F.explode(copies)).withColumn(
        "_text", F.when(F.col("_copy") == 0, whole).otherwise(part))
    changed = {text: F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[changed.get(c, F.col(own)[c]).alias(c) for c in columns])


def sql(weights=WEIGHTS, block_words=BLOCK_WORDS, shard_words=SHARD_WORDS, seed=SEED) -> str:
    """DuckDB SQL of the query over ``documents``, with the written-out values."""
    def seats(table: str, group: str, order: str) -> str:
        return f"""
{table}_b as (select *, sum(votes) over (partition by {group}) as va, count(*) over (partition by {group}) as vn from {table}_p),
{table}_c as (select *, case when va > 0 then least(greatest(floor(votes / va * (seats - vn / 2) + 0.5)::bigint - 1, 0), cap) else 0 end as sure,
  case when va > 0 then least(greatest(floor(votes / va * (seats + vn / 2) + 0.5)::bigint + 1, 0), cap) else 0 end as most from {table}_b),
{table}_d as (select *, seats - sum(sure) over (partition by {group}) as remaining from {table}_c),
{table}_e as (select *, unnest(generate_series(sure, most - 1)) as k from {table}_d where most > sure),
{table}_f as (select *, row_number() over (partition by {group} order by votes / (2 * k + 1) desc, {order}, k) as rk from {table}_e),
{table}_g as (select {group} as g, {order} as o, count(*) as won from {table}_f where rk <= remaining group by 1, 2),
{table}_q as (select p.*, sure + coalesce(won, 0) as quota from {table}_d p left join {table}_g on g = p.{group} and o = p.{order})"""
    return f"""
with d as (select doc_id, case when source is null then 'n' else 's' || source end as skey, source,
    md5('{seed}|' || coalesce(doc_id::varchar, 'null')) as name,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s0 as (select skey, any_value(source) as source, sum(size)::bigint as source_size from d group by 1),
s1 as (select *, row_number() over (order by source is null, source) as rn from s0),
s2 as (select *, list_extract({list(map(float, weights))}::double[], ((rn - 1) % {len(weights)} + 1)::int) as weight from s1),
s3 as (select *, 2.0::double * source_size as capw, 1.5::double * sum(source_size) over () as t, sum(weight) over () as w from s2),
s4 as (select *, (t - coalesce(sum(capw) over o, 0)) / (w - coalesce(sum(weight) over o, 0)) as lev from s3
  window o as (order by capw / weight, rn rows between unbounded preceding and 1 preceding)),
s5 as (select *, (select lev from s4 where capw / weight >= lev order by capw / weight, rn limit 1) as level from s4),
s6 as (select *, coalesce(least(weight * level, capw), capw) as target from s5),
s7 as (select *, coalesce(greatest(1, least({block_words}, floor(min(case when target > 0 then target end) over () / 100))), 1)::bigint as block from s6),
s_p as (select skey, source_size, target, block, target as votes, 0 as grp,
  greatest(1, ceil(source_size / {shard_words}))::bigint as n_shards,
  floor(sum(target) over () / block + 0.5)::bigint as seats, 2 * ceil(source_size / block)::bigint as cap from s7),
{seats("s", "grp", "skey")},
e as (select d.*, q.source_size, q.target, q.block, q.quota as seats, ('0x' || substr(name, 1, 8))::bigint % n_shards as shard
  from d join s_q q using (skey)),
h_p as (select skey, shard, any_value(block) as block, any_value(seats) as seats, sum(size)::double as votes,
  ceil(sum(size) / any_value(block))::bigint as blocks, 2 * ceil(sum(size) / any_value(block))::bigint as cap from e group by 1, 2),
{seats("h", "skey", "shard")},
h as (select skey, shard, blocks, case when blocks > 0 then quota // blocks else 0 end as passes,
  case when blocks > 0 then quota % blocks else 0 end as run,
  case when blocks > 0 then ('0x' || substr(md5('{seed}|' || skey || '|' || shard::varchar), 1, 8))::bigint % blocks else 0 end as first from h_q),
f as (select e.*, passes, run, first, blocks, sum(size) over (partition by skey, shard order by name, size rows unbounded preceding) as e_end
  from e join h using (skey, shard)),
g as (select *, e_end - size as a from f)
select doc_id, size, source_size, target,
  (passes * size
   + greatest(0, least(e_end, least(first + run, blocks) * block) - greatest(a, first * block))
   + greatest(0, least(e_end, greatest(0, first + run - blocks) * block) - a))::bigint as taken
from g"""
