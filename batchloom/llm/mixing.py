"""Mixing sources to target weights by whole blocks of tokens.

1. Targets: sources, in code point order with null last, weigh ``weights``
   repeating, and share the tokens of the corpus. A target stops at ``repeats``
   times its source's size, and the excess goes to the others by weight.
2. Quotas: the corpus is so many blocks of equal size: ``block_tokens`` tokens, or
   less, so that the smallest target is ``least_blocks`` blocks. Sainte-Lague
   gives a source with target v its j-th block at quotient v / (2j - 1), highest
   first. Rounding v / (tokens per block) gives all blocks but a few; only the
   quotients next to that are ranked. Each source's quota is then dealt to its
   shards in the same way.
3. Selection: the documents of a shard, in seeded order, form a line of tokens
   cut into blocks, closed to a ring. A quota above the shard's size takes whole
   passes; the rest takes the blocks that follow a seeded one. The order is random,
   so that is a random choice of documents, all whole but those at its two ends.

A shard is a bounded part of a source (``shard_tokens``, more only for one very
long document), by a seeded hash, so no source meets in one task.

Defined cases: null and empty texts have size 0 and are taken 0 times. Null
sources are a source. Equal rows and repeated ids stay rows of their own; which
of two equal rows gives the tokens does not show. Reruns agree. An empty table
gives an empty table. Other columns pass through ``mixed``; a column that has
the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import row_key, stored, word_count

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """Size and target per source.

    Works on one row per source. With sources sorted by size over weight, those
    that reach their limit come first; the level of the others is what is left
    over their weights, for the first split at which it fits under their limits.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = by_source.withColumn("weight", weight).withColumn("limit", F.lit(float(repeats)) * F.col("source_size"))
    ratio = F.col("limit") / F.col("weight")
    by_level = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    split = ranked.select("source", "source_size", "weight", "limit", level.alias("level"), F.row_number().over(by_level).alias("place"))
    fits = F.when(F.col("level") <= ratio, F.col("place"))
    shared = F.coalesce(F.min_by("level", fits).over(whole), F.lit(0.0))
    target = F.least(F.col("limit"), shared * F.col("weight"))
    return split.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _joined_by(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """``side``, with keys named ``__<key>``, joined by keys that may be null."""
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return rows.join(side, same, "left").drop(*[f"__{c}" for c in keys])


def apportioned(parties: DataFrame, group: list[str], name: list[str], votes: str) -> DataFrame:
    """Sainte-Lague seats (column ``quota``) of every party of each group.

    ``parties`` has a row per party, and ``seats`` of its group. Seats start from
    rounding; the difference to the wanted sum, at most half the parties, is made
    up by the next highest, or the lowest quotients. Of each party only the
    quotients are ranked that reach the poorest party's next one.
    """
    v, keys = F.col(votes), [*group, *name]

    def per_group(rows: DataFrame, *sums: Column) -> DataFrame:
        return rows.groupBy(*[F.col(c).alias(f"__{c}") for c in group]).agg(*sums)

    rows = _joined_by(parties, per_group(parties, F.sum(votes).alias("__votes")), group)
    rounded = F.floor(v * F.col("seats") / F.col("__votes") + 0.5)
    rows = rows.withColumn("__base", F.when(F.col("__votes") > 0, rounded).otherwise(0).cast("long"))
    following = F.when(v > 0, v / (2 * F.col("__base") + 1))
    last = F.when(F.col("__base") > 0, v / (2 * F.col("__base") - 1))
    sums = per_group(
        rows, F.sum("__base").alias("__given"), F.min(following).alias("__least"), F.max(last).alias("__most")
    )
    rows = _joined_by(rows, sums, group).withColumn(
        "__missing", F.when(F.col("__votes") > 0, F.col("seats") - F.col("__given")).otherwise(0)
    )
    more = F.floor((v / F.col("__least") + 1) / 2) - F.col("__base") + 1
    fewer = F.col("__base") - F.floor((v / F.col("__most") + 1) / 2) + 1
    steps = F.least(F.abs("__missing"), F.when(F.col("__missing") > 0, more).otherwise(F.least(fewer, F.col("__base"))))
    steps = F.greatest(steps, F.lit(0)).cast("int")
    change = rows.where((F.col("__missing") != 0) & (v > 0) & (steps > 0)).select(
        *keys, "__missing", "__base", votes, F.explode(F.sequence(F.lit(1), steps)).alias("__i")
    )
    adds = F.col("__missing") > 0
    seat = F.when(adds, F.col("__base") + F.col("__i")).otherwise(F.col("__base") - F.col("__i") + 1)
    quotient = v / (2 * seat - 1)
    order = [F.when(adds, -quotient).otherwise(quotient), *[F.col(n).asc_nulls_last() for n in name], "__i"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    given = (
        change.withColumn("__rank", rank)
        .where(F.col("__rank") <= F.abs("__missing"))
        .groupBy(*[F.col(c).alias(f"__{c}") for c in keys])
        .agg(F.sum(F.signum("__missing")).cast("long").alias("__change"))
    )
    quota = F.col("__base") + F.coalesce(F.col("__change"), F.lit(0))
    return _joined_by(rows, given, keys).select(*[c for c in parties.columns if c != "seats"], quota.alias("quota"))


def selected(
    rows: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    repeats: int = 3,
    block_tokens: int = 2048,
    least_blocks: int = 200,
    shard_tokens: int = 1_000_000,
    seed: int = 17,
) -> DataFrame:
    """Tokens taken of each row; ``rows`` has key, source, size, maybe more."""
    goal = stored(targets(rows, weights, repeats), "mixing-targets")
    least = F.min(F.when(F.col("target") > 0, F.col("target")))
    unit = F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(least / least_blocks))).cast("long")
    corpus = goal.agg(unit.alias("unit"), F.sum("source_size").alias("tokens"))
    goal = goal.withColumn("unit", corpus.select("unit").scalar()).withColumn("all", F.lit(1))
    goal = goal.withColumn("seats", F.round(corpus.select("tokens").scalar() / F.col("unit")).cast("long"))
    goal = apportioned(goal, ["all"], ["source"], "target").drop("all")
    n_shards = F.ceil(F.col("source_size") / shard_tokens).cast("long")
    goal = stored(goal.withColumn("shards", F.greatest(n_shards, F.lit(1))), "mixing-quotas")
    g = goal.withColumnRenamed("source", "g_source")
    placed = (
        rows.join(g, F.col("source").eqNullSafe(F.col("g_source")))
        .drop("g_source")
        .withColumn("order", F.xxhash64(F.lit(seed), "key"))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("shards")))
    )
    per_shard = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("seats"))
    shards = apportioned(per_shard, ["source"], ["shard"], "shard_size")
    s = shards.select(F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "shard_size", F.col("quota").alias("blocks"))
    line = Window.partitionBy("source", "shard").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0)))
    both = lined.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
    length = F.col("shard_size")
    wanted = F.least(F.col("blocks") * F.col("unit"), F.lit(repeats) * length)
    passes = F.when(length > 0, F.floor(wanted / length)).otherwise(0).cast("long")
    both = both.withColumn("passes", passes).withColumn("rest", wanted - F.col("passes") * length)
    n_blocks = F.greatest(F.ceil(length / F.col("unit")).cast("long"), F.lit(1).cast("long"))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), n_blocks) * F.col("unit")
    both = both.withColumn("from", first).withColumn("to", F.col("from") + F.col("rest"))

    def within(low: Column, high: Column) -> Column:
        """Tokens of this row between two places of the line."""
        shared = F.least(F.col("begin") + F.col("size"), high) - F.greatest(F.col("begin"), low)
        return F.greatest(shared, F.lit(0).cast("long"))

    zero = F.lit(0).cast("long")
    last = within(F.col("from"), F.least(F.col("to"), length)) + within(zero, F.col("to") - length)
    taken = F.col("passes") * F.col("size") + last
    return both.select(*rows.columns, "source_size", "target", taken.cast("long").alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """Key, doc_id, source and size of every document, written once."""
    key = row_key("doc_id", "source", "text")
    return stored(docs.select(key.alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    return selected(sized(docs), **options).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents with size, source_size, target, taken.

    A document taken n times its size is to be read n times; the part beyond
    whole passes are the tokens of its selected blocks.
    """
    rows = sized(docs)
    got = selected(rows.select("key", "source", "size"), **options)
    # Equal rows share a key: number them on both sides, so each gets one result.
    same = Window.partitionBy("__key").orderBy("__order")
    left = docs.drop("size", "source_size", "target", "taken").withColumn("__key", row_key("doc_id", "source", "text"))
    left = left.withColumn("__order", F.lit(0)).withColumn("__i", F.row_number().over(same)).drop("__order")
    right = got.select(F.col("key").alias("__key"), "size", "source_size", "target", "taken", F.col("taken").alias("__order"))
    right = right.withColumn("__i", F.row_number().over(same)).drop("__order")
    return left.join(right, ["__key", "__i"]).drop("__key", "__i")
