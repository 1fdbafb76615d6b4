"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

The mix is a number of equal blocks of words. Blocks go to sources by the highest quotients target / (2s - 1), which
gives integer quotas; the quota of a source goes to its shards the same way, by their sizes. In a shard the
documents form one stream in seeded random order, and the quota is read from its start, round and round where it is
larger than the stream. A document is taken as often as the reading passes over its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from habitscope.llm.common import WORD, written

SEED = 20


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_hash(seed: int = SEED) -> Column:
    """The seeded hash of doc_id and text that orders the rows of a shard."""
    text, number = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return F.md5(F.concat(F.lit(f"{seed}:"), number, F.lit(":"), text).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target. ``sizes``: source and size of every document.

    Sources in code-point order, null last, weigh ``weights`` in turn. A target stops at ``most`` times the size of
    its source; what is above is shared again by weight. Which sources stop follows from their ratio of size to
    weight alone: they are the ones with the smallest ratios, so one ordered pass finds them.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    ranked = sources.select("*", rank.alias("rank"), weight.alias("weight"))
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    top = F.lit(float(most))
    # Were all earlier sources at their limit, the rest would share ``left`` by weight.
    left = F.sum("source_size").over(everything) - top * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stepped = ranked.select(
        "*",
        (F.row_number().over(order)).alias("step"),
        (left / open_weight).alias("rate"),
    ).withColumn("stops", F.col("rate") * F.col("weight") > top * F.col("source_size"))
    first_open = F.min(F.when(~F.col("stops"), F.struct("step", "rate"))).over(everything)
    return stepped.withColumn("open", first_open).select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("open").isNull() | (F.col("step") < F.col("open.step")), top * F.col("source_size"))
        .otherwise(F.col("open.rate") * F.col("weight"))
        .cast("double")
        .alias("target"),
    )


def apportioned(parties: DataFrame, group: list[str], tie: list[str], share: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the ``seats`` of each group dealt by the highest quotients share / (2s - 1).

    With k parties, the divisor that deals exactly n seats lies between total / (n + k / 2) and
    total / (n - k / 2), so each party surely has its seats at the one end and has none beyond the other. Only
    quotients in between are made and ranked, about 2k in all, whatever n is. Equal quotients go by ``tie``.
    """
    within = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total, count, n = F.sum(share).over(within), F.count("*").over(within), F.col(seats)
    part = F.when(total > 0, F.col(share) / total).otherwise(F.lit(0.0))
    sure = F.greatest(F.lit(0), F.floor(part * (n - count / 2) - 0.5 - 1e-6))
    most = F.ceil(part * (n + count / 2) + 0.5 + 1e-6)
    bounded = parties.select("*", total.alias("_total"), sure.cast("long").alias("_sure"), most.cast("long").alias("_most"))
    candidates = bounded.where((F.col("_total") > 0) & (F.col("_most") > F.col("_sure"))).select(
        *group, *tie, share, seats, F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_seat")
    )
    sums = bounded.groupBy(*group).agg(F.sum("_sure").alias("_given"))
    quotient = F.col(share) / (2 * F.col("_seat") - 1)
    ranking = within.orderBy(F.desc("_quotient"), *tie, "_seat")
    placed = candidates.select("*", quotient.alias("_quotient")).select("*", F.row_number().over(ranking).alias("_place"))
    if group:
        placed = placed.alias("p").join(sums.alias("s"), _same(group, "p", "s"))
    else:
        placed = placed.alias("p").join(sums.alias("s"), F.lit(True))
    won = placed.where(F.col("_place") <= F.col(seats) - F.col("_given"))
    won = won.groupBy(*[F.col(f"p.{c}") for c in [*group, *tie]]).agg(F.count("*").alias("_won"))
    return (
        bounded.alias("b")
        .join(won.alias("w"), _same([*group, *tie], "b", "w"), "left")
        .select("b.*", (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota"))
        .drop("_total", "_sure", "_most")
    )


def _same(names: list[str], left: str, right: str) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    block: int = 16,
    seed: int = SEED,
    shard_rows: int = 1000,
    most_shards: int = 4096,
) -> DataFrame:
    """doc_id, source, row_hash, size, source_size, target, taken: one row for each row of ``docs``.

    ``size`` counts words, none for a null text; a document without words is never taken. ``taken`` is at most
    ``most`` times the size, because a shard is read at most so often. Reruns agree: the order is a seeded hash of
    doc_id and text, and rows that repeat both are alike in all they hold. An empty table gives no rows, other
    columns are not read.

    A source has one shard for each ``shard_rows`` documents, at most ``most_shards``, so a source that holds a
    third of all rows is ordered by many tasks; sources and shards are aggregates.
    """
    rows = written(
        docs.select("doc_id", "source", words(F.col("text")).alias("size"), row_hash(seed).alias("row_hash")),
        "mix-sizes",
    )
    sources = source_targets(rows.select("source", "size"), weights, most)
    blocks = F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block).cast("long")
    quotas = apportioned(sources.withColumn("blocks", blocks), [], ["source"], "target", "blocks")
    shards = F.least(F.lit(most_shards), F.ceil(F.col("n_docs") / shard_rows)).cast("int")
    quotas = written(quotas.withColumn("shards", shards).withColumnRenamed("quota", "source_quota"), "mix-quotas")
    placed = (
        rows.alias("r")
        .join(quotas.alias("q"), _same(["source"], "r", "q"))
        .select("r.*", "source_size", "target", "source_quota", (F.conv(F.substring("row_hash", 25, 8), 16, 10).cast("long") % F.col("shards")).alias("shard"))
    )
    sized = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    dealt = apportioned(sized, ["source"], ["shard"], "shard_size", "source_quota").select("source", "shard", "shard_size", "quota")
    stream = W.partitionBy("source", "shard").orderBy("row_hash", "doc_id", "size")
    start = F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    begun = placed.withColumn("_start", start)
    read = F.least(F.col("quota") * block, F.floor(F.col("shard_size") * most))
    rounds = F.when(F.col("shard_size") > 0, F.floor(read / F.col("shard_size"))).otherwise(F.lit(0))
    rest = read - rounds * F.col("shard_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    return (
        begun.alias("r")
        .join(dealt.alias("d"), _same(["source", "shard"], "r", "d"))
        .select("doc_id", "r.source", "row_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))
    )
