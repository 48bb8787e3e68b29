"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share `share` of all sizes by the sources' weights and stop at `most`
times a source's size. Equal blocks of `block` words go to the sources by
highest quotients target / (2 * blocks + 1), a source's blocks go to its shards
by highest quotients of the shards' sizes, and each shard fills its blocks from
its documents in a seeded order, at most `most` passes.

DataFrame operations only. A hot source is split into shards of about
`shard_rows` rows; no task holds a source. Texts are read once, for their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, stored, with_position
from paperloom.plans.scale import null_safe_join

WEIGHTS = (3, 1, 2)


def seeded(*parts: Column | int) -> Column:
    """A number from 0 to 2**60 - 1 that depends on the parts only."""
    text = F.concat_ws("|", *[F.coalesce(F.lit(p).cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def apportion(units: DataFrame, group: str, unit: list[str], votes: str, seats: str, quota: str) -> DataFrame:
    """Adds `quota`: how many of its group's `seats` each unit wins by highest quotients votes / (2k + 1).

    (group, *unit) is unique and not NULL; `seats` is the same in a group. Ties go
    to the smaller unit. Units without votes win nothing, and a group without
    votes gives no seats.

    Quotas rounded from the exact shares miss the seats by at most half a seat a
    unit. Only the quotients that can move in or out while this is mended are
    listed, about three a unit, and ranked by ranges of the order, so that no
    group meets in one task.
    """
    totals = units.groupBy(group).agg(F.sum(votes).alias("_all"), F.count(F.lit(1)).alias("_units"))
    shares = units.join(totals, group)
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0))
    shares = shares.withColumn("_share", share).withColumn(
        "_got", F.when(F.col("_all") > 0, F.floor(F.col(seats) * F.col("_share") + 0.5)).otherwise(F.lit(0)).cast("bigint"))
    shares = stored(shares)
    gaps = (shares.groupBy(group).agg(F.sum("_got").alias("_sum"), F.first(seats).alias("_seats"), F.first("_all").alias("_a"))
            .select(group, F.when(F.col("_a") > 0, F.col("_seats") - F.col("_sum")).otherwise(F.lit(0)).alias("_gap")))
    open_ = shares.join(gaps.filter("_gap != 0"), group).filter(F.col(votes) > 0)
    reach = F.ceil(F.col("_share") * (F.abs("_gap") + F.col("_units"))) + 1
    seat = F.explode(F.sequence(F.lit(0), reach)).alias("_k")
    listed = open_.select(group, *unit, votes, "_got", "_gap", seat)
    adds = F.col("_gap") > 0
    quotient = F.col(votes) / F.when(adds, 2 * (F.col("_got") + F.col("_k")) + 1).otherwise(2 * (F.col("_got") - F.col("_k")) - 1)
    listed = listed.filter(adds | (F.col("_got") > F.col("_k"))).select(
        group, *unit, "_gap", F.when(adds, -quotient).otherwise(quotient).alias("_q"))
    ranked = with_position(listed, [F.col(group), F.col("_q"), *[F.col(u) for u in unit]], "_at")
    firsts = ranked.groupBy(group).agg(F.min("_at").alias("_first"))
    moved = (ranked.join(firsts, group).filter(F.col("_at") - F.col("_first") < F.abs("_gap"))
             .groupBy(group, *unit).agg(F.sum(F.signum("_gap")).cast("bigint").alias("_moved")))
    return (shares.join(moved, [group, *unit], "left")
            .withColumn(quota, F.col("_got") + F.coalesce("_moved", F.lit(0)))
            .drop("_all", "_units", "_share", "_got", "_moved"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row for each source: source, _src (its place by code point, NULL last), source_size, _rows, target.

    The weights repeat in that order. The excess over `most` times a size is
    shared again by weight until no target is above; a round only moves two sums
    to the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = with_position(sources, [F.col("source").isNull(), F.col("source")], "_src")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_src") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("_weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * float(most)))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while True:
        over = F.col("_weight") * rate > F.col("_cap")
        capped, weighing = sources.agg(F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_weight")))).first()
        new = (total - (capped or 0.0)) / weighing if weighing else rate
        if new <= rate:
            break
        rate = new
    return sources.withColumn("target", F.least("_cap", F.col("_weight") * rate)).drop("_weight", "_cap")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = 16,
        shard_rows: int = 1024, seed: int = 7) -> DataFrame:
    """Every row of (doc_id, text, source) as (doc_id, size, source_size, target, taken).

    NULL and empty texts have size 0 and give nothing; NULL is a source of its
    own; NULL ids and repeated rows are rows like any other (equal rows may swap
    their equal results). Other columns are not read. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = stored(docs.select("doc_id", "source", size.alias("size")))
    targets = source_targets(sizes, weights, share, most)
    blocks = F.lit((targets.agg(F.sum("target")).first()[0] or 0.0) / block + 0.5).cast("bigint")
    sources = stored(apportion(targets.withColumn("_one", F.lit(0)).withColumn("_blocks", blocks),
                               "_one", ["_src"], "target", "_blocks", "_quota"))
    shards = F.ceil(F.col("_rows") / shard_rows)
    docs = null_safe_join(sizes, sources.select("source", "_src", "source_size", "target", "_rows", "_quota"), ["source"])
    docs = stored(docs.withColumn("_order", seeded(F.col("doc_id"), F.col("size"), seed))
                  .withColumn("_shard", F.pmod(seeded(F.col("doc_id"), seed + 1), shards)).drop("source", "_rows"))
    by_shard = docs.groupBy("_src", "_shard").agg(F.sum("size").alias("_shard_size"), F.first("_quota").alias("_blocks"))
    quotas = apportion(by_shard, "_src", ["_shard"], "_shard_size", "_blocks", "_take")
    words = F.least(F.col("_take") * block, F.col("_shard_size") * most)
    quotas = quotas.select("_src", "_shard", "_shard_size", words.alias("_words"))
    before = (Window.partitionBy("_src", "_shard").orderBy("_order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = docs.withColumn("_at", F.coalesce(F.sum("size").over(before), F.lit(0))).join(quotas, ["_src", "_shard"])
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") - i * F.col("_shard_size") - F.col("_at")))
              for i in range(most)]
    return placed.select("doc_id", "size", "source_size", "target", sum(passes[1:], passes[0]).cast("bigint").alias("taken"))
