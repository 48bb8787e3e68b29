"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they stand in it. Each
sample j draws for each term r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of
(term, j) alone, so all texts see the same draws; with t = floor(ln w / r + b) it
keeps the term and t of the smallest ln c - r (t - b + 1). Two texts keep the
same pair with the chance of their generalised Jaccard similarity, the sum of
the smaller over the sum of the larger weights. A Gamma(2, 1) draw is
-ln(u * v) of two uniform numbers.

DataFrame operations only. Texts are shuffled once, to blocks of the id order;
counting words, sampling and looking at the next document all happen inside a
block, so no term is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import SPACE

SAMPLES = 24
HEX = 8  # digits of a sample
BLOCK_ROWS = 512
BLOCKS_A_TASK = 4


def _uniform(bits: Column, place: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, place).bitwiseAND((1 << width) - 1)
    return (part.cast("double") + 0.5) * (1.0 / (1 << width))


def sample(term: Column, log_weight: Column, j: int) -> Column:
    """The key whose minimum over a text's terms is its sample j: the rank in the high half, the pair's hash in the low."""
    bits = F.xxhash64(term, F.lit(j))
    r = -F.log(_uniform(bits, 0, 16) * _uniform(bits, 16, 16))
    log_c = F.log(-F.log(_uniform(bits, 32, 16) * _uniform(bits, 48, 16)))
    b = _uniform(F.xxhash64(bits), 0, 32)
    t = F.floor(log_weight / r + b)
    rank = log_c - r * (t - b + 1)
    fixed = F.greatest(F.lit(0.0), F.least(F.lit(float((1 << 31) - 1)), (rank + 96) * (1 << 24)))
    return F.shiftleft(fixed.cast("bigint"), 32).bitwiseOR(
        term.bitwiseXOR((t % (1 << 24)).cast("bigint") * 2654435761).bitwiseAND(0xFFFFFFFF))


def with_signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint): `samples` hex numbers of 8 digits for each distinct key.

    `texts` must already be partitioned by some of the keys, else two small
    shuffles of its terms follow. A text without words has the sample of a term of its own kind.
    """
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    terms = texts.select(*keys, F.explode_outer(words).alias("_word")).select(*keys, F.xxhash64("_word").alias("_term"))
    weighted = terms.groupBy(*keys, "_term").agg(F.count(F.lit(1)).alias("_n"))
    weighted = weighted.select(*keys, "_term", F.log(F.col("_n").cast("double")).alias("_w"))
    mins = weighted.groupBy(*keys).agg(*[F.min(sample(F.col("_term"), F.col("_w"), j)).alias(f"_s{j}") for j in range(samples)])
    digits = [F.lpad(F.lower(F.hex(F.col(f"_s{j}").bitwiseAND(0xFFFFFFFF))), HEX, "0") for j in range(samples)]
    return mins.select(*keys, F.concat(*digits).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [F.when(F.substring(a, 1 + HEX * j, HEX) == F.substring(b, 1 + HEX * j, HEX), 1.0).otherwise(0.0) for j in range(samples)]
    return sum(same[1:], same[0]) / samples


def _block(bounds: list[int]) -> tuple[Column, list[tuple[str, Column]]]:
    """The number of bounds not above doc_id by binary search, as steps of added columns."""
    at, steps = F.lit(0), []
    array = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    for k in reversed(range(len(bounds).bit_length())):
        probe = at + (1 << k)
        fits = (probe <= len(bounds)) & (F.get(array, probe - 1) <= F.col("doc_id"))
        name = f"_at{k}"
        steps.append((name, at + F.when(F.col("doc_id").isNull() | F.coalesce(fits, F.lit(False)), 1 << k).otherwise(0)))
        at = F.col(name)
    return F.least(at, F.lit(len(bounds))).cast("int"), steps


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row as (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many, or all, of the next document's by id (rows without an id come
    last, ties go by a hash of the text; after the last comes the first).
    NULL texts count as empty; two texts without words are alike (1.0), one
    without words is like no other. Repeated rows stay; other columns are not
    read; an empty table gives no rows.
    """
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, least = docs.agg(F.count(F.lit(1)), F.min(F.col("doc_id").cast("bigint"))).first()
    blocks = max(1, rows // block_rows)
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = kept.approxQuantile("doc_id", cuts, 1 / (4 * blocks)) if cuts and least is not None else []
    bounds = sorted({int(b) for b in bounds if b > least})
    block, steps = _block(bounds)
    placed = kept
    for name, step in steps:
        placed = placed.withColumn(name, step)
    placed = placed.select("doc_id", "text", block.alias("_blk"))
    if bounds:
        # The first row of each block is also a guest after the last row of the block before it.
        heads = F.array(*map(F.lit, bounds)).cast("array<bigint>")
        own = F.struct(F.col("_blk").alias("blk"), F.lit(False).alias("guest"))
        is_head = (F.col("_blk") > 0) & (F.get(heads, F.col("_blk") - 1) == F.col("doc_id"))
        ahead = F.when(is_head, F.struct((F.col("_blk") - 1).alias("blk"), F.lit(True).alias("guest")))
        around = F.when(F.col("doc_id") == least, F.struct(F.lit(len(bounds)).alias("blk"), F.lit(True).alias("guest")))
        roles = F.explode(F.filter(F.array(own, ahead, around), lambda x: x.isNotNull()))
        placed = placed.select("doc_id", "text", roles.alias("r")).select("doc_id", "text", "r.blk", "r.guest")
    else:
        placed = placed.select("doc_id", "text", F.lit(0).alias("blk"), F.lit(False).alias("guest"))
    placed = placed.repartition((len(bounds) + BLOCKS_A_TASK) // BLOCKS_A_TASK, "blk")
    order = Window.partitionBy("blk").orderBy("guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    first = F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = placed.select("blk", "guest", "doc_id", "text", F.row_number().over(order).alias("pos"),
                           (F.lead("text").over(order) if bounds else F.coalesce(F.lead("text").over(order), first)).alias("next"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"),
                      F.expr("substring(next, 1, cast(floor(length(text) / 2) as int))"))
    placed = placed.select("blk", "pos", "guest", "doc_id", "text", F.length("text").cast("bigint").alias("n_chars"),
                           F.coalesce(edited, F.lit("")).alias("edited"))
    both = placed.select("blk", "pos", "guest", F.explode(F.expr(
        "if(guest, array(named_struct('e', false, 't', text)), array(named_struct('e', false, 't', text), named_struct('e', true, 't', edited)))")).alias("x"))
    prints = with_signatures(both.select("blk", "pos", F.col("x.e").alias("e"), F.col("x.t").alias("t")), ["blk", "pos", "e"], "t", samples)
    prints = prints.groupBy("blk", "pos").agg(F.max(F.when(~F.col("e"), F.col("fingerprint"))).alias("fingerprint"),
                                              F.max(F.when(F.col("e"), F.col("fingerprint"))).alias("edited_fingerprint"))
    ranked = Window.partitionBy("blk").orderBy("pos")
    following = F.lead("fingerprint").over(ranked)
    if not bounds:
        following = F.coalesce(following, F.first("fingerprint").over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    prints = prints.withColumn("_next", following)
    digests = placed.filter(~F.col("guest")).select("blk", "pos", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return digests.join(prints, ["blk", "pos"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next"), samples).alias("near_next"))
