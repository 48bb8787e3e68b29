"""Conversation prefix trie as a table of nodes behind minimal perfect hashes.

A node is a distinct sequence of first turns. Its digest is the XOR of 128-bit hashes of its turns, each with its depth,
so the digest of every prefix comes from a running XOR over blocks and a parent's digest is the child's XOR the last turn.

Nodes are dealt into shards by cluster. A cluster is what hangs below a cut node up to the next cuts: the first depth of
every band of `band` depths is cut, and so are nodes of more than `heavy` members and their children. A cluster thus has
at most band * heavy nodes, however hot a first turn, a whole conversation or a long conversation is. In a shard the
distinct digests get the slots of a minimal perfect hash (bitmap levels, a slot is a rank), every answer is checked
against the digest that its slot holds, partial counts are scattered into flat arrays by slot, and sums climb through
the array of parent slots, deepest first.

What hangs below a cluster in other shards comes from one join: a node belongs to its smallest member, so the nodes below
a cut node are, over its members, those that the member owns. A suffix sum over each conversation's cut nodes and one
aggregate by cut node give every cluster's whole total, whatever the depth of the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.blobs import release
from paperloom.llm.common import WORD, stored
from paperloom.llm.turns import numbered

BAND = 64
HEAVY = 256
SHARD_ROWS = 100_000
SALTS = 16
PIECE = 65536  # ids of a piece of a node's list of ends
FAMILY, BORROWED = 20, 4
NONE = -1


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys: one slot each, from 0, and the keys by slot to check answers."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.a, self.b = np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
        base, left_a, left_b = 0, a, b
        while len(left_a):
            bits = 2 * len(left_a) + 1
            at = self._place(left_a, left_b, len(self.levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = np.cumsum(alone) - 1 + base
            self.levels.append((np.where(alone, rank, NONE), bits))
            kept = alone[at]
            slots = rank[at[kept]]
            self.a[slots], self.b[slots] = left_a[kept], left_b[kept]
            base += int(kept.sum())
            left_a, left_b = left_a[~kept], left_b[~kept]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
        step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        mixed = (a + step) ^ (b * (step | np.uint64(1)))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(bits)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, NONE for keys that the table does not hold."""
        found, open_ = np.full(len(a), NONE, np.int64), np.arange(len(a))
        for level, (rank, bits) in enumerate(self.levels):
            slot = rank[self._place(a[open_], b[open_], level, bits)]
            found[open_[slot >= 0]] = slot[slot >= 0]
            open_ = open_[slot < 0]
        known = found >= 0
        wrong = (self.a[found[known]] != a[known]) | (self.b[found[known]] != b[known])
        found[np.flatnonzero(known)[wrong]] = NONE
        return found


PARTS = "c1 bigint, c2 bigint, d1 bigint, d2 bigint, p1 bigint, p2 bigint, depth bigint, rel bigint, words bigint, n bigint, least bigint, ends bigint"
NODES = "shard int, slot bigint, parent bigint, c1 bigint, c2 bigint, d1 bigint, d2 bigint, p1 bigint, p2 bigint, depth bigint, rel bigint, n bigint, least bigint, leaf bigint, own bigint, kids bigint"
SUMS = "d1 bigint, d2 bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    held = pa.Table.from_batches(list(batches))
    return {c: held[c].to_numpy() for c in held.column_names}


def _batches(schema: str, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in schema.split(", ")]
    made = pa.table([pa.array(c, pa.int32() if kind == "int" else pa.int64(), mask=getattr(c, "mask", None)) for c, (_, kind) in zip(columns, fields)],
                    names=[name for name, _ in fields])
    yield from made.to_batches(max_chunksize=16384)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's partial counts to its nodes in slot order, with the slots of the parents that lie in the shard."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    x = _columns(iter(batches))
    keys = np.stack([x["d1"], x["d2"]], axis=1)
    keys = np.unique(keys.view([("a", np.int64), ("b", np.int64)]).ravel())
    table = SlotTable(*[np.ascontiguousarray(keys[c]).view(np.uint64) for c in "ab"])
    at = table.slots(x["d1"].view(np.uint64), x["d2"].view(np.uint64))
    assert (at >= 0).all() and len(np.unique(at)) == len(keys)
    size = len(keys)

    def total(c: str) -> np.ndarray:
        out = np.zeros(size, np.int64)
        np.add.at(out, at, x[c])
        return out

    def fixed(c: str) -> np.ndarray:
        out = np.zeros(size, np.int64)
        out[at] = x[c]
        return out

    n, ends = total("n"), total("ends")
    least = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, at, x["least"])
    by = {c: fixed(c) for c in ("c1", "c2", "d1", "d2", "p1", "p2", "depth", "rel", "words")}
    # A cut node's parent is in another cluster, also where that lies in the same shard.
    parent = np.where(by["rel"] > 0, table.slots(by["p1"].view(np.uint64), by["p2"].view(np.uint64)), NONE)
    kids = np.bincount(parent[parent >= 0], minlength=size).astype(np.int64)
    shard = np.full(size, TaskContext.get().partitionId(), np.int32)
    yield from _batches(NODES, [shard, np.arange(size), parent, *[by[c] for c in ("c1", "c2", "d1", "d2", "p1", "p2", "depth", "rel")],
                                n, least, (ends == n).astype(np.int64), (n - 1) * by["words"], kids])
    release()


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole shards with what hangs below them elsewhere, to their subtree sums, deepest first."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    every = _columns(iter(batches))
    order = np.argsort(every["shard"], kind="stable")
    bounds = np.flatnonzero(np.diff(every["shard"][order])) + 1
    for rows in np.split(order, bounds):
        x = {k: v[rows] for k, v in every.items()}
        by_slot = np.argsort(x["slot"])
        x = {k: v[by_slot] for k, v in x.items()}
        leaves, saved = x["leaf"] + x["below_leaves"], x["own"] + x["below_saved"]
        for rel in range(int(x["rel"].max()), 0, -1):
            level = np.flatnonzero(x["rel"] == rel)
            np.add.at(leaves, x["parent"][level], leaves[level])
            np.add.at(saved, x["parent"][level], saved[level])
        inner = x["parent"] >= 0
        parent_conv = np.where(inner, x["least"][np.where(inner, x["parent"], 0)], x["parent_least"])
        yield from _batches(SUMS, [x["d1"], x["d2"], x["depth"], x["least"], parent_conv, x["n"], x["kids"] + x["below_kids"], leaves, saved])
    release()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of comma-joined ids to one SHA-256 for each node; the pieces stream."""
    def made() -> Iterator[tuple]:
        now, sha = None, None
        for batch in batches:
            for d1, d2, ids in zip(*[batch[c].to_pylist() for c in ("d1", "d2", "ids")]):
                if (d1, d2) != now:
                    if now is not None:
                        yield (*now, sha.hexdigest())
                    now, sha = (d1, d2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if now is not None:
            yield (*now, sha.hexdigest())

    rows = list(made())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["d1", "d2", "ends_sha256"])


def paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as (conv, rank, h1, h2, words) and the ids as (conv, turns): no text goes further than this scan.

    Turns go by number, NULL first, ties by a hash of role and text; NULL roles and texts are empty. Rows without a
    conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint").alias("words"))
    placed = numbered(rows, ["conv"], [F.col("turn"), F.col("h1"), F.col("h2")], "rank").drop("turn")
    return placed, placed.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))


def rebuilt(placed: DataFrame, sizes: DataFrame, family: int = FAMILY, most: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns replaced by those of c - c % family, h = crc32(c) % most.

    Returns (conv, _pid, depth, h1, h2, words), borrowed turns with a _pid before all others, and (conv, length).
    """
    heads = placed.filter((F.col("conv") % family == 0) & (F.col("rank") < most - 1))
    base_sizes = heads.groupBy(F.col("conv").alias("base")).agg(F.count(F.lit(1)).alias("lent"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    ids = (sizes.select("conv", "turns", (F.col("conv") - F.col("conv") % family).alias("base"), h)
           .join(base_sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0)))))
    ids = stored(ids.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length")))
    own = (placed.join(ids.select("conv", "h", "taken"), "conv").filter(F.col("rank") >= F.col("h"))
           .select("conv", "_pid", (F.col("rank") + 1 - F.col("h") + F.col("taken")).alias("depth"), "h1", "h2", "words"))
    lent = heads.select(F.col("conv").alias("base"), "rank", "h1", "h2", "words")
    borrowed = (ids.select("conv", "base", "h").join(lent, "base").filter(F.col("rank") < F.col("h"))
                .select("conv", F.lit(-1).alias("_pid"), (F.col("rank") + 1).alias("depth"), "h1", "h2", "words"))
    return own.unionByName(borrowed), ids.select("conv", "length")


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every conversation's prefixes: (conv, depth, d1, d2, p1, p2, words, last), with the digests of prefix and parent."""
    keyed = stored(turns.select("conv", "_pid", "depth", "words", F.xxhash64("depth", "h1", "h2").alias("x1"), F.xxhash64(F.lit(7), "h2", "depth", "h1").alias("x2")))
    inside = Window.partitionBy("conv", "_pid").orderBy("depth")
    before = Window.partitionBy("conv").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    segments = (keyed.groupBy("conv", "_pid").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
                .select("conv", "_pid", F.bit_xor("s1").over(before).alias("b1"), F.bit_xor("s2").over(before).alias("b2")).filter("b1 is not null"))
    run = (keyed.withColumns({"r1": F.bit_xor("x1").over(inside), "r2": F.bit_xor("x2").over(inside)}).join(segments, ["conv", "_pid"], "left")
           .withColumns({"d1": F.col("r1").bitwiseXOR(F.coalesce("b1", F.lit(0))), "d2": F.col("r2").bitwiseXOR(F.coalesce("b2", F.lit(0)))}))
    return stored(run.join(lengths, "conv").select(
        "conv", "depth", "d1", "d2", F.col("d1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("x2")).alias("p2"),
        "words", (F.col("depth") == F.col("length")).cast("bigint").alias("last")))


def _ends(rows: DataFrame) -> DataFrame:
    """(conv, d1, d2) to the SHA-256 of each node's ids; no array holds more than PIECE ids."""
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")))
    pieces = rows.groupBy("d1", "d2", F.floor(F.col("conv") / PIECE).alias("piece")).agg(ids.alias("ids"))
    streamed = pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "piece").select("d1", "d2", "ids")
    return streamed.mapInArrow(_hashed, "d1 bigint, d2 bigint, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, band: int = BAND, heavy: int = HEAVY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes of the trie of `turns` (conv, _pid, depth, h1, h2, words), whose conversations have the given lengths.

    Per node: conv_id (its smallest member), depth, parent_conv_id (NULL for the root), n_convs, n_children, n_leaves
    (childless nodes of its subtree), saved_tokens (what storing each turn of the subtree once saves) and ends_sha256 (of
    its turnless rest: the ids that end there, ascending, comma-joined). Without conversations there is no row, not even a root.
    """
    rows = prefixes(turns, lengths)
    count = rows.count()
    shards = count // shard_rows + min(32, count // 4096 + 1)
    hot = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy).drop("_n")
    hot_to = rows.select("conv", "depth", "d1", "d2").join(hot, ["d1", "d2"]).groupBy("conv").agg(F.max("depth").alias("hot_to"))
    cut = F.greatest(F.floor((F.col("depth") - 1) / band) * band, F.coalesce("hot_to", F.lit(0))) + 1
    cut = F.least("depth", cut)
    placed = rows.join(hot_to, "conv", "left").withColumn("cut", cut).drop("hot_to")
    top = Window.partitionBy("conv", "cut").orderBy("depth")
    placed = stored(placed.withColumns({"c1": F.first("d1").over(top), "c2": F.first("d2").over(top)}))
    parts = (placed.groupBy("c1", "c2", "d1", "d2", "p1", "p2", "depth", (F.col("depth") - F.col("cut")).alias("rel"), "words", F.pmod("conv", F.lit(SALTS)).alias("salt"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.sum("last").alias("ends")).drop("salt"))
    nodes = stored(parts.repartition(shards, "c1", "c2").mapInArrow(_scatter, NODES))

    clusters = nodes.groupBy("c1", "c2").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"), F.max(F.when(F.col("rel") == 0, F.col("least"))).alias("least"))
    cuts = placed.filter(F.col("depth") == F.col("cut")).select("conv", "depth", "c1", "c2").join(clusters, ["c1", "c2"])
    mine = F.col("conv") == F.col("least")
    owned = stored(cuts.select("conv", "depth", "c1", "c2", F.floor(F.col("depth") / 4096).alias("blk"),
                               F.when(mine, F.col("leaf")).otherwise(0).alias("leaf"), F.when(mine, F.col("own")).otherwise(0).alias("own")))
    beyond = Window.partitionBy("conv").orderBy(F.col("blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = (owned.groupBy("conv", "blk").agg(F.sum("leaf").alias("l"), F.sum("own").alias("o"))
             .select("conv", "blk", F.sum("l").over(beyond).alias("later_leaf"), F.sum("o").over(beyond).alias("later_own")).filter("later_leaf is not null"))
    on = Window.partitionBy("conv", "blk").orderBy(F.col("depth").desc())
    suffix = (owned.withColumns({"leaf": F.sum("leaf").over(on), "own": F.sum("own").over(on)}).join(later, ["conv", "blk"], "left")
              .select("c1", "c2", (F.col("leaf") + F.coalesce("later_leaf", F.lit(0))).alias("leaf"), (F.col("own") + F.coalesce("later_own", F.lit(0))).alias("own")))
    whole = suffix.groupBy("c1", "c2").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    tops = nodes.filter(F.col("rel") == 0).select("d1", "d2", "p1", "p2", "depth")
    hung = stored(tops.join(whole.withColumnsRenamed({"c1": "d1", "c2": "d2"}), ["d1", "d2"]))
    below = (hung.filter(F.col("depth") > 1).groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"))
             .agg(F.count(F.lit(1)).alias("below_kids"), F.sum("leaf").alias("below_leaves"), F.sum("own").alias("below_saved")))
    over = (tops.filter(F.col("depth") > 1).select("d1", "d2", "p1", "p2")
            .join(nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("least").alias("parent_least")), ["p1", "p2"]).drop("p1", "p2"))
    full = nodes.join(below, ["d1", "d2"], "left").join(over, ["d1", "d2"], "left")
    full = full.fillna(0, ["below_kids", "below_leaves", "below_saved", "parent_least"])
    sums = full.select("shard", "slot", "parent", "d1", "d2", "depth", "rel", "n", "least", "leaf", "own", "kids", "below_kids", "below_leaves", "below_saved", "parent_least")
    inner = sums.repartition(shards, "shard").mapInArrow(_climb, SUMS)

    first = hung.filter(F.col("depth") == 1).agg(F.count(F.lit(1)).alias("n_children"), F.greatest(F.coalesce(F.sum("leaf"), F.lit(0)), F.lit(1)).alias("n_leaves"),
                                                 F.coalesce(F.sum("own"), F.lit(0)).alias("saved_tokens"))
    members = lengths.agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n")).first()
    zero, least = F.lit(0).cast("bigint"), F.lit(members.least).cast("bigint")
    root = first.filter(F.lit(members.n > 0)).select(
        zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), least.alias("conv_id"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(members.n).alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    inner = inner.withColumn("parent_conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv_id")))
    turnless = lengths.filter(F.col("length") == 0).select("conv", F.lit(0).cast("bigint").alias("d1"), F.lit(0).cast("bigint").alias("d2"))
    ends = _ends(placed.filter(F.col("last") == 1).select("conv", "d1", "d2").unionByName(turnless))
    out = inner.unionByName(root).join(ends, ["d1", "d2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The trie of the conversations as they are. See `paths` for NULLs and ties, `trie` for the columns."""
    placed, counts = paths(conversations)
    return trie(placed.withColumn("depth", F.col("rank") + 1), counts.withColumnRenamed("turns", "length"), **sizes)


def rebuilt_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The trie of the conversations after `rebuilt`. See `paths` for NULLs and ties, `trie` for the columns."""
    return trie(*rebuilt(*paths(conversations)), **sizes)
