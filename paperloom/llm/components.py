"""Connected components of a graph whose links may form hubs and long chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blobs import release
from paperloom.llm.common import stored

HELD = 1 << 18  # links that a task folds at a time


def _stars(held: int):
    """Maps links (a, b, pull_a, pull_b) to as few with the same components: each block's members to the one with the least pull."""
    def star(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b, *pulls = (np.concatenate([batch[c].to_numpy() for batch in kept]) for c in ("a", "b", "pull_a", "pull_b"))
        node, first, at = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
        label = labels(len(node), at[:len(a)], at[len(a):])
        order = np.lexsort((np.concatenate(pulls)[first], label))
        heads = order[np.r_[True, np.diff(label[order]) != 0]]
        head = np.empty(len(node), np.int64)
        head[label[heads]] = heads
        to = head[label]
        moved = np.flatnonzero(to != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[to[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, held):
                part = batch.slice(at, held)
                if n and n + part.num_rows > held:
                    yield star(kept)
                    kept, n = [], 0
                kept.append(part)
                n += part.num_rows
        if n:
            yield star(kept)
        kept = []
        release()

    return run


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """(node, root) for every node of `links` (a bigint, b bigint); one root for each component.

    Rounds of contraction: links that lie in one task fold to stars, at most
    `held` at a time; each node then moves to the neighbour with the smallest
    seeded hash, links inside a cluster vanish, parallel links fold. The number
    of nodes falls by a constant factor a round, also on chains and stars, and
    links that few tasks hold need a round or two, which spares the driver their
    plans. Each round is stored, so a lost executor costs one round; no round
    gathers a component. Self-links and repeated links are harmless.
    """
    links = stored(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not moves or not links.isEmpty():
        near = F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("to")) for x, y in ("ab", "ba")]))
        pull = lambda c: F.xxhash64(F.col(c), F.lit(len(moves)))
        folded = links.select("a", "b", pull("a").alias("pull_a"), pull("b").alias("pull_b")).mapInArrow(_stars(held), "a bigint, b bigint")
        best = folded.select(near.alias("n")).select("n.*").groupBy("node").agg(F.min_by("to", pull("to")).alias("to"))
        move = stored(best.withColumn("to", F.when(pull("node") < pull("to"), F.col("node")).otherwise(F.col("to"))))
        moves.append(move)
        moved = links
        for side in ("a", "b"):
            moved = moved.join(move.select(F.col("node").alias(side), F.col("to").alias(f"_{side}")), side)
        links = stored(moved.filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    roots = moves.pop().withColumnRenamed("to", "root")
    for move in reversed(moves):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = stored(move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return roots


def labels(n: int, a: np.ndarray, b: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each of 0..n-1's component, under links a[i]-b[i] besides the `known` labels."""
    label = np.arange(n) if known is None else known.copy()
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label] != label).any():
            label[up] = label[label[up]]
    return label
