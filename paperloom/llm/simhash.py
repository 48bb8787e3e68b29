"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits is cut into radius // 2 + 1 segments, so two
fingerprints within the radius agree in one segment but for at most one bit. A
segment's variants, one bit wild in each, are the index: near fingerprints meet
under an equal variant and are verified there. Copies fold into one fingerprint
before that; a variant's members leave as a forest of links, never as all pairs,
and a variant with more members than a task should hold is split again by the
variants of the remaining bits, after which at most 2 ** 18 members can share
one key. No cap, no sample: every link between different fingerprints counts.

Three bits of 64 are a narrow gate for shingles: a text with every thirtieth word
changed has left it. `similar_groups` therefore looks for candidates with bands of
least hashes of the shingles, whose recall follows from their Jaccard similarity,
and links those whose sets of shingles are similar. `copy_groups`, which decides
what the pipeline keeps, takes the links of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blobs import release
from paperloom.llm.common import stored
from paperloom.llm.components import components, labels
from paperloom.llm.decontaminate import gram_hashes

BITS = 64
HELD = 1 << 16  # members of a variant that a task links by itself
SMALL = 32  # members compared with each other directly


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority vote over the XXH64 of all word shingles; bit set if over half of them set it. No words: 0."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    spans = range(max(1, len(tokens) - words + 1))
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(spans), 1 << 16):
        part = [xxhash.xxh64_intdigest(b" ".join(tokens[i:i + words]), seed) for i in spans[start:start + (1 << 16)]]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(spans), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, fp the fingerprint's 64 bits as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bits)], ["doc_id", "fp"])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return kept.mapInArrow(run, "doc_id bigint, fp bigint")


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def _pairs(key: np.ndarray, fp: np.ndarray, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of rows of one key (keys sorted) at most `reach` rows apart."""
    a, b = [], []
    for d in range(1, min(reach, len(fp) - 1) + 1):
        same = np.flatnonzero(key[:-d] == key[d:])
        if not len(same):
            break
        hit = same[_near(fp[same], fp[same + d], radius)]
        a.append(hit)
        b.append(hit + d)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _cube(fp: np.ndarray, radius: int, known: np.ndarray) -> np.ndarray:
    """Labels of distinct members that differ in few bits in all: neighbours are looked up, not compared."""
    free = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [i for i in range(BITS) if free >> i & 1]
    code = np.zeros(len(fp), np.int64)
    for place, i in enumerate(bits):
        code |= ((fp >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << place
    at = np.full(1 << len(bits), -1, np.int64)
    at[code] = np.arange(len(fp))
    label = known
    for size in range(1, radius + 1):
        for flips in combinations(range(len(bits)), size):
            if not label.any():
                return label
            other = at[code ^ sum(1 << f for f in flips)]
            met = np.flatnonzero(other >= 0)
            label = labels(len(fp), met, other[met], label)
    return label


def link_large(fp: np.ndarray, same: int, radius: int = 3) -> np.ndarray:
    """Labels of distinct fingerprints that agree in the bits of `same`, by variants of the other bits."""
    order = np.argsort(fp)
    label = labels(len(fp), *(order[x] for x in _pairs(np.zeros(len(fp)), fp[order], radius, 8)))
    rest = [i for i in range(BITS) if not same >> i & 1]
    parts = [rest[: len(rest) // 2], rest[len(rest) // 2:]] if len(rest) > 18 else [[]]
    for part in parts:
        mask = sum(1 << i for i in part)
        for wild in part or [None]:
            if not label.any():
                return label
            key = fp & np.uint64(mask & ~(1 << wild) if part else 0)
            order = np.lexsort((fp, key))
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            small = []
            for run in np.split(order, cuts):
                if len(run) > SMALL:
                    if len(set(label[run].tolist())) > 1:
                        inner = _cube(fp[run], radius, np.arange(len(run)))
                        label = labels(len(fp), run, run[inner], label)
                elif len(run) > 1:
                    small.append(run)
            if small:
                run = np.concatenate(small)
                a, b = _pairs(key[run], fp[run], radius, SMALL)
                label = labels(len(fp), run[a], run[b], label)
    return label


def _link_runs(radius: int, held: int, last: bool):
    """Maps rows (key, fp, same), sorted by key, to links (a, b) and to rows too many for one task (key, a)."""
    def out(a, b, key=None) -> pa.RecordBatch:
        keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key.view(np.int64))
        to = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), to, keys], ["a", "b", "key"])

    def linked(key: np.ndarray, fp: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        several = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        k, f = key[several], fp[several]
        label = labels(len(f), *_pairs(k, f, radius, SMALL))
        moved = np.flatnonzero(label != np.arange(len(f)))
        yield out(f[moved], f[label[moved]])
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            f = fp[s:s + n]
            label = link_large(f, int(same[s]), radius)
            moved = np.flatnonzero(label != np.arange(n))
            yield out(f[moved], f[label[moved]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.uint64)] * 3
        hot = None  # the key whose rows go on to the next split
        for batch in batches:
            new = [batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp", "same")]
            if hot is not None:
                n = int(np.searchsorted(new[0].view(np.int64), hot, "right"))
                if n:
                    yield out(new[1][:n], None, new[0][:n])
                new = [x[n:] for x in new]
                if not len(new[0]):
                    continue
                hot = None
            kept = [np.concatenate(x) for x in zip(kept, new)]
            if not len(kept[0]):
                continue
            cut = int(np.searchsorted(kept[0].view(np.int64), kept[0].view(np.int64)[-1], "left"))
            yield from linked(*[x[:cut] for x in kept])
            kept = [x[cut:] for x in kept]
            if len(kept[0]) > held and not last:
                hot = kept[0].view(np.int64)[-1]
                yield out(kept[1], None, kept[0])
                kept = [np.empty(0, np.uint64)] * 3
        yield from linked(*kept)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 3, held: int = HELD) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of `distinct` (fp) within `radius` bits (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("segments of half a fingerprint serve a radius of at most 3 bits")
    half = BITS // 2
    variant = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("v"))
    high = F.col("v") >= half
    wild = F.expr(f"~shiftleft(1L, v % {half})")
    segment = F.when(high, F.shiftrightunsigned("fp", half)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    same = F.when(high, F.expr(f"shiftleft(shiftleft(1L, v % {half}), {half})").bitwiseXOR(F.lit(-1 << half))).otherwise(
        F.expr(f"shiftleft(1L, v % {half})").bitwiseXOR(F.lit(0xFFFFFFFF)))
    keyed = variant.select(segment.bitwiseAND(wild).bitwiseOR(F.shiftleft(F.col("v").cast("bigint"), half)).alias("key"), "fp", "v")
    # Sorted by member too, so that the runs of a group name the same member its root and links fold.
    runs = keyed.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp", same.alias("same"))
    shape = "a bigint, b bigint, key bigint"
    found = stored(runs.mapInArrow(_link_runs(radius, held, False), shape))
    large = found.filter("b is null")
    links = found.filter("b is not null").select("a", "b")
    if large.isEmpty():
        return links
    # The half that the key leaves open, cut in two; one bit wild in either.
    sub = large.select("key", F.col("a").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("w"))
    base = F.when(F.shiftrightunsigned("key", half) >= half, F.lit(0)).otherwise(F.lit(half))
    at = (F.col("w") + base).cast("int")
    quarter = F.expr("shiftleft(65535L, 16)")
    mask = F.when(F.col("w") < half // 2, F.lit(65535)).otherwise(quarter)
    mask = F.when(base == 0, mask).otherwise(F.shiftleft(mask, half))
    sub = sub.select("key", "w", "fp", F.col("fp").bitwiseAND(mask).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), at).bitwiseXOR(F.lit(-1))).alias("part"))
    # Rows of one (key, w, part) must be neighbours; their 64-bit hash is the run's key. A clash
    # only puts members together that are then verified like any others.
    sub = sub.select(F.xxhash64("key", "w", "part").alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    more = sub.select("key", "fp", F.lit(0).cast("bigint").alias("same")).mapInArrow(_link_runs(radius, held, True), shape)
    return links.unionByName(stored(more).select("a", "b"))


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """Every row as (doc_id, fingerprint, component_id).

    fingerprint: 16 hex digits; component_id: smallest doc_id reachable over
    fingerprints within `radius` bits. Texts that are NULL, empty or blank have
    fingerprint zero and link like any other. Rows without an id take part and
    get their group's smallest id (NULL if none has one). Repeated rows stay;
    other columns are not read; an empty table gives no rows.
    """
    prints = stored(with_fingerprints(docs, words))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = rooted.join(ids, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(groups, "fp").select("doc_id", digits, "component_id")


BANDS, MINIMA = 24, 5  # of texts at 0.8, all but 8 in 100,000 share a band; above it fewer are missed
FACTORS, SHIFTS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)
BITMAP = 1 << 22
MEMBERS = 1 << 11  # members of a band that a task compares with each other, or with as many others
SHINGLES = 1 << 21  # and shingles of them


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of `words` words (fewer words: of the whole sequence)."""
    tokens = (text or "").encode().lower().split()
    codes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    return np.unique(gram_hashes(codes, min(words, len(codes)))) if tokens else codes


def band_keys(grams: np.ndarray) -> np.ndarray:
    """A key for each band: the smallest hash of the set under each of the band's MINIMA permutations."""
    least = np.full(BANDS * MINIMA, ~np.uint64(0))
    for at in range(0, len(grams), 1 << 11):
        least = np.minimum(least, (grams[at:at + (1 << 11)] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64) * FACTORS[0]
    for column in least.reshape(BANDS, MINIMA).T:
        key = (key ^ column) * FACTORS[1]
        key ^= key >> np.uint64(29)
    return key


def _listed(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def _with_bands(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, keys = [], [], []
            for text in batch["text"]:
                grams = shingles(text.as_py(), words)
                node.append(xxhash.xxh3_64_intdigest(grams.tobytes()) if len(grams) else 0)
                n.append(len(grams))
                keys.append(band_keys(grams) if len(grams) else grams)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(np.array(node, np.uint64).view(np.int64)),
                                              pa.array(n, pa.int64()), _listed(keys)], ["doc_id", "row", "node", "n", "keys"])
        release()

    return run


def _with_sets(words: int, bitmap: np.ndarray):
    """(row, grams) of the rows that the bitmap lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                part = part.filter(pa.array(bitmap[part["row"].to_numpy() % BITMAP]))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part["row"], _listed([shingles(t.as_py(), words) for t in part["text"]])], ["row", "grams"])
        release()

    return run


def _sets(lists: pa.ListArray) -> list[np.ndarray]:
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _similar(similarity: float):
    """Maps rows (a, b, of_a, of_b) to the links (a, b) whose sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(_sets(batch["of_a"]), _sets(batch["of_b"])):
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
        release()

    return run


def _links_across(node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that join the labels of all members whose sets are similar; members already joined are not compared."""
    label = np.unique(label, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, bool)
    a, b = [], []
    for x in range(len(node) - 1):
        if (label == label[0]).all():
            break
        alike = np.minimum(sizes[x], sizes[x + 1:]) >= similarity * np.maximum(sizes[x], sizes[x + 1:])
        others = np.flatnonzero(alike & (label[x + 1:] != label[x])) + x + 1
        if not len(others):
            continue
        own = codes[starts[x]:starts[x + 1]]
        mark[own] = True
        first = starts[others[0]]
        both = np.add.reduceat(mark[codes[first:]], starts[others[0]:-1] - first, dtype=np.int64)[others - others[0]]
        mark[own] = False
        near = others[both >= similarity * (sizes[x] + sizes[others] - both)]
        for y in near[np.unique(label[near], return_index=True)[1]]:
            a.append(int(node[x]))
            b.append(int(node[y]))
            label[label == label[y]] = label[x]
    return a, b


def _compared(similarity: float):
    """Maps rows (run, node, label, grams), sorted by run, to links (a, b) across the labels of a run."""
    def out(rows: list[tuple]) -> pa.RecordBatch:
        node, label = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        a, b = _links_across(node, label, [r[2] for r in rows], similarity)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []
        for batch in batches:
            for run_, node, label, grams in zip(*(batch[c].to_pylist() for c in ("run", "node", "label")), _sets(batch["grams"])):
                if run_ != at:
                    if len(kept) > 1:
                        yield out(kept)
                    at, kept = run_, []
                kept.append((node, label, grams.copy()))
        if len(kept) > 1:
            yield out(kept)
        kept = []
        release()

    return run


def _dealt(labelled: DataFrame, open_: DataFrame, held: int) -> DataFrame:
    """(run, node, label): a band's members in blocks of about `held`, and a run for each two blocks, so that every two members meet."""
    blocks = F.ceil(F.greatest(F.col("members") / held, F.col("shingles") / SHINGLES))
    rows = labelled.join(open_, "key").withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(node, 2), blocks)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("run"), "node", "label")


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float = 0.8, held: int = MEMBERS) -> DataFrame:
    """Links (a, b) between `nodes` (node, row, n, keys) that share a band and whose sets of shingles are similar.

    Their components are those of all such pairs. The members of a band are first
    compared with its smallest one. Bands that then still hold several labels are
    dealt out with their sets, and members of different labels compared, block
    against block, so `held` bounds what a task holds and leaves the result alone.
    """
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = stored(keyed.join(heads, "key"))
    wanted = stored(members.select("node").distinct().join(nodes.select("node", "row"), "node"))
    places = wanted.select(F.expr(f"pmod(row, {BITMAP})").alias("b")).distinct().toArrow()["b"].to_numpy()
    bitmap = np.zeros(BITMAP, bool)
    bitmap[places.astype(np.int64)] = True
    found = docs.select("row", "text").mapInArrow(_with_sets(words, bitmap), "row bigint, grams array<bigint>")
    sets = stored(found.join(wanted, "row").dropDuplicates(["node"]).select("node", "grams"))

    of = lambda side: sets.select(F.col("node").alias(side), F.col("grams").alias(f"of_{side}"))
    sizes = F.least("n", "head.n") >= similarity * F.greatest("n", "head.n")
    pairs = stored(members.filter(F.col("node") != F.col("head.node")).filter(sizes)
                   .select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct())
    links = stored(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "of_a", "of_b")
                   .mapInArrow(_similar(similarity), "a bigint, b bigint"))

    labelled = members.filter("members > 2").join(components(links).withColumnRenamed("root", "label"), "node", "left")
    labelled = stored(labelled.select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    # Bands with the same members are one.
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"same{i}") for i in (0, 1)]
    open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"),
                                        F.sum("n").alias("shingles"), *same).filter("low != high")
    open_ = stored(open_.groupBy("same0", "same1", "members", "shingles").agg(F.min("key").alias("key")).select("key", "members", "shingles"))
    if open_.isEmpty():
        return links
    dealt = _dealt(labelled, open_, held).join(sets, "node").repartition("run").sortWithinPartitions("run", "node").select("run", "node", "label", "grams")
    return links.unionByName(stored(dealt.mapInArrow(_compared(similarity), "a bigint, b bigint")))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Every row as (doc_id, component_id): smallest doc_id reachable over texts of at least that shingle similarity.

    Similarity is the Jaccard similarity of the sets of `words`-word shingles
    (fewer words: the whole sequence), taken of the sets themselves: no pair below it
    links. Pairs are compared if one of BANDS keys of MINIMA least hashes is equal;
    8 in 100,000 of the pairs just at 0.8 have none, fewer above. Texts without words are one group. Rows
    without an id take part; repeated rows stay; an empty table gives no rows.
    """
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    rows = stored(kept.mapInArrow(_with_bands(words), "doc_id bigint, row bigint, node bigint, n bigint, keys array<bigint>"))
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    roots = components(similar_links(kept, nodes, words, similarity))
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "node").join(rooted.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """Every row as (doc_id, component_id): smallest doc_id reachable over near fingerprints and over similar texts.

    Links are those of `near_groups`, fingerprints within `radius` bits found by their
    deletion variants, and those of `similar_groups`, whose gate is wider. A row is a
    member by its id and text, so repeated ids with different texts are not one.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    rows = keyed.select(F.col("row").alias("doc_id"), "text")
    both = near_groups(rows, radius=radius).select("doc_id", "component_id").unionByName(similar_groups(rows, words, similarity))
    links = stored(both.filter("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct())
    members = keyed.select("doc_id", "row").join(components(links).withColumnRenamed("node", "row"), "row", "left")
    members = stored(members.select("doc_id", F.coalesce("root", "row").alias("root")))
    ids = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return members.join(ids, "root").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group of copies; one of repeated rows with that id stays.

    Rows without an id, which no decision can name, stay. All columns are kept.
    """
    groups = copy_groups(docs, words, similarity)
    firsts = groups.select(F.col("component_id").alias("_id")).distinct()
    known = docs.join(firsts, docs["doc_id"] == firsts["_id"], "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.filter("doc_id is null"))
