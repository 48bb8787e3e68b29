"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An alignment of m item words that scores at least `least` of the most has so few
edits that a known number of its matched words are followed by their next two
matches over at most two edits (`needed`). Such triples of words, under all
spacings, are the keys of an item's places. Texts are scanned once; a bitmap of
fixed size, filled from the items, lets nearly nothing but item keys through,
and those hits are counted over the whole corpus. Of an item's places the seeds
are the rarest, all but half the needed number: a text that aligns hits the other
half among them, whatever the counts, while common word sequences are left out.
An alignment has a bounded number of gaps, so these hits lie on near diagonals:
pairs without enough different seeds in two neighbouring bands of diagonals are
left before any text moves. The rest are aligned word by word around the seeds' diagonals; the local alignment's
score over the item's own is the similarity. Copies, edits, insertions and
dropped words keep most of it.

No pair of a text and an item is looked at without common seeds, and no group
of texts or items is gathered: all steps are joins that Spark may split.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.blobs import release
from paperloom.llm.common import stored

WORDS = re.compile(r"\w+")
GRAM = 3
BITMAP = 1 << 25
# Places of two or three words that follow each other over at most one edit, or two.
SPACINGS = {2: [(0, 1), (0, 2)], 3: [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]}
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class _Codes(dict):
    """A word's 64-bit code, kept once worked out; forgets all when it grows over its bound (some 40 MB)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def coded(words: list[str], codes: _Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """One 64-bit hash for each run of `gram` words; none if there are fewer."""
    n = max(0, len(codes) - gram + 1)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = (out ^ codes[k:k + n]) * MIX[k % len(MIX)]
        out ^= out >> np.uint64(29)
    return out


def needed(m: int, least: float) -> tuple[int, int]:
    """(size, places): an alignment of m item words to at least `least` has that many places whose `size` words are in the text over so few edits.

    With M matched words, of 2 M - edits >= 2 m least, edits are at most 2 (M - m least).
    Two neighbouring matches with two edits or more between them use up two each, three with
    three or more use up three, every edit counted twice.
    """
    triples = math.ceil((m * (4 * least - 1) - 6) / 3 - 1e-9)
    return (3, triples) if triples > 0 else (2, max(1, math.ceil(m * least - 1 - 1e-9)))


def spaced_hashes(codes: np.ndarray, size: int) -> list[np.ndarray]:
    """One hash for each place and spacing of `size` words; it does not tell the spacings apart."""
    out = []
    for spacing in SPACINGS[size]:
        n = max(0, len(codes) - spacing[-1])
        h = np.full(n, size, np.uint64)
        for k, place in enumerate(spacing):
            h = (h ^ codes[place:place + n]) * MIX[k]
            h ^= h >> np.uint64(29)
        out.append(h)
    return out


def slack(m: int, least: float) -> int:
    """More than the gaps of any alignment of m item words to at least `least`."""
    return math.ceil(2 * (1 - least) * m) + GRAM


def _item_grams(gram: int, least: float):
    """Maps items to their keys (_item, at, gram), their size, how many places are to be seeds and be hit, and their slack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for k, text in zip(batch["_item"].to_pylist(), batch["text"].to_pylist()):
                words = coded(WORDS.findall(text.lower()), codes)
                if len(words) < max(gram, 2):
                    continue
                size, places = needed(len(words), least)
                hashes = spaced_hashes(words, size)
                at = np.concatenate([np.arange(len(h)) for h in hashes])
                due = (places + 1) // 2
                taken = len(words) - size + 1 - places + due
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, np.int64)) for x in (k, size, taken, due, slack(len(words), least))]
                                                 + [pa.array(at), pa.array(np.concatenate(hashes).view(np.int64))], ["_item", "size", "taken", "due", "slack", "at", "gram"])

    return run


def _hits(sizes: list[int], bits: np.ndarray):
    """Maps texts to the places (_doc, at, gram) of keys that the bitmap lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bitmap = _Codes(), np.unpackbits(bits).view(bool)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                keys, places, hashes = [], [], []
                for k, text in zip(part["_doc"].to_pylist(), part["text"]):
                    words = coded(WORDS.findall((text.as_py() or "").lower()), codes)
                    for found in (h for size in sizes for h in spaced_hashes(words, size)):
                        at = np.flatnonzero(bitmap[(found & np.uint64(BITMAP - 1)).view(np.int64)])
                        if len(at):
                            keys.append(np.full(len(at), k, np.int64))
                            places.append(at)
                            hashes.append(found[at].view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, places, hashes)], ["_doc", "at", "gram"])
        codes.clear()
        del bitmap
        release()

    return run


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: score over the item's own, and the text's span [start, end)."""
    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        ramp = GAP * np.arange(1, len(b) + 1)
        row, top, end = np.zeros(len(b) + 1, np.int64), 0, 0
        for word in a:
            step = row[:-1] + np.where(b == word, MATCH, MISMATCH)
            step = np.maximum(np.maximum(step, row[1:] - GAP), 0)
            row = np.concatenate([[0], np.maximum.accumulate(step + ramp) - ramp])
            if (high := int(row.max())) > top:
                top, end = high, int(row.argmax())
        return top, end

    if not len(item) or not len(text):
        return 0.0, 0, 0
    score, end = best(item, text)
    _, back = best(item[::-1], text[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def _aligned(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, item_id, item, diagonals in zip(*(batch[c] for c in ("doc_id", "text", "item_id", "item", "diagonals"))):
                text = text.as_py().lower()
                spans = [(m.start(), m.end()) for m in WORDS.finditer(text)]
                words = coded([text[a:b] for a, b in spans], codes)
                sought = coded(WORDS.findall(item.as_py().lower()), codes)
                gaps = slack(len(sought), least)
                at = np.sort(np.array(diagonals.as_py()))
                found = (0.0, 0, 0)
                for near in np.split(at, np.flatnonzero(np.diff(at) > 2 * gaps) + 1):
                    first = max(0, int(near[0]) - gaps)
                    score, a, b = align(sought, words[first:int(near[-1]) + len(sought) + gaps])
                    found = max(found, (score, first + a, first + b), key=lambda x: (x[0], -x[1]))
                score, a, b = found
                if score >= least:
                    out.append((doc_id.as_py(), item_id.as_py(), score, b - a, spans[a][0], spans[b - 1][1]))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "item_id", "score", "n_words", "start_char", "end_char"])
        codes.clear()
        release()

    return run


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, item_id, score, n_words, start_char, end_char): each text and item aligned to at least `least`.

    Words are runs of letters, digits and underscores, lower-cased. The span is the
    best alignment's in the lower-cased text; of equal scores the first counts.
    NULL and empty texts, and items of fewer than `gram` words, never match.
    Repeated rows each give their rows; rows without an id are reported with
    NULL. Empty tables give no rows; other columns are not read. With `least` under
    0.5, only items of more than 1 / least words are sure to be found.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item")).filter("item is not null")
    items = items.withColumn("_item", F.xxhash64("item_id", "item")).dropDuplicates(["_item"])
    keyed = texts.withColumn("_doc", F.xxhash64("doc_id", "text"))
    of_items = stored(items.select("_item", F.col("item").alias("text")).mapInArrow(
        _item_grams(gram, least), "_item bigint, size bigint, taken bigint, due bigint, slack bigint, at bigint, gram bigint"))
    bits = np.zeros(BITMAP, bool)
    places = of_items.select(F.expr(f"pmod(gram, {BITMAP})").alias("b")).distinct().toArrow()["b"].to_numpy()
    bits[places.astype(np.int64)] = True
    sizes = [r["size"] for r in of_items.select("size").distinct().collect()]
    hits = stored(keyed.select("_doc", "text").mapInArrow(_hits(sizes, np.packbits(bits)), "_doc bigint, at bigint, gram bigint"))
    counts = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("_count"))
    by_item = Window.partitionBy("_item").orderBy("_count", "at")
    rare = (of_items.join(counts, "gram", "left").groupBy("_item", "taken", "at").agg(F.sum(F.coalesce("_count", F.lit(0))).alias("_count"))
            .withColumn("_rank", F.row_number().over(by_item)).filter("_rank <= taken").select("_item", "at"))
    seeds = of_items.join(rare, ["_item", "at"]).select("gram", "_item", "due", "slack", F.col("at").alias("_of_item")).distinct()
    # All diagonals of an alignment lie in two neighbouring bands as wide as its slack.
    diagonal, band = F.col("at") - F.col("_of_item"), F.floor(F.col("_diagonal") / F.col("slack"))
    met = hits.join(seeds, "gram").select("_doc", "_item", "due", "slack", "_of_item", diagonal.alias("_diagonal"))
    met = met.select("_doc", "_item", "due", "_of_item", "_diagonal", F.explode(F.array(band, band - 1)).alias("_band"))
    bands = met.groupBy("_doc", "_item", "_band").agg(F.collect_set("_of_item").alias("_places"), F.collect_set("_diagonal").alias("_diagonals"), F.first("due").alias("due"))
    pairs = (bands.filter(F.size("_places") >= F.col("due")).groupBy("_doc", "_item")
             .agg(F.array_distinct(F.flatten(F.collect_list("_diagonals"))).alias("diagonals")))
    wanted = keyed.join(pairs, "_doc").join(items, "_item")
    return wanted.select("doc_id", "text", "item_id", "item", "diagonals").mapInArrow(
        _aligned(least), "doc_id bigint, item_id bigint, score double, n_words bigint, start_char bigint, end_char bigint")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of `docs`, all columns, that no test item aligns with; rows without an id stay."""
    leaked = benchmark_leaks(docs.filter("doc_id is not null"), benchmark, least).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")
