"""URL filters: a Bloom filter cascade over the corpus's complete key universe.

A rule is a host and a path prefix; it fits its host and all subdomains when
the URL's path starts with the rule's, and the longest rule wins. Every URL has
few keys that could be a rule: its host suffixes, as many labels as some rule
has, each followed by as much of its path as some rule has. All distinct keys
of the corpus are the universe. Level 0 is a Bloom filter of the listed keys,
level 1 of the other universe keys that level 0 lets pass, level 2 of the
listed keys that level 1 lets pass, and so on until nothing passes wrongly.
Probing a key of the universe is then exact and needs no join. A second cascade
inside the listed keys tells the blocked from the allowed.

Filters are sized by the keys they encode and sent to all tasks; a filter over
`max_bytes` is refused, so the broadcast has a fixed bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import ascii_lower, stored

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_BYTES = 64 << 20


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for NULL or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for NULL or without ://."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(1)).alias("h1"), F.xxhash64(key, F.lit(2)).alias("h2")]


@dataclass(frozen=True)
class Bloom:
    """A filter of `bits` bits, `words` of 64 each, probed `probes` times a key from its `first` probe on."""

    words: np.ndarray
    bits: int
    probes: int
    first: int

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        a, b = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        for i in range(self.first, self.first + self.probes):
            # The same place as the column expression in `bloom`: pmod of the two halves' sum.
            at = ((a >> np.uint64(33)) + np.uint64(i) * (b >> np.uint64(33))) % np.uint64(self.bits)
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


@dataclass(frozen=True)
class Cascade:
    """Bloom filters of alternately listed keys and false positives."""

    levels: tuple[Bloom, ...]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed: the first level without the key decides."""
        listed = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.ones(len(h1), bool)
        for i, level in enumerate(self.levels):
            passed = level.has(h1, h2)
            listed[open_ & ~passed] = i % 2 == 1
            open_ &= passed
        return listed


def bloom(keys: DataFrame, count: int, fpr: float, level: int = 0, max_bytes: int = MAX_BYTES) -> Bloom:
    """The filter of `count` keys with columns h1 and h2; only its words reach the driver.

    Each level has its own probes and size, so keys that clash in one part in the next.
    """
    bits = max(64, math.ceil(-count * math.log(fpr) / math.log(2) ** 2)) + 2 * level + 1
    if bits > 8 * max_bytes:
        raise ValueError(f"a filter of {bits >> 3} bytes is over the bound of {max_bytes}")
    probes = max(1, round(-math.log2(fpr)))
    first = 32 * level
    half = lambda c: F.shiftrightunsigned(c, 33)
    at = F.explode(F.array(*[(half(F.col("h1")) + half(F.col("h2")) * i) % bits for i in range(first, first + probes)])).alias("at")
    words = (keys.select(at).groupBy((F.col("at") / 64).cast("bigint").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toArrow())
    filled = np.zeros((bits + 63) // 64, np.int64)
    filled[words["word"].to_numpy()] = words["set"].to_numpy()
    return Bloom(filled.view(np.uint64), bits, probes, first)


def build_cascade(universe: DataFrame, fpr: float = 0.5, first_fpr: float = 0.01,
                  max_bytes: int = MAX_BYTES) -> Cascade:
    """The cascade over `universe` (h1, h2, listed), exact for every row of it.

    Empty universe or nothing listed: no levels, and no key is listed. Two keys
    of one hash pair (128 bits) would be one key.
    """
    levels: list[Bloom] = []
    left = {True: universe.filter("listed"), False: universe.filter("not listed")}
    while n := (side := left[len(levels) % 2 == 0]).count():
        level = bloom(side, n, fpr if levels else first_fpr, len(levels), max_bytes)
        other = len(levels) % 2 == 1
        passes = _probe(level)
        left[other] = left[other].filter(passes(F.col("h1"), F.col("h2")))
        levels.append(level)
    return Cascade(tuple(levels))


def _probe(keys: Bloom | Cascade):
    @F.pandas_udf(T.BooleanType())
    def has(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(keys.has(h1.to_numpy(), h2.to_numpy()))

    return has


def _rule_keys(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) to (key, blocked): one row for each key; block wins over allow."""
    kept = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
                        F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return (kept.groupBy("host", "path").agg(F.max(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("blocked"))
            .select("host", "path", F.concat("host", "path").alias("key"), "blocked"))


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """The keys a URL shows in the given shapes (labels of the host, characters of the path), longest first."""
    labels = F.size(F.split("host", r"\.", -1))
    keys = []
    for n, chars in shapes:
        suffix = F.substring_index(F.col("host"), ".", -n) if n else F.lit("")
        key = F.concat(suffix, F.substring("path", 1, chars))
        fits = (labels >= n) & (F.length("path") >= chars)
        keys.append(F.when(fits, F.struct(F.length(key).alias("len"), F.length(suffix).alias("of_host"),
                                          key.alias("key"), *hashes(key))))
    return F.sort_array(F.filter(F.array(*keys), lambda k: k.isNotNull()), asc=False)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds host, path, rule (NULL if none fits) and verdict to every row.

    Clashing columns of `pages` are replaced by the four. NULL and malformed
    URLs have an empty host and path. Repeated rules count once, a rule both
    allowed and blocked blocks; of two equally long rules the longer host wins.
    A URL without a rule gets `default`.
    """
    listed = _rule_keys(rules)
    shapes = sorted({(r.n if r.host else 0, r.chars) for r in listed.select(
        F.size(F.split("host", r"\.", -1)).alias("n"), F.length("path").alias("chars"), "host").distinct().toLocalIterator()})
    parted = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    if not shapes:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = parted.select(F.explode(_candidates(shapes)).alias("k")).select("k.key", "k.h1", "k.h2").distinct()
    universe = stored(keys.join(listed.select("key", "blocked"), "key", "left")
                      .select("h1", "h2", F.col("blocked").isNotNull().alias("listed"), "blocked"))
    in_list = build_cascade(universe.select("h1", "h2", "listed"), max_bytes=max_bytes)
    blocked = build_cascade(universe.filter("listed").select("h1", "h2", F.col("blocked").alias("listed")),
                            max_bytes=max_bytes)
    @F.pandas_udf("struct<place int, blocked boolean>")
    def longest(h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        sizes = np.fromiter(map(len, h1), np.int64, len(h1))
        a, b = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (h1, h2))
        hit = np.flatnonzero(in_list.has(a, b))
        row = np.repeat(np.arange(len(h1)), sizes)[hit]
        first, at = np.unique(row, return_index=True)
        place, bad = np.full(len(h1), -1), np.zeros(len(h1), bool)
        place[first] = hit[at] - (np.cumsum(sizes) - sizes)[first]
        bad[first] = blocked.has(a[hit[at]], b[hit[at]])
        return pd.DataFrame({"place": place.astype(np.int32), "blocked": bad})

    judged = parted.withColumn("_k", _candidates(shapes))
    judged = judged.withColumn("_won", longest(F.col("_k.h1"), F.col("_k.h2")))
    rule = F.when(F.col("_won.place") >= 0, F.get(F.col("_k.key"), F.col("_won.place")))
    verdict = F.when(rule.isNull(), default).when(F.col("_won.blocked"), "block").otherwise("allow")
    return judged.withColumns({"rule": rule, "verdict": verdict}).drop("_k", "_won")
