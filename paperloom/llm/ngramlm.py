"""LM scoring with Elias-Fano n-gram tries, one for each shard of the words.

The model is an interpolated bigram model. A word's history is the class of the
word before it, its hash by `CLASSES`; with g the class, c counts and a word w
  p(w | g) = (1 - b(g)) c(g, w) / c(g) + b(g) p(w),
  p(w) = (1 - u) c(w) / N, and u for all unknown words together,
where u is the share of words seen once (Good-Turing). b(g) is c(g) words'
expected number of different ones if they were drawn by p, over c(g): histories
whose followers say no more than chance weigh little. This sums to one over the
known words and the unknown one.

Words are dealt to shards by their hash. Hot words, of which there can only be
some thousands as each holds its share of the text, are dealt by word and history,
and every task knows their counts. A shard's trie is stored by the word
predicted: level 0 has the words' hashes, monotone pointers lead to each word's
histories in level 1, and both levels carry quantised log probabilities. Levels
are Elias-Fano sequences in a mapped file. A query finds its word, then its
history relative to that word's range, by successor search.

Nothing whole goes to one place: counts and queries move as compressed columns
to their shard, whose size is fixed by its share of the text, and a number for
each word comes back to the block of texts that asked, where they are summed. Only the class counts, a table of fixed size, and the hot words reach
every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blobs import ascending, pack, release, unpack
from paperloom.llm.common import remainder, stored
from paperloom.llm.eliasfano import Levels

CLASS_BITS = 21
CLASSES = 1 << CLASS_BITS
SHARD = 4 << 20  # bytes of text for each shard
HELD = 800_000  # words a task gathers before it sends
HOT = 16384  # a word is hot if one in so many bytes of text starts it
END, START = np.uint64(1), np.uint64(2)  # the end of a text, and what stands before its first word
STEP = 4096.0  # quantised steps for a factor of ten
MOST_HISTORY = 0.02  # a known history weighs this at least
OCTAVE = 16  # count buckets for each doubling


class _Codes(dict):
    """A word's 64-bit code, kept once worked out; forgets all when it grows over its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        code = self[word] = max(8, xxhash.xxh64_intdigest(word))
        return code


def tokens(text: str | None, codes: _Codes) -> np.ndarray:
    """Codes of the words of a text, A-Z lower-cased, and of its end."""
    words = (text or "").encode().lower().split()
    return np.append(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), END)


def _class(code: np.ndarray) -> np.ndarray:
    return code & np.uint64(CLASSES - 1)


def _shard(code: np.ndarray, shards: int) -> np.ndarray:
    return ((code >> np.uint64(CLASS_BITS)) % np.uint64(shards)).astype(np.int64)


def _at(sorted_: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code in a sorted list and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    at = np.minimum(np.searchsorted(sorted_, code), len(sorted_) - 1)
    return at, sorted_[at] == code


def _rows(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _groups(ids: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(ids, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(ids) else []


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    now, held = None, []
    for batch in batches:
        for shard, blob in zip(batch["shard"].to_pylist(), batch["blob"].to_pylist()):
            if shard != now and held:
                yield held
                held = []
            now = shard
            held.append(unpack(blob))
    if held:
        yield held


def _send_counts(shards: int):
    def sent(words: list[np.ndarray], train: list[bool]) -> Iterator[pa.RecordBatch]:
        code, inverse, count = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        learnt = np.bincount(inverse, np.repeat(train, [len(w) for w in words])).astype(np.int64)
        of = _shard(code, shards)
        yield _rows(["shard", "blob"], [pa.int32(), pa.binary()],
                    [(int(of[g[0]]), pack(ascending(code[g]), learnt[g], count[g] - learnt[g])) for g in _groups(of)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, train, size = _Codes(), [], [], 0
        for batch in batches:
            for held_out, text in zip(batch["held_out"].to_pylist(), batch["text"]):
                held.append(tokens(text.as_py(), codes))
                train.append(not held_out)
                size += len(held[-1])
                if size > HELD:
                    yield from sent(held, train)
                    held, train, size = [], [], 0
        if held:
            yield from sent(held, train)

    return run


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.round(np.log2(np.maximum(count, 1)) * OCTAVE).astype(np.int64)


def _word_counts(hot_from: int):
    """For each shard: words by count bucket, counts by history class, and the hot words with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_shard(batches):
            code = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
            code, inverse = np.unique(code, return_inverse=True)
            count, other = (np.bincount(inverse, np.concatenate([p[i] for p in parts])).astype(np.int64) for i in (1, 2))
            hot = count + other >= hot_from
            hot_code, hot_count = code[hot], count[hot]
            code, count = code[count > 0], count[count > 0]
            bucket, at = np.unique(_bucket(count), return_inverse=True)
            history = code != END
            group, of = np.unique(_class(code[history]), return_inverse=True)
            yield _rows(["blob"], [pa.binary()], [(pack(bucket, np.bincount(at), np.bincount(at, count).astype(np.int64),
                                                        np.array([(count == 1).sum()]), group.astype(np.int64),
                                                        np.bincount(of, count[history]).astype(np.int64), hot_code, hot_count),)])
    return run


class Corpus:
    """What every task knows of the training words: their number, kinds, and the counts of history classes."""

    def __init__(self, blobs: list[bytes], texts: int):
        self.classes = np.zeros(CLASSES, np.float32)
        kinds, mass, once = np.zeros(64 * OCTAVE + 1), np.zeros(64 * OCTAVE + 1), 0
        total, distinct = 0, 0
        counts = np.zeros(CLASSES, np.int64)
        hot: list[tuple[np.ndarray, np.ndarray]] = []
        for blob in blobs:
            bucket, n, words, ones, group, c, *some = unpack(blob)
            hot.append(some)
            kinds[bucket] += n
            mass[bucket] += words
            total, distinct, once = total + int(words.sum()), distinct + int(n.sum()), once + int(ones[0])
            counts[group] += c
        counts[int(_class(np.array([START]))[0])] += texts
        self.total, self.distinct = total, distinct
        code = np.concatenate([np.empty(0, np.uint64), *(h[0] for h in hot)])
        order = np.argsort(code)
        self.hot, self.hot_count = code[order], np.concatenate([np.empty(0, np.int64), *(h[1] for h in hot)])[order]
        self.classes[:] = counts
        self.unknown = min(0.5, max(once, 0.1) / total) if total else 1.0
        # Expected kinds among m words drawn by p, for each bucket of m.
        used = np.flatnonzero(kinds)
        share = mass[used] / kinds[used] / max(total, 1)
        m = 2.0 ** (np.arange(64 * OCTAVE + 1) / OCTAVE)
        drawn = (kinds[used] * -np.expm1(m[:, None] * np.log1p(-np.minimum(share, 0.999999)))).sum(axis=1) if len(used) else m
        self.back = np.minimum(1 - MOST_HISTORY, drawn / m).astype(np.float64)

    def counts(self, code: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Training counts of words, given what their shard has of them: hot words have more elsewhere."""
        at, known = _at(self.hot, code)
        return np.where(known, self.hot_count[at] if len(self.hot) else 0, local)

    def backoff(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each class and the weight that its history leaves to p(w); 1 for an unseen class."""
        c = self.classes[group.astype(np.int64)].astype(np.float64)
        return c, np.where(c > 0, self.back[np.minimum(_bucket(c), len(self.back) - 1)], 1.0)


ASKED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
WORDS, TEXTS = 0, 1  # kinds of rows: a block's words for a shard; the texts of a block


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _send_words(shards: int, hot: np.ndarray):
    def sent(block: int, docs: list[int], train: list[bool], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc = np.repeat(np.arange(len(docs)), [len(w) for w in words])
        code = np.concatenate(words)
        before = np.concatenate([[START], code[:-1]])
        before[before == END] = START  # a text's first word stands after the end of the one before
        group, of = _class(before), _shard(code, shards)
        spread = np.flatnonzero(_at(hot, code)[1])
        mixed = (code[spread] ^ group[spread] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        of[spread] = (mixed >> np.uint64(33)) % np.uint64(shards)
        small, flag = np.uint16 if len(docs) < 1 << 16 else np.uint32, np.array(train)
        out = [(block % shards, block, TEXTS, pack(np.array(docs, np.int64)))]
        for rows in _groups(of):
            kinds, rank = np.unique(code[rows], return_inverse=True)
            pair = (rank.astype(np.uint64) << np.uint64(CLASS_BITS)) | group[rows]
            order = np.argsort(pair, kind="stable")
            out.append((int(of[rows[0]]), block, WORDS, pack(ascending(kinds), ascending(pair[order]), doc[rows[order]].astype(small), flag)))
        yield _batch(out, ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, docs, train, words, size = _Codes(), [], [], [], 0
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for key, held_out, text in zip(batch["key"].to_pylist(), batch["held_out"].to_pylist(), batch["text"]):
                docs.append(key)
                train.append(not held_out)
                words.append(tokens(text.as_py(), codes))
                size += len(words[-1])
                if size > HELD:
                    yield from sent(block, docs, train, words)
                    docs, train, words, size = [], [], [], 0
                    block += 1
                    release()
        if docs:
            yield from sent(block, docs, train, words)

    return run


def _parts(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows (block, kind, blob) of each shard or block, which the input is sorted by."""
    now, held = None, []
    for batch in batches:
        for of, block, kind, blob in zip(*(batch[c].to_pylist() for c in (by, "block", "kind", "blob"))):
            if of != now and held:
                yield held
                held = []
                release()
            now = of
            held.append((block, kind, blob))
    if held:
        yield held


def quantised(p: np.ndarray) -> np.ndarray:
    return quantised_log(np.log10(np.maximum(p, 1e-15)))


def quantised_log(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 * STEP), 0, 65535).astype(np.uint16)


class Trie:
    """A shard's words and their histories with smoothed, quantised probabilities."""

    def __init__(self, code: np.ndarray, group: np.ndarray, corpus: Corpus):
        """code, group: word and history class of every training word of the shard, sorted by both."""
        new = np.r_[True, (code[1:] != code[:-1]) | (group[1:] != group[:-1])][:len(code)]
        at = np.flatnonzero(new)
        pair_count = np.diff(np.r_[at, len(code)])
        word, group = code[at], group[at]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][:len(word)])
        count = corpus.counts(word[first], np.add.reduceat(pair_count, first) if len(first) else np.empty(0, np.int64))
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(word)]))
        p = (1 - corpus.unknown) * count / max(corpus.total, 1)
        seen, back = corpus.backoff(group)
        pair_p = (1 - back) * pair_count / np.maximum(seen, 1) + back * p[of]
        levels = Levels()
        words = levels.add_sequence(word[first])
        pointers = levels.add_sequence(np.r_[first, len(word)])
        histories = levels.add_sequence((of.astype(np.uint64) << np.uint64(CLASS_BITS)) | group)
        values = levels.add(quantised(p)), levels.add(quantised(pair_p))
        levels.close()
        self.words, self.pointers, self.histories = map(levels.sequence, (words, pointers, histories))
        self.p, self.pair_p = map(levels.array, values)
        self.corpus, self.levels = corpus, levels

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place in level 0 and whether it is there."""
        if not self.words.size:
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = self.words.successor(code)
        inside = np.minimum(at, self.words.size - 1)
        return inside, (at < self.words.size) & (self.words.get(inside) == code)

    def p_word(self, code: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Quantised chance of each word; one that is hot may be learnt in other shards only."""
        hot, is_hot = _at(self.corpus.hot, code)
        learnt = is_hot & (self.corpus.hot_count[hot] > 0) if len(self.corpus.hot) else is_hot
        out = np.full(len(code), np.log10(self.corpus.unknown))
        out[known] = -(self.p[at[known]] / STEP)
        elsewhere = np.flatnonzero(learnt & ~known)
        if len(elsewhere):
            p = (1 - self.corpus.unknown) * self.corpus.hot_count[hot[elsewhere]] / max(self.corpus.total, 1)
            out[elsewhere] = -(quantised(p) / STEP)
        return out

    def log10(self, code: np.ndarray, group: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        """Log probability of each word after its history class; `at_once` queries at a time."""
        parts = [self._log10(code[i:i + at_once], group[i:i + at_once]) for i in range(0, len(code), at_once)]
        return np.concatenate([np.empty(0), *parts])

    def _log10(self, code: np.ndarray, group: np.ndarray) -> np.ndarray:
        at, known = self.find(code)
        _, back = self.corpus.backoff(group)
        out = np.log10(back) + self.p_word(code, at, known)
        k = np.flatnonzero(known)
        if len(k):
            first, end = (self.pointers.get(at[k] + i).astype(np.int64) for i in (0, 1))
            # A history's place among those of its word.
            sought = (at[k].astype(np.uint64) << np.uint64(CLASS_BITS)) | group[k]
            pair = self.histories.successor(sought, first, end)
            inside = np.minimum(pair, self.histories.size - 1)
            met = (pair < end) & (self.histories.get(inside) == sought)
            out[k[met]] = -(self.pair_p[inside[met]] / STEP)
        return out


def _answer(corpus: Corpus):
    """Maps the words that blocks ask a shard for to their counts and log probabilities, in the order asked."""
    def answered(asked: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        code, group, train, docs = [], [], [], []
        for _, _, blob in asked:
            kinds, pair, doc, flag = unpack(blob)
            kinds, pair = np.cumsum(kinds, dtype=np.uint64), np.cumsum(pair, dtype=np.uint64)
            code.append(kinds[(pair >> np.uint64(CLASS_BITS)).astype(np.int64)])
            group.append(_class(pair).astype(np.uint32))
            train.append(flag[doc])
            docs.append(doc)
        sizes = [len(c) for c in code]
        code, group, train = map(np.concatenate, (code, group, train))
        order = np.lexsort((group, code))
        code, group, train = code[order], group[order].astype(np.uint64), train[order]
        trie = Trie(code[train], group[train], corpus)
        at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (group[1:] != group[:-1])])
        value = np.empty(len(code), np.uint16)
        value[order] = np.repeat(quantised_log(trie.log10(code[at], group[at])), np.diff(np.r_[at, len(code)]))
        word = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        learnt = corpus.counts(code[word], np.add.reduceat(train.astype(np.int64), word))
        count = np.empty(len(code), np.int64)
        count[order] = np.repeat(learnt, np.diff(np.r_[word, len(code)]))
        first = np.cumsum(sizes) - sizes
        for (block, _, _), doc, a, n in zip(asked, docs, first, sizes):
            c = count[a:a + n]
            # Equal counts in a row are sent once.
            new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            yield block, WORDS, pack(c[new], np.diff(np.r_[new, n]).astype(np.uint32), doc, value[a:a + n])

    schema = pa.schema([f for f in ASKED if f.name != "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _parts(batches, "shard"):
            texts = [p for p in parts if p[1] == TEXTS]
            if texts:
                yield _batch(texts, schema)
            asked = [p for p in parts if p[1] == WORDS]
            if asked:
                yield _batch(list(answered(asked)), schema)

    return run


def _sum_blocks(total: int, distinct: int):
    """Sums the answers of each block by text."""
    names = ["key", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _parts(batches, "block"):
            keys = next(unpack(blob)[0] for _, kind, blob in parts if kind == TEXTS)
            sums = np.zeros((4, len(keys)))
            for _, kind, blob in parts:
                if kind == TEXTS:
                    continue
                c, runs, doc, value = unpack(blob)
                base = np.repeat(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))), runs)
                for s, weight in zip(sums, (None, np.repeat(c > 0, runs), base, value / -STEP)):
                    s += np.bincount(doc, weight, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(s.astype(np.int64)) for s in sums[:2]), *map(pa.array, sums[2:])], names)

    return run


def score_texts(docs: DataFrame, held_out_of: int = 10) -> DataFrame:
    """Every row as (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the rows whose crc32 remainder by `held_out_of` is not 0. NULL
    texts are empty and have their end as only word. Rows without an id have
    remainder 0. Repeated rows count each and score alike; other columns are
    not read; an empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                       (remainder(F.col("doc_id"), held_out_of) == 0).alias("held_out"))
    total, texts = rows.agg(F.sum(F.octet_length("text")), F.sum(F.when(~F.col("held_out"), 1).otherwise(0))).first()
    shards = max(1, (total or 0) // SHARD)
    shape = "shard int, blob binary"
    counted = rows.select("held_out", "text").mapInArrow(_send_counts(shards), shape)
    counted = counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _word_counts(max(HELD // 64, (total or 0) // HOT)), "blob binary")
    corpus = Corpus([r.blob for r in counted.toLocalIterator()], int(texts or 0))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    asked = "block bigint, kind int, blob binary"
    sent = keyed.select("key", "held_out", "text").mapInArrow(_send_words(shards, corpus.hot), f"shard int, {asked}")
    answers = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(_answer(corpus), asked)
    sums = answers.repartition("block").sortWithinPartitions("block").mapInArrow(
        _sum_blocks(corpus.total, corpus.distinct), "key bigint, n_tokens bigint, n_known bigint, base double, score double")
    sums = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    ids = stored(keyed.select("doc_id", "held_out", "key"))
    copies = ids.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    each = sums.join(copies, "key")
    return ids.join(each, "key").select(
        "doc_id", "held_out", *[(F.col(c) / F.col("_rows")).cast("bigint").alias(c) for c in ("n_tokens", "n_known")],
        F.lit(corpus.total).cast("bigint").alias("train_tokens"), (F.col("base") / F.col("_rows")).alias("base_score"),
        (F.col("score") / F.col("_rows")).alias("score"))
