"""Places of a dictionary's words in batches of texts, looked up for all words at once, and what they say of topics.

The first characters of every place are hashed; places whose hash is that of a
word's beginning are compared with the word, character by character. So a place
costs a few array operations, whatever the number of words. Functions of this
module travel to the executors by value.
"""

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 5  # characters of a word's beginning that are hashed, all of it if shorter
CHARS = 1 << 20  # characters looked at together
EDGE = "\ud800"  # stands between texts; no text can hold it
FACTOR, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 18)
PRESENT, EXACT, BARE, PARTIAL, MENTION, RELATED = (1 << i for i in range(6))
BITS = 6
PLAIN = re.compile(r"[a-z0-9_](.*[a-z0-9_])?", re.S)
PARTIAL_LENGTH, MENTION_LENGTH = 5, 6


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _in_word(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)) | (codes == 95)


def dictionary(words: list[str]) -> dict:
    """The words as arrays, and a table of their beginnings for each length up to SEED."""
    size = np.array([len(w) for w in words], np.int64)
    chars = np.zeros((len(words), int(size.max(initial=0))), np.uint32)
    for row, word in zip(chars, words):
        row[:len(word)] = _codes(word)
    tables, key = {}, np.zeros(len(words), np.uint64)
    for length in range(1, min(SEED, chars.shape[1]) + 1):
        key = (key ^ chars[:, length - 1]) * FACTOR
        which = np.flatnonzero(np.minimum(size, SEED) == length)
        if len(which):
            which = which[np.argsort(key[which])]
            known, first, count = np.unique(key[which], return_index=True, return_counts=True)
            seen = np.zeros(1 << int(64 - SHIFT), bool)
            seen[known >> SHIFT] = True
            tables[length] = (seen, known, first, count, which)
    return {"size": size, "chars": chars, "tables": tables, "plain": np.array([PLAIN.fullmatch(w) is not None for w in words], bool)}


def _met(codes: np.ndarray, low: int, high: int, words: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places from `low` to `high` and the words that begin there, so far as their beginnings tell."""
    key = np.zeros(high - low, np.uint64)
    for length in range(1, max(words["tables"], default=0) + 1):
        key ^= codes[low + length - 1:high + length - 1]
        key *= FACTOR
        if length not in words["tables"]:
            continue
        seen, known, first, count, which = words["tables"][length]
        at = np.flatnonzero(seen[key >> SHIFT])
        row = np.minimum(np.searchsorted(known, key[at]), len(known) - 1)
        hit = known[row] == key[at]
        at, row = at[hit], row[hit]
        of = np.repeat(np.arange(len(at)), count[row])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count[row]) - count[row], count[row])
        yield at[of] + low, which[first[row][of] + nth]


def _there(codes: np.ndarray, place: np.ndarray, word: np.ndarray, words: dict) -> tuple[np.ndarray, np.ndarray]:
    """Those places where the whole word stands."""
    places, found, size, chars = [], [], words["size"], words["chars"]
    for k in range(chars.shape[1] + 1):
        done = size[word] == k
        places.append(place[done])
        found.append(word[done])
        place, word = place[~done], word[~done]
        if not len(place):
            break
        same = codes[place + k] == chars[word, k]
        place, word = place[same], word[same]
    return np.concatenate(places), np.concatenate(found)


def _tests(codes: np.ndarray, place: np.ndarray, word: np.ndarray, words: dict) -> np.ndarray:
    """The flags of every word's place, by the character before it and the three after it."""
    size, edge = words["size"][word], ord(EDGE)
    before, after, second, third = (codes[place - 1], *(codes[place + size + i] for i in range(3)))
    around = ((before == 32) & ((after == edge) | (after == 32) | (after == 44) | (after == 46))) | ((before == edge) & (after == 32))
    listed = around | ((before == 40) & (after == 41))
    free = ~_in_word(before) & ~_in_word(after)
    plain = words["plain"][word]
    ending = (((after == 115) & (second == 32)) | ((after == 105) & (second == 110) & (third == 103))
              | ((after == 101) & (second == 100)) | ((after == 39) & (second == 115)))
    return (PRESENT + EXACT * np.where(plain, free, listed) + BARE * np.where(plain, free, around)
            + PARTIAL * ((size >= PARTIAL_LENGTH) & ending) + MENTION * ((size >= MENTION_LENGTH) | listed)).astype(np.int64)


def _hits(texts: list[str], related: np.ndarray, words: dict, related_at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of hits of each text, hits): word number and flags of every word that a text has or is related to."""
    codes = _codes(EDGE + EDGE.join(texts) + EDGE * (words["chars"].shape[1] + 3 + SEED))
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths + 1
    last = int(lengths.sum()) + 1
    n_words = max([len(words["size"]), *(i + 1 for i in related_at)])
    pairs, flags = [], []
    for low in range(1, last, CHARS):
        for place, word in _met(codes, low, min(low + CHARS, last), words):
            place, word = _there(codes, place, word, words)
            pairs.append((np.searchsorted(starts, place, "right") - 1) * n_words + word)
            flags.append(_tests(codes, place, word, words))
    for bit, at in enumerate(related_at):
        rows = np.flatnonzero(related >> bit & 1)
        pairs.append(rows * n_words + at)
        flags.append(np.full(len(rows), RELATED, np.int64))
    pair, flag = np.concatenate(pairs), np.concatenate(flags)
    if not len(pair):
        return np.zeros(len(texts), np.int64), pair
    order = np.argsort(pair)
    pair, first = np.unique(pair[order], return_index=True)
    folded = np.bitwise_or.reduceat(flag[order], first)
    return np.bincount(pair // n_words, minlength=len(texts)), (pair % n_words) << BITS | folded


def finder(spoken: list[str], related_at: list[int]):
    """A function of texts and masks of related words to lists of (word number << BITS | flags); words are numbered as in `spoken`.

    Bit k of a mask says that the text is related to the word numbered `related_at[k]`.
    """
    words = dictionary(spoken)

    def look(texts: pa.Array, related: pa.Array) -> pa.Array:
        counts, hits = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        masks = related.to_numpy(zero_copy_only=False)
        held, chars, start = [], 0, 0
        for i, text in enumerate(texts):
            held.append(text.as_py() or "")
            chars += len(held[-1])
            if chars >= CHARS or i + 1 == len(texts):
                n, found = _hits(held, masks[start:i + 1], words, related_at)
                counts.append(n)
                hits.append(found)
                held, chars, start = [], 0, i + 1
        offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hits).astype(np.int32)))

    return look


def finder_of_copies(spoken: list[str], related_at: list[int]):
    """`finder` for the copies of each id: lists of texts and masks to lists of lists of hits."""
    look = finder(spoken, related_at)

    def each(texts: pa.Array, related: pa.Array) -> pa.Array:
        offsets = np.append(0, np.cumsum(texts.value_lengths().to_numpy()))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), look(texts.flatten(), related.flatten()))

    return each


def _spots(hits: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and flags of all hits of all copies."""
    copies = hits.flatten()
    row = np.repeat(np.arange(len(hits)), hits.value_lengths().to_numpy())
    hit = copies.flatten().to_numpy()
    return np.repeat(row, copies.value_lengths().to_numpy()), hit >> BITS, hit & ((1 << BITS) - 1)


def listing(words: list[str], listed: list[tuple], topics: list[str]) -> dict:
    """Rows (word, topic, use, times) by the number of their word, topics by theirs; words that are not looked for are left out."""
    number, place = {w: i for i, w in enumerate(words)}, {t: i for i, t in enumerate(topics)}
    rows = sorted((number[w], place[t], use, times) for w, t, use, times in listed if w in number)
    table = np.array(rows, np.int64).reshape(-1, 4)
    count = np.bincount(table[:, 0], minlength=len(words))
    return {"first": np.cumsum(count) - count, "count": count, "topic": table[:, 1], "use": table[:, 2], "times": table[:, 3],
            "size": np.array([len(w) for w in words], np.int64), "n_topics": max(len(topics), 1)}


def _pairs(row: np.ndarray, word: np.ndarray, table: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit, row of the table and number of (row, topic) of every listing of every hit."""
    count = table["count"][word]
    of = np.repeat(np.arange(len(word)), count)
    entry = np.repeat(table["first"][word] - np.cumsum(count) + count, count) + np.arange(len(of))
    return of, entry, row[of] * table["n_topics"] + table["topic"][entry]


def _kinds(word: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The first of EXACT, PARTIAL and RELATED that holds, else 0."""
    return np.where(flags & EXACT, EXACT, np.where(flags & PARTIAL, PARTIAL, flags & RELATED))


def kinds(wanted: list[bool]):
    """A function of hits to those of the wanted words that match, the kind of match as their only flag."""
    keep = np.array(wanted, bool)

    def match(hits: pa.Array) -> pa.Array:
        row, word, flags = _spots(hits)
        kind = _kinds(word, flags)
        good = (kind != 0) & keep[word]
        copies = np.repeat(np.arange(len(hits.flatten())), hits.flatten().value_lengths().to_numpy())
        inner = np.append(0, np.cumsum(np.bincount(copies[good], minlength=len(hits.flatten()))))
        outer = np.append(0, np.cumsum(hits.value_lengths().to_numpy()))
        lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(word[good] << BITS | kind[good], pa.int32()))
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), lists)

    return match


def _scores(matches: pa.Array, table: dict, worth: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, topic) pairs with a match and their scores, before what calculations change."""
    row, word, kind = _spots(matches)
    of, entry, pair = _pairs(row, word, table)
    pair, at = np.unique(pair, return_inverse=True)
    kind, long = kind[of], table["size"][word[of]] > worth["long"]

    def count(which):
        return np.bincount(at[which], minlength=len(pair))

    exact, partial, related = count(kind == EXACT), count(kind == PARTIAL), count(kind == RELATED)
    base = (exact * worth["exact"] + partial * worth["partial"] + related * worth["related"] + np.where(exact > 1, 2.0, 0.0)
            + np.where(count((kind == EXACT) & long) > 0, 1.0, 0.0))
    return pair, np.where((exact == 0) & (partial < 2), base * 0.3, base)


def _named(n: int, pair: np.ndarray, value: np.ndarray, topics: list[str], name: str) -> pa.Array:
    """Lists of (topic, value) by row."""
    row, topic = np.divmod(pair, max(len(topics), 1))
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    names = pa.array(topics, pa.string()).take(pa.array(topic))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([names, pa.array(value, pa.float64())], names=["topic", name]))


def scorer(table: dict, topics: list[str], worth: dict):
    """A function of matches to lists of (topic, score) of each id."""
    def score(matches: pa.Array) -> pa.Array:
        return _named(len(matches), *_scores(matches, table, worth), topics, "score")

    return score


def _bonuses(hits: pa.Array, flag: int, table: dict, each: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, topic) pairs of the listings of hits with the flag, and their number times `each`."""
    row, word, flags = _spots(hits)
    good = (flags & flag) != 0
    pair, n = np.unique(_pairs(row[good], word[good], table)[2], return_counts=True)
    return pair, n * each


def _mentions(hits: pa.Array, table: dict, bonus: float) -> tuple[np.ndarray, np.ndarray]:
    pair, _ = _bonuses(hits, PRESENT, table, 1.0)
    return pair, np.full(len(pair), bonus)


def mentioner(table: dict, topics: list[str], bonus: float):
    """A function of hits to lists of (topic, bonus), once for each topic with a listed word in the text."""
    def mention(hits: pa.Array) -> pa.Array:
        return _named(len(hits), *_mentions(hits, table, bonus), topics, "bonus")

    return mention


def chooser(keywords: dict, concepts: dict, phrases: dict, topics: list[str], calculation: list[bool], worth: dict):
    """A function of matches, hits and flags of calculations to lists of (topic, score), the best first.

    Topics are numbered in the order of their names, so ties go to the lower one.
    """
    about = np.array(calculation, bool)

    def choose(matches: pa.Array, hits: pa.Array, flags: pa.Array) -> pa.Array:
        n, n_topics = len(hits), max(len(topics), 1)
        # A copy without any word tells nothing, also not that it is a calculation.
        counted = flags.flatten().fill_null(False).to_numpy(zero_copy_only=False) & (hits.flatten().value_lengths().to_numpy() > 0)
        of = np.repeat(np.arange(n), hits.value_lengths().to_numpy())
        computational = np.bincount(of[counted], minlength=n) > 0
        pair, base = _scores(matches, keywords, worth)
        row, topic = np.divmod(pair, n_topics)
        base = np.where(~computational[row], base, np.where(about[topic], base + 1.0, base * 0.5))
        parts = [(pair, base), _bonuses(hits, BARE, concepts, worth["concept"]), _mentions(hits, phrases, worth["mention"])]
        every, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        score = np.bincount(at, weights=np.concatenate([s for _, s in parts]), minlength=len(every))
        row, topic = np.divmod(every, n_topics)
        # A calculation topic gets its point without any keyword hit, so it can pass with a bonus alone.
        score = score + np.where(computational[row] & about[topic] & ~np.isin(every, pair), 1.0, 0.0)
        passed = score >= np.where(computational[row], worth["least"] + 1, worth["least"])
        order = np.lexsort((topic[passed], -score[passed], row[passed]))
        every, row, score = every[passed][order], row[passed][order], score[passed][order]
        count = np.bincount(row, minlength=n)
        rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        best = rank < np.where(computational[row], 2, 3)
        return _named(n, every[best], score[best], topics, "score")

    return choose


def rater(profiles: dict, topics: list[str]):
    """A function of hits and lists of topics to lists of their relevance, before tone and length; NULL for topics unknown.

    Uses are 0 for titles, 1 for title words and 2 for keywords, which count if mentioned.
    """
    known = pa.array(topics, pa.string())

    def rate(hits: pa.Array, asked: pa.Array) -> pa.Array:
        row, word, flags = _spots(hits)
        good = (flags & PRESENT) != 0
        row, word, flags = row[good], word[good], flags[good]
        of, entry, pair = _pairs(row, word, profiles)
        pair, at = np.unique(pair, return_inverse=True)
        use, times = profiles["use"][entry], profiles["times"][entry]

        def total(which):
            return np.append(np.bincount(at[which], weights=times[which], minlength=len(pair)), 0.0)

        title, said = total(use == 0) > 0, total(use == 1)
        listed = total((use == 2) & ((flags[of] & MENTION) != 0))
        base = 1.0 + np.where(title, 10.0, 0.0) + said * 2.0 + np.where(said > 1, 3.0, 0.0) + np.minimum(listed, 5)
        topic = pc.index_in(asked.flatten(), value_set=known)
        missing = topic.is_null().to_numpy(zero_copy_only=False)
        lengths = asked.value_lengths().to_numpy()
        wanted = np.repeat(np.arange(len(asked)), lengths) * profiles["n_topics"] + topic.fill_null(0).to_numpy()
        spot = np.minimum(np.searchsorted(pair, wanted), max(len(pair) - 1, 0))
        spot = np.where(pair[spot] == wanted, spot, len(pair)) if len(pair) else np.zeros(len(wanted), np.int64)
        offsets = np.append(0, np.cumsum(lengths))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(base[spot], pa.float64(), mask=missing))

    return rate


def named_labels(meant: dict[str, str]):
    """A function of lists of labels to lists of the topics they stand for, NULL for those that stand for none."""
    labels, topics = pa.array(list(meant), pa.string()), pa.array(list(meant.values()), pa.string())

    def name(said: pa.Array) -> pa.Array:
        offsets = np.append(0, np.cumsum(said.value_lengths().fill_null(0).to_numpy()))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), topics.take(pc.index_in(said.flatten(), value_set=labels)))

    return name
