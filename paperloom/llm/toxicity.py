"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

The channel may write a letter as a look-alike sign, repeat it, or put a blank
or sign between letters, in any mixture. Every token with a sign beside a letter or a
doubled letter, and every run of single letters or signs, becomes a lattice of what each
may stand for, itself included; Viterbi under a character trigram model of the whole corpus picks
the likeliest reading; all other text is its own only reading. The character
model is a table of fixed size, counted over every text.

The scorer asks of each word whether it marks toxic texts. Its evidence are the
different words that stand before it in toxic and in clean training texts, so
copies of a passage count once; a word without clean evidence also takes that of
its beginnings, which serves unseen forms. A text's score is the chance that one
of its words marks it. It is fitted on labelled rows only, at most
`train_rows` of them, so the list of marking words is bounded by that parameter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blobs import release
from paperloom.llm.common import remainder, stored
from paperloom.llm.mixing import seeded

# Look-alike signs and the letters they may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
               "!": "i", "|": "li", "+": "t", "€": "e"}
SIGNS = re.escape("".join(LOOK_ALIKES))
LETTER = r"[^\W\d_]"
UNIT = rf"(?:{LETTER}|[{SIGNS}])"
DISGUISED = re.compile(rf"{LETTER}[{SIGNS}]|[{SIGNS}]{LETTER}|({LETTER})\1")
SPACED = re.compile(rf"(?<![\w{SIGNS}]){UNIT}(?:[\s.,\-_*/]+{UNIT}(?![\w{SIGNS}])){{2,}}")
SIGNED = re.compile(rf"(?=.*@|.*\$\$)[{SIGNS}]{{3,}}")  # all signs, and more than a price or a number
HAS_LETTER = re.compile(LETTER)
WORDS = re.compile(rf"{LETTER}+")
SEPARATORS = " \t\n\r\f\v.,-_*/"
SOUNDS = {"8": "ate"}
EDGE = ".,;:!?\"'()"

TRIPLES, PAIRS = 1 << 18, 1 << 16
TRAIN_ROWS = 20_000
PRIOR = 1e-4  # share of words that mark toxic texts
MARKED = 0.98  # share of a marking word's places that are in toxic texts
LISTED = 0.2  # words under this chance are not listed


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() and not 0xD800 <= i < 0xE000 for i in range(0x10000)])


def _triple(a, b, c):
    return (a * 7919 + b * 31337 + c * 131) % TRIPLES


def _pair(a, b):
    return TRIPLES + (a * 31337 + b * 131) % PAIRS


def character_counts(texts: DataFrame) -> np.ndarray:
    """Counts of character triples and pairs over all texts, lower-cased, in a table of fixed size.

    Whatever is no letter of the basic plane is one blank between words.
    """
    letters = _letters()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TRIPLES + PAIRS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                text = "\n".join(t for t in batch["text"].slice(at, 64).to_pylist() if t).lower()
                x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
                x = np.where(letters[np.minimum(x, 0xFFFF)] & (x < 0x10000), x, 0)
                x = np.concatenate([[0], x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]] if len(x) else x, [0]])
                total += np.bincount(_triple(x[:-2], x[1:-1], x[2:]), minlength=len(total))
                total += np.bincount(_pair(x[:-2], x[1:-1]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = texts.select("text").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(TRIPLES + PAIRS, np.float32)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return counts


#: Readings that a worker keeps, some 250 bytes each; fewer in a pipeline, whose other stages share the executors.
KEPT, KEPT_BESIDE = 200_000, 50_000


class Restorer:
    """Reads disguised spans of a text under character counts."""

    def __init__(self, counts: np.ndarray, kept: int = KEPT):
        self.counts = counts
        self._short = lru_cache(kept // 3)(self._read)
        self.tokens = _Tokens(self._token, kept)

    def read(self, span: str) -> str:
        return self._short(span) if len(span) <= 64 else self._read(span)

    def step(self, a: int, b: int, c: int) -> float:
        """Log chance of character c after a, b; 0 is the blank."""
        return math.log((self.counts[_triple(a, b, c)] + 0.02) / (self.counts[_pair(a, b)] + 2.0))

    def _read(self, span: str) -> str:
        """The likeliest reading of a span: Viterbi over the last two characters read."""
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        i = 0
        while i < len(span):
            ch, end = span[i], i + 1
            while end < len(span) and span[end] == ch:
                end += 1
            if ch.isalpha():
                run = end - i
                options = [(ch, -0.5), (ch * 2, -0.5)] if run > 2 else [(ch * 2, 0.0), (ch, -2.0)] if run > 1 else [(ch, 0.0)]
                i = end
            elif ch in LOOK_ALIKES:
                reads = LOOK_ALIKES[ch]
                options = [(r, -0.7 - math.log(len(reads))) for r in reads] + [(ch, -4.0 if ch in "@$€" else -2.0)]
                options += [(SOUNDS[ch], -2.0)] if ch in SOUNDS else []
                i += 1
            else:
                options = [("", -0.7), (" ", -0.7)] if ch in SEPARATORS else [(" ", 0.0)]
                while end < len(span) and ch in SEPARATORS and span[end] in SEPARATORS:
                    end += 1
                i = end
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, said) in paths.items():
                for read, price in options:
                    x, y, total = a, b, cost + price
                    for r in read:
                        c = ord(r) if r.isalpha() and ord(r) < 0x10000 else 0
                        if c or y:
                            total += self.step(x, y, c)  # a sign that stays ends the word
                            x, y = y, c
                    if (x, y) not in new or total > new[x, y][0]:
                        new[x, y] = (total, said + read)
            paths = new
        return max((cost + (self.step(a, b, 0) if b else 0.0), said) for (a, b), (cost, said) in paths.items())[1]

    def _token(self, token: str) -> str:
        core = token.strip(EDGE)
        # A '!' may be an edge or an i; what stands before a letter is read with it.
        start = token.find(core) if core else 0
        if token[:start].endswith("!") and core[:1].isalpha():
            start, core = start - 1, "!" + core
        if not (DISGUISED.search(core) or SIGNED.fullmatch(core) and len(set(core)) > 1):
            return token
        return token[:start] + self.read(core) + token[start + len(core):]

    def _spaced(self, found: re.Match) -> str:
        return self.read(found[0]) if HAS_LETTER.search(found[0]) else found[0]

    def restore(self, text: str) -> str:
        """The text with all disguised spans read, its blanks folded."""
        return " ".join(map(self.tokens.__getitem__, SPACED.sub(self._spaced, text.lower()).split()))


class _Tokens(dict):
    """A token's reading, kept once worked out; forgets all when it grows over its bound."""

    def __init__(self, read, kept: int):
        super().__init__()
        self.read, self.kept = read, kept

    def __missing__(self, token: str) -> str:
        if len(self) > self.kept:
            self.clear()
        said = self[token] = self.read(token)
        return said


def _starts(word: str) -> list[str]:
    return [f"^{word[:k]}" for k in (4, 5) if len(word) > k]


def marking_words(docs: DataFrame, labels: DataFrame, restorer, held_out_of: int = 5, train_rows: int = TRAIN_ROWS,
                  seed: int = 7) -> dict[str, float]:
    """Words, and beginnings as ^text, to the chance that they mark a toxic text.

    Learns from labelled rows whose crc32 remainder by `held_out_of` is not 0, the
    first `train_rows` of them in a seeded order. Of several labels of an id the
    toxic one holds; NULL labels and ids teach nothing. A word known from clean
    texts and no sign of toxic ones is listed with 0 if one of its beginnings is listed.
    """
    known = (labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null")
             .filter(remainder(F.col("doc_id"), held_out_of) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    taken = known.orderBy(seeded(F.col("doc_id"), seed), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(taken), "doc_id").select("text", "toxic")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                words = WORDS.findall(restorer.restore(text))
                pairs = list({*zip(words, ["", *words])})
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string()),
                                                  pa.array([int(toxic > 0)] * len(pairs), pa.int32())], ["word", "before", "toxic"])
        restorer.forget()

    found = rows.mapInArrow(places, "word string, before string, toxic int")
    # A place is the word and the hash of the word before it.
    found = found.select("word", F.xxhash64("before").alias("before"), "toxic").distinct()
    words = stored(found.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    total = words.agg(F.sum("bad"), F.sum("good")).first()
    bad, good = total[0] or 0, total[1] or 0
    if not bad or not good:
        return {}
    base = bad / (bad + good)
    up, down = math.log(MARKED / base), math.log((1 - MARKED) / (1 - base))
    log_odds = F.lit(math.log(PRIOR / (1 - PRIOR))) + F.col("bad") * up + F.col("good") * down
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), log_odds))))
    listed = words.withColumn("chance", chance).filter(F.col("chance") >= LISTED).select("word", "chance")
    starts = None
    for k in (4, 5):
        of_k = (words.filter(F.length("word") > k).groupBy(F.concat(F.lit("^"), F.substring("word", 1, k)).alias("word"))
                .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("chance", chance)
                .filter(F.col("chance") >= LISTED).select("word", "chance"))
        starts = of_k if starts is None else starts.unionByName(of_k)
    out = {r.word: r.chance for r in listed.unionByName(starts).toLocalIterator()}
    begun = [w for w in out if w[0] == "^"]
    if begun:
        clean = words.filter("good > 0").filter(F.concat(F.lit("^"), F.substring("word", 1, 4)).isin(begun)
                                                | F.concat(F.lit("^"), F.substring("word", 1, 5)).isin(begun)).select("word")
        for r in clean.toLocalIterator():
            out.setdefault(r.word, 0.0)
    return out


class _Chances(dict):
    """A word's chance, kept once worked out; forgets all when it grows over its bound."""

    def __init__(self, marks: dict[str, float], kept: int = 2 * KEPT):
        super().__init__()
        self.marks, self.kept = marks, kept

    def __missing__(self, word: str) -> float:
        if len(self) > self.kept:
            self.clear()
        chance = self.marks.get(word)
        if chance is None:
            chance = max((self.marks.get(s, 0.0) for s in _starts(word)), default=0.0)
        self[word] = chance
        return chance


def text_score(text: str | None, restorer: Restorer, chances: _Chances) -> float:
    words = set(WORDS.findall(restorer.restore(text))) if text else ()
    clean = 0.99
    for word in words:
        if chance := chances[word]:
            clean *= 1 - min(chance, 0.999)
    return 1 - clean


def score_texts(docs: DataFrame, corpus: DataFrame, labels: DataFrame, held_out_of: int = 5,
                train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    `corpus` gives the character counts and, with `labels`, the training rows.
    score is 0.01 for a text without any sign, also for NULL and empty ones, and
    for all texts if no label teaches both classes. Rows without an id count as
    held out. Repeated rows and ties score alike; other columns are not read.
    """
    restorer = _Sent(character_counts(corpus))
    marks = marking_words(corpus, labels, restorer, held_out_of, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances = _Chances(marks)
        for batch in batches:
            scores = [text_score(t.as_py(), restorer.made, chances) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])
        chances.clear()
        restorer.forget()

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), held_out_of) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


class _Sent:
    """Counts that become a Restorer where they arrive."""

    def __init__(self, counts: np.ndarray, kept: int = KEPT):
        self.counts, self.kept = counts, kept

    def __reduce__(self):
        return _Sent, (self.counts, self.kept)

    @property
    def made(self) -> Restorer:
        if "_made" not in self.__dict__:
            self._made = Restorer(self.counts, self.kept)
        return self._made

    def restore(self, text: str) -> str:
        return self.made.restore(text)

    def forget(self) -> None:
        """Drops what the worker keeps and gives its memory back; workers live on."""
        self.__dict__.pop("_made", None)
        release()


def clean_only(docs: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores under 0.5; scored row by row, so rows without an id are judged too."""
    restorer = _Sent(character_counts(corpus), KEPT_BESIDE)
    marks = marking_words(corpus, labels, restorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances = _Chances(marks, 2 * KEPT_BESIDE)
        for batch in batches:
            kept = [text_score(t.as_py(), restorer.made, chances) < 0.5 for t in batch["text"]]
            yield batch.filter(pa.array(kept, pa.bool_()))
        chances.clear()
        restorer.forget()

    return docs.mapInArrow(run, docs.schema)
