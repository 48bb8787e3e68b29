"""Conversation structure repair: Viterbi over turns in chunks that run at once and agree by rank convergence.

Each turn is a symbol: the class of its role (system, user, assistant, other) and its fault. Edits keep, rerole or delete
it and insert empty turns, so that the role initials match (s?(ua)+)?. The cost to go from a place is a vector over four
states: nothing said yet, last said s, u or a.

Vectors run backwards. All chunks of a conversation start at once, the last from the true final vector, the others from the
same one as a guess. A fix-up pass hands each chunk the vector at which the next one begins; where that differs from the
one used by more than a constant, the chunk runs again, but only until its vectors differ from its earlier ones by a
constant, as all before then do too. Passes end when no chunk's vector changes. Only differences of a vector matter for
choices, and few different ones exist: they are listed once, and a run is a walk through a table of them.

Then each chunk is traced forwards from all four states by the stitched vectors, taking among the cheapest edits the one
whose letter is least, and the chunks' state maps are composed by doubling. No task holds a whole conversation but the last
one, which streams a conversation's turns in order through its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import stored
from paperloom.llm.turns import numbered

CHUNK = 256  # turns of a chunk
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
START, S, U, A = range(4)
FAR = 1 << 20
#: What may be said next in each state, and the state after it.
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: The empty turn that may be inserted in each state.
INSERTED = {START: "u", S: "u", U: "a", A: "u"}
CLASSES, FAULTS = "suao", ("fine", "truncated", "must go")
#: A symbol is a letter: class by class, the three faults.
SYMBOLS = [chr(ord("a") + 3 * c + f) for c in range(4) for f in range(3)]
#: Letters of what is done; lower case says which empty turn is inserted before or after.
INITIALS = {"K": "K", "U": "R", "A": "R", "D": "D", "u": "I", "a": "I"}


def _steps(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """The edits of one turn in a state, as (letter, cost, state after)."""
    role, fault = CLASSES[symbol // 3], FAULTS[symbol % 3]
    steps = [("D", DELETE, state)]
    if fault != "must go":
        more = TRUNCATED * (fault == "truncated")
        steps += [("K", KEEP + more, after) for said, after in NEXT[state].items() if said == role]
        steps += [(said.upper(), REROLE + more, after) for said, after in NEXT[state].items() if said in "ua"]
    return steps


def _closed(costs: list[int]) -> list[int]:
    """Costs to go when empty turns may come first; two of them reach every state that any number reaches."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q][INSERTED[q]]]) for q, c in enumerate(costs)]
    return costs


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a turn from the one after it, less its least entry."""
    costs = _closed([min(cost + after[to] for _, cost, to in _steps(q, symbol)) for q in range(4)])
    return tuple(c - min(costs) for c in costs)


FINAL = tuple(_closed([0, FAR, FAR, 0]))


def _vectors() -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """All vectors that turns can lead to from FINAL, and for each the number of the one before each symbol."""
    vectors, table = [FINAL], []
    for vector in vectors:
        row = []
        for symbol in range(len(SYMBOLS)):
            made = _before(symbol, vector)
            if made not in vectors:
                vectors.append(made)
            row.append(vectors.index(made))
        table.append(row)
    return vectors, table


VECTORS, BEFORE = _vectors()


def _ending(state: int) -> str:
    """The empty turns that end a conversation: none where it may end."""
    letters = ""
    while FINAL[state]:
        letters += INSERTED[state]
        state = NEXT[state][INSERTED[state]]
    return letters


def _choice(state: int, symbol: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The letters of one turn and the state after it: the cheapest whose initials are least."""
    found = []
    letters, cost, at = "", 0, state
    for _ in range(4):
        found += [(cost + price + after[to], "".join(INITIALS[x] for x in letters + letter), letters + letter, to)
                  for letter, price, to in _steps(at, symbol)]
        letters, cost, at = letters + INSERTED[at], cost + INSERT, NEXT[at][INSERTED[at]]
    _, _, letters, to = min(found)
    return letters, to


CHOICES = [[[_choice(q, symbol, after) for symbol in range(len(SYMBOLS))] for q in range(4)] for after in VECTORS]
ENDINGS = [_ending(q) for q in range(4)]


def walk(symbols: str, after: int, earlier: bytes = b"") -> bytes:
    """The numbers of the vectors before each turn, given the one after the last.

    With the numbers of an `earlier` run, it stops where both agree: before that they agree too.
    """
    out = bytearray(earlier or bytes(len(symbols)))
    for i in range(len(symbols) - 1, -1, -1):
        after = BEFORE[after][ord(symbols[i]) - 97]
        if earlier and out[i] == after:
            break
        out[i] = after
    return bytes(out)


def trace(symbols: str, vectors: bytes, after: int, state: int) -> tuple[list[str], int]:
    """The letters of each turn and the last state, from a first state on."""
    letters = []
    for i, symbol in enumerate(symbols):
        done, state = CHOICES[vectors[i + 1] if i + 1 < len(symbols) else after][state][ord(symbol) - 97]
        letters.append(done)
    return letters, state


@F.pandas_udf(T.BinaryType())
def _walked(symbols: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([walk(s, a) for s, a in zip(symbols, after)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _rewalked(symbols: pd.Series, after: pd.Series, earlier: pd.Series) -> pd.Series:
    return pd.Series([walk(s, a, bytes(e)) for s, a, e in zip(symbols, after, earlier)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _exits(symbols: pd.Series, vectors: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[trace(s, bytes(v), a, q)[1] for q in range(4)] for s, v, a in zip(symbols, vectors, after)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _letters(symbols: pd.Series, vectors: pd.Series, after: pd.Series, state: pd.Series, last: pd.Series) -> pd.Series:
    out = []
    for s, v, a, q, is_last in zip(symbols, vectors, after, state, last):
        letters, q = trace(s, bytes(v), a, q)
        if is_last:
            letters[-1] += ENDINGS[q]
        out.append(letters)
    return pd.Series(out, dtype=object)


def _first(vectors: str) -> Column:
    """The number of the vector before a chunk's first turn."""
    return F.conv(F.hex(F.substring(vectors, 1, 1)), 16, 10).cast("int")


KEY = ["conv", "none"]


def edits(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, none, at, symbol) to (conv, none, at, letters), `at` counting a conversation's turns from 0."""
    listed = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    chunks = (turns.groupBy(*KEY, F.floor(F.col("at") / chunk).alias("chunk"))
              .agg(F.array_join(F.transform(listed, lambda t: t["symbol"]), "").alias("symbols")))
    counts = chunks.groupBy(*KEY).agg(F.max("chunk").alias("final"))
    chunks = chunks.join(counts, KEY).withColumn("after", F.lit(0))
    chunks = stored(chunks.withColumn("vectors", _walked("symbols", "after")).withColumn("first", _first("vectors")))
    alone, many = chunks.filter(F.col("final") == 0), chunks.filter(F.col("final") > 0)
    while True:
        begins = many.select(*KEY, (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("needed"))
        met = many.join(begins, [*KEY, "chunk"], "left").withColumn("stale", F.coalesce(F.col("needed") != F.col("after"), F.lit(False)))
        met = stored(met)
        if not met.filter("stale").limit(1).count():
            break
        again = (met.filter("stale").withColumn("vectors", _rewalked("symbols", "needed", "vectors"))
                 .withColumns({"after": F.col("needed"), "first": _first("vectors")}))
        many = stored(met.filter("not stale").unionByName(again).drop("needed", "stale"))
    longest = many.agg(F.max("final")).first()[0] or 0
    # Maps from a conversation's first state to the state after each chunk, over ever longer runs of chunks.
    maps = many.select(*KEY, "chunk", _exits("symbols", "vectors", "after").alias("to")) if longest else None
    reach = 1
    while reach <= longest:
        maps = stored(maps)
        earlier = maps.select(*KEY, (F.col("chunk") + reach).alias("chunk"), F.col("to").alias("by"))
        maps = maps.join(earlier, [*KEY, "chunk"], "left").select(
            *KEY, "chunk", F.when(F.col("by").isNull(), F.col("to")).otherwise(F.transform("by", lambda q: F.element_at("to", q + 1))).alias("to"))
        reach *= 2
    ready = alone.withColumn("state", F.lit(START))
    if longest:
        entered = maps.select(*KEY, (F.col("chunk") + 1).alias("chunk"), F.col("to")[START].alias("state"))
        ready = ready.unionByName(many.join(entered, [*KEY, "chunk"], "left").fillna(START, ["state"]))
    done = ready.select(*KEY, "chunk", _letters("symbols", "vectors", "after", "state", F.col("chunk") == F.col("final")).alias("letters"))
    return done.select(*KEY, "chunk", F.posexplode("letters").alias("i", "letters")).select(*KEY, (F.col("chunk") * chunk + F.col("i")).alias("at"), "letters")


def marked(turns: DataFrame) -> DataFrame:
    """Turns (conv, none, turn, role, text) with their place `at` and their `fault`: blank, duplicate, truncated or NULL.

    Turns go by number, NULL first, ties by a hash of role and text. A blank turn has no word; a duplicate's role and text (compared
    by 128-bit hashes) stand earlier in the conversation; a truncated one's last character, blanks apart, is none of .!?
    """
    keyed = turns.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})
    placed = numbered(keyed, KEY, [F.col("turn"), F.col("h1"), F.col("h2")], "at").drop("_pid")
    # Places are unique, so this join has no hot key however often a text is repeated.
    firsts = placed.groupBy(*KEY, "h1", "h2").agg(F.min("at").alias("at")).select(*KEY, "at", F.lit(True).alias("new"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    fault = F.when(blank, "blank").when(F.col("new").isNull(), "duplicate").when(cut, "truncated")
    return stored(placed.drop("h1", "h2").join(firsts, [*KEY, "at"], "left").withColumn("fault", fault).drop("new"))


def _symbol() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    return F.char(kind * 3 + fault + 97)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every turn of `marked` with the letters of the least audit among the cheapest repairs.

    Letters in order: u, a insert an empty user or assistant turn; K keeps the turn, U, A give it the role user or
    assistant, D deletes it. Repeated rows are turns of their own, an empty table gives no rows.
    """
    return turns.join(edits(turns.select(*KEY, "at", _symbol().alias("symbol")), chunk), [*KEY, "at"])


AUDITS = pa.schema([("conv", pa.int64()), ("none", pa.bool_()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    ("audit", pa.string()), ("repaired_sha256", pa.string())])
ROLES = {"u": "user", "a": "assistant"}


class _Audit:
    """What is known of one conversation while its turns pass in order."""

    def __init__(self, key: tuple):
        self.key, self.faults, self.illegal, self.cost = key, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        self.letters: list[str] = []
        self.low = self.high = self.turn = self.initial = None
        self.distinct, self.said, self.sha = 0, False, hashlib.sha256()

    def say(self, line: str) -> None:
        self.sha.update((("\n" if self.said else "") + line).encode())
        self.said = True

    def add(self, turn: int | None, role: str, text: str, fault: str | None, letters: str) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.turn = turn
        if fault:
            self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        for x in letters:
            kind = INITIALS[x]
            self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[kind]
            if kind in "KR":
                self.cost += TRUNCATED * (fault == "truncated")
                self.say(f"{role if kind == 'K' else ROLES[x.lower()]}:{text}")
            elif kind == "I":
                self.say(f"{ROLES[x]}:")
            self.letters.append(kind)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (*self.key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest())


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with letters to one row for each conversation; the turns stream."""
    held, now = [], None
    for batch in batches:
        for conv, none, *rest in zip(*[batch[c].to_pylist() for c in (*KEY, "turn", "role", "text", "fault", "letters")]):
            if now is None or now.key != (conv, none):
                held += [now.row()] if now else []
                now = _Audit((conv, none))
            now.add(*rest)
        if len(held) > 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), AUDITS)], schema=AUDITS)
            held = []
    held += [now.row()] if now else []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), AUDITS)], schema=AUDITS)


def audits(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of `repair`: gaps, faults, illegal neighbours, cost, audit and SHA-256 of the repaired text."""
    columns = [*KEY, "at", "turn", "role", "text", "fault", "letters"]
    ordered = repaired.select(*columns).repartition(*KEY).sortWithinPartitions(*KEY, "at")
    kinds = {"int64": "bigint", "bool": "boolean", "string": "string"}
    return ordered.mapInArrow(_audits, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in AUDITS))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the test damage, by crc32(conv_id:turn) % 20: 0 drops, 1 empties, 2 takes .!? away, 3 repeats, 4 sets role user.

    NULLs count as one blank, in the hash too; rows without a conv_id are one conversation (`none`).
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    does = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), does.alias("does")).filter("does <> 0")
    text = F.when(F.col("does") == 1, "").when(F.col("does") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("does") == 3, 2).otherwise(1)
    return (rows.select(*KEY, "turn", F.when(F.col("does") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy"))


def repair_damaged(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damages, repairs and audits every conversation; one of which nothing is left has zeros and the empty text's SHA-256.

    See `damaged` for NULLs, `marked` for ties and faults. Other columns are not read; an empty table gives no rows.
    """
    made = audits(repair(marked(damaged(conversations)), chunk))
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (ids.join(made, KEY, "left").fillna(0, numbers).select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
