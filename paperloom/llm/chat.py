"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation has at most one system turn, first, and then user and
assistant turns by turns, the assistant's last. Its states are the role of the
last turn. For each input turn a repair may keep its role, relabel it, or merge
it into the turn before, after inserting empty turns where needed; after the last
turn empty ones may follow. Each choice has a cost and the cheapest repair wins;
ties go to the choice listed first.

The cheapest way through some turns is a small matrix, entry by exit state, and
matrices combine, so a conversation is cut into blocks of the turn number: the
matrices of all blocks, then their entry and exit states over groups of blocks,
then the repair inside each block. No task holds a whole long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored

ROLES = ("system", "user", "assistant")
STATES = ("start", *ROLES)
LEGAL = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
MERGE, RELABEL, INSERT = 1, 3, 2
LAST = STATES.index("assistant")
BLOCK = 4096  # turn numbers of a block, blocks of a group
FAR = 1 << 40


def _insertions() -> dict[tuple[int, int], list[str]]:
    """The fewest empty turns that lead from one state to another."""
    ways: dict[tuple[int, int], list[str]] = {(q, q): [] for q in range(4)}
    for _ in range(4):
        for (a, b), way in list(ways.items()):
            for role in ROLES:
                step = (a, STATES.index(role))
                if (STATES[b], role) in LEGAL and len(way) + 1 < len(ways.get(step, ROLES * 2)):
                    ways[step] = [*way, role]
    return ways


INSERTIONS = _insertions()


def _choices(role: str | None) -> dict[tuple[int, int], tuple[int, list[str], str, str]]:
    """For an input turn: (entry, exit) to cost, roles inserted before, role given and action."""
    best: dict[tuple[int, int], tuple[int, list[str], str, str]] = {}
    for (entry, mid), way in INSERTIONS.items():
        for given in ROLES:
            price = INSERT * len(way) + RELABEL * (given != role)
            options = []
            if (STATES[mid], given) in LEGAL:
                options.append((price, way, given, "keep" if given == role else "relabel"))
            if STATES[mid] == given and not way:
                options.append((price + MERGE, way, given, "merge"))
            for option in options:
                at = (entry, STATES.index(given))
                if at not in best or option[0] < best[at][0]:
                    best[at] = option
    return best


CHOICES = {role: _choices(role) for role in (*ROLES, None)}
COSTS = {role: np.array([[c.get((a, b), (FAR,))[0] for b in range(4)] for a in range(4)], np.int64) for role, c in CHOICES.items()}
UNIT = np.where(np.eye(4, dtype=bool), 0, FAR)
#: What it costs to end in each state: empty turns up to an assistant's.
ENDING = np.array([INSERT * len(INSERTIONS[q, LAST]) for q in range(4)], np.int64)


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def through(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """The states after each of the matrices on the cheapest way from `entry` to `exit_`."""
    costs, back = np.where(np.arange(4) == entry, 0, FAR), []
    for m in matrices:
        total = costs[:, None] + m
        back.append(total.argmin(axis=0))
        costs = np.minimum(total.min(axis=0), FAR)
    states = [exit_]
    for choice in reversed(back):
        states.append(int(choice[states[-1]]))
    return states[-2::-1] if matrices else []


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Neighbouring rows of equal keys."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, itemgetter(*keys)):
        yield key, list(group)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


MATRIX = pa.list_(pa.int64())
BLOCKS = pa.schema([("conv", pa.int64()), ("none", pa.bool_()), ("blk", pa.int64()), ("m", MATRIX)])
PATHS = pa.schema([("conv", pa.int64()), ("none", pa.bool_()), ("blk", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_())])
PIECES = pa.schema([("conv", pa.int64()), ("none", pa.bool_()), ("block", pa.int64()), ("at", pa.int64()), ("step", pa.int32()), ("turn", pa.int64()),
                    ("role", pa.string()), ("action", pa.string()), ("cost", pa.int32()), ("rendered", pa.string())])
KEY = ["conv", "none"]


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "bigint", "int32": "int", "bool": "boolean"}
    return ", ".join(f"{f.name} {'array<bigint>' if f.type == MATRIX else kinds.get(str(f.type), 'string')}" for f in schema)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with roles to one matrix for each block; rows stream, so ties of any number fit."""
    def made() -> Iterator[tuple]:
        now, total = None, UNIT
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv", "none", "blk", "role")]
            for conv, none, blk, role in zip(*columns):
                if (conv, none, blk) != now:
                    if now is not None:
                        yield (*now, total.ravel().tolist())
                    now, total = (conv, none, blk), UNIT
                total = _then(total, COSTS[role])
        if now is not None:
            yield (*now, total.ravel().tolist())

    yield from _emit(made(), BLOCKS)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted, to the matrix of each group of blocks (column blk is the group)."""
    def made() -> Iterator[tuple]:
        for (conv, none, grp), rows in _runs(batches, [*KEY, "grp"]):
            total = UNIT
            for r in rows:
                total = _then(total, np.array(r["m"]).reshape(4, 4))
            yield conv, none, grp, total.ravel().tolist()

    yield from _emit(made(), BLOCKS)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of blocks of whole conversations, sorted, to their entry and exit states."""
    def made() -> Iterator[tuple]:
        for (conv, none), rows in _runs(batches, KEY):
            matrices = [np.array(r["m"]).reshape(4, 4) for r in rows]
            total = UNIT
            for m in matrices:
                total = _then(total, m)
            states = [0, *through(matrices, 0, int((total[0] + ENDING).argmin()))]
            for i, r in enumerate(rows):
                yield conv, none, r["blk"], states[i], states[i + 1], i == len(rows) - 1

    yield from _emit(made(), PATHS)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the states of their group to their own states."""
    def made() -> Iterator[tuple]:
        for (conv, none, _), rows in _runs(batches, [*KEY, "grp"]):
            states = [rows[0]["entry"], *through([np.array(r["m"]).reshape(4, 4) for r in rows], rows[0]["entry"], rows[0]["exit"])]
            for i, r in enumerate(rows):
                yield conv, none, r["blk"], states[i], states[i + 1], r["last"] and i == len(rows) - 1

    yield from _emit(made(), PATHS)


def _render(role: str, text: str, first: bool) -> str:
    return f"{'' if first else '<|end|>\n'}<|{role}|>\n{text}"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns with the states of their block to the pieces of the repaired conversation."""
    def made() -> Iterator[tuple]:
        for (conv, none, blk), rows in _runs(batches, [*KEY, "blk"]):
            state = rows[0]["entry"]
            states = through([COSTS[r["role"]] for r in rows], state, rows[0]["exit"])
            for at, (r, after) in enumerate(zip(rows, states)):
                _, way, given, action = CHOICES[r["role"]][state, after]
                text = (r["text"] or "").replace("<|", "< |")
                pieces = [(role, "insert", INSERT, _render(role, "", state == 0 and not i)) for i, role in enumerate(way)]
                price = RELABEL * (given != r["role"]) + MERGE * (action == "merge")
                said = "\n" + text if action == "merge" else _render(given, text, state == 0 and not way)
                pieces.append((given, action, price, said))
                state = after
                if r["last"] and at == len(rows) - 1:
                    pieces += [(role, "insert", INSERT, _render(role, "", False)) for role in INSERTIONS[state, LAST]]
                    role, what, price, said = pieces[-1]
                    pieces[-1] = (role, what, price, said + "<|end|>\n")
                for step, (role, what, price, said) in enumerate(pieces):
                    yield conv, none, blk, at, step, r["turn"], role, what, price, said

    yield from _emit(made(), PIECES)


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pieces of every repaired conversation: (conv_id, block, at, step, turn, role, action, cost, rendered).

    In the order of block, at, step the `rendered` of a conversation make its
    text; `turn` is the input turn a piece comes from or stands at. A merged piece
    goes on in the turn before it. "<|" in a text becomes "< |".

    Roles are read without case or outer blanks; NULL and other roles must be
    relabelled. NULL texts are empty. Turns go by number, NULL last, ties by role
    and text; repeated rows are turns of their own. Rows without a conv_id are one
    conversation. Turns of one number share a block. Other columns are not read;
    an empty table gives no rows.
    """
    role = F.lower(F.trim("role"))
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none"),
        F.col("turn").cast("bigint").alias("turn"), F.when(role.isin(*ROLES), role).alias("role"), "text",
        F.coalesce(F.floor(F.col("turn").cast("bigint") / block), F.lit((1 << 63) - 1)).cast("bigint").alias("blk"))
    order = [*KEY, "blk", F.col("turn").asc_nulls_last(), "role", "text"]
    sorted_ = turns.repartition(*KEY, "blk").sortWithinPartitions(*order)
    blocks = stored(sorted_.select(*KEY, "blk", "role").mapInArrow(_matrices, _ddl(BLOCKS))
                    .withColumn("grp", F.floor(F.col("blk") / block)))
    groups = blocks.repartition(*KEY, "grp").sortWithinPartitions(*KEY, "grp", "blk").mapInArrow(_grouped, _ddl(BLOCKS))
    tops = groups.repartition(*KEY).sortWithinPartitions(*KEY, "blk").mapInArrow(_tops, _ddl(PATHS)).withColumnRenamed("blk", "grp")
    inner = blocks.join(tops, [*KEY, "grp"]).repartition(*KEY, "grp").sortWithinPartitions(*KEY, "grp", "blk")
    paths = inner.mapInArrow(_inner, _ddl(PATHS))
    placed = turns.join(paths, [*KEY, "blk"]).repartition(*KEY, "blk").sortWithinPartitions(*order)
    pieces = placed.select(*KEY, "blk", "turn", "role", "text", "entry", "exit", "last").mapInArrow(_repaired, _ddl(PIECES))
    return pieces.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "block", "at", "step", "turn", "role", "action", "cost", "rendered")
