import heapq
import random

import pytest

from paperloom.llm import chat
from paperloom.llm.common import read

TURNS = "conv_id bigint, turn bigint, role string, text string, action string, step int"


def cheapest(roles):
    """Least cost by search over (turns read, last role), without the module's tables."""
    queue, done = [(0, 0, "start")], set()
    while queue:
        cost, i, last = heapq.heappop(queue)
        if i == len(roles) and last == "assistant":
            return cost
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in chat.ROLES:
            legal = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[last]
            if role in legal:
                heapq.heappush(queue, (cost + 2, i, role))
                if i < len(roles):
                    heapq.heappush(queue, (cost + 3 * (role != roles[i]), i + 1, role))
            if i < len(roles) and role == last:
                heapq.heappush(queue, (cost + 1 + 3 * (role != roles[i]), i + 1, role))


def check(pieces, roles, texts):
    """Pieces of one conversation in order: legal, complete, of the least cost."""
    said, last = [], "start"
    for p in pieces:
        if p.action == "merge":
            assert p.role == last
        else:
            assert (last, p.role) in chat.LEGAL
        last = p.role
        if p.action != "insert":
            i = len(said)
            assert (p.action == "relabel") == (p.role != roles[i]) or p.action == "merge"
            said.append(i)
    assert last == "assistant" and len(said) == len(roles)
    assert sum(p.cost for p in pieces) == cheapest(roles)
    whole = "".join(p.rendered for p in pieces)
    turns = whole.split("<|end|>\n")
    assert turns.pop() == ""
    heads = [t.split("\n", 1)[0] for t in turns]
    assert heads == [f"<|{p.role}|>" for p in pieces if p.action != "merge"]
    assert "\n".join(t.split("\n", 1)[1] for t in turns).replace("\n", "") == "".join(texts).replace("\n", "")


@pytest.mark.parametrize("block", [3, 4096])
def test_repairs_are_legal_and_cheapest(spark, block):
    rng = random.Random(block)
    convs = {}
    for c in range(120):
        n = rng.choice([1, 2, 3, 8, 20]) if c else 300
        convs[c] = [(rng.choice([*chat.ROLES, "user", "assistant", "tool", None]), f"t{c}.{i} <|x|>" if i % 3 else "") for i in range(n)]
    rows = [(c, i, f" {r.upper()} " if r and i % 2 else r, t, "clash", 1) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    out = chat.repair(spark.createDataFrame(rows, TURNS), block).orderBy("conv_id", "block", "at", "step")
    assert out.columns == ["conv_id", "block", "at", "step", "turn", "role", "action", "cost", "rendered"]
    pieces = {}
    for p in out.collect():
        pieces.setdefault(p.conv_id, []).append(p)
    assert set(pieces) == set(convs)
    for c, turns in convs.items():
        check(pieces[c], [r if r in chat.ROLES else None for r, _ in turns], [t.replace("<|", "< |") for _, t in turns])


def test_long_conversation_in_groups_of_blocks(spark):
    rng = random.Random(1)
    roles = [rng.choice(chat.ROLES) for _ in range(3000)]
    df = spark.createDataFrame([(None, i * 7 - 900, r, None, "x", 1) for i, r in enumerate(roles)], TURNS)
    pieces = chat.repair(df, 16).orderBy("block", "at", "step").collect()
    check(pieces, roles, [])
    assert {p.conv_id for p in pieces} == {None}


def test_nulls_ties_and_no_rows(spark):
    rows = [(1, None, "user", "late", "x", 1), (1, 2, "assistant", "b", "x", 1), (1, 2, "assistant", "a", "x", 1), (1, 1, "user", "first", "x", 1),
            (None, 0, None, None, "x", 1), (0, 0, "assistant", "x" * 200000, "x", 1), (0, 0, "assistant", "x" * 200000, "x", 1)]
    df = spark.createDataFrame(rows, TURNS)
    out = chat.repair(df).orderBy("conv_id", "block", "at", "step").collect()
    text = {c: "".join(p.rendered for p in out if p.conv_id == c) for c in (None, 0, 1)}
    assert text[1] == "<|user|>\nfirst<|end|>\n<|assistant|>\na\nb<|end|>\n<|user|>\nlate<|end|>\n<|assistant|>\n<|end|>\n"
    assert text[None] == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert text[0].count("x") == 400000 and sum(p.cost for p in out if p.conv_id == 0) == 3
    assert chat.repair(df.limit(0)).collect() == []


def test_whole_table(spark):
    rows = read(spark, "/root/testdata/sf0.01", "conversations")
    out = chat.repair(rows)
    assert out.filter("action != 'insert'").count() == rows.count()
