import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from paperloom.llm import turnrepair
from paperloom.llm.common import read

SCHEMA = "text string, conv_id bigint, fault string, turn bigint, role string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(turns):
    """Least (cost, audit, repaired lines) of one conversation, by whole strings over the role initials said so far."""
    after = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        for _ in range(3):
            for q, (cost, audit, lines) in list(ways.items()):
                for said in after[q]:
                    if said != "s":
                        way = (cost + 2, audit + "I", (*lines, names[said] + ":"))
                        ways[said] = min(ways.get(said, way), way)
        return ways

    ways = inserted({"": (0, "", ())})
    for role, text, fault in turns:
        new = {}
        for q, (cost, audit, lines) in ways.items():
            steps = [(q, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                price = fault == "truncated"
                for said in after[q]:
                    if said == role[:1]:
                        steps.append((said, (cost + price, audit + "K", (*lines, f"{role}:{text}"))))
                    if said != "s":
                        steps.append((said, (cost + price + 2, audit + "R", (*lines, f"{names[said]}:{text}"))))
            for to, way in steps:
                new[to] = min(new.get(to, way), way)
        ways = inserted(new)
    return min(w for q, w in ways.items() if q in ("", "a"))


def expected(rows):
    convs = defaultdict(list)
    for text, conv, _, turn, role in rows:
        said = " " if turn is None else turn
        does = zlib.crc32(f"{' ' if conv is None else conv}:{said}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        convs[conv]
        if does:
            text = "" if does == 1 else re.sub("[.!?]", "", text) if does == 2 else text
            convs[conv] += [(turn, "user" if does == 4 else role, text)] * (2 if does == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        seen, marked, counts = set(), [], defaultdict(int)
        for _, role, text in turns:
            words = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        cost, audit, lines = cheapest(marked)
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def sample(rng):
    rows = []
    for c in range(150):
        n = rng.choice([1, 2, 3, 5, 9]) if c else 60
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "agent"])
            text = rng.choice(["Well.", "Well", "", None, "a b? ", "é!\t", ".", f"no {t}", f"yes {t}!"])
            rows.append((text, c, "clash", None if t == 0 and c % 3 == 0 else 2 * t + (t > 3), role))
    # Without roles nothing anchors a repair, and guessed vectors may stay wrong through all chunks.
    rows += [(f"t{t}.", 500, None, t, None) for t in range(75)]
    rows += [("", 501, None, t, "user") for t in range(40)]
    rows += [("Same.", 502, None, t, "user") for t in range(40)]
    rows += [("Hi.", None, None, t, "user") for t in range(5)]
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_repairs_agree_with_whole_strings(spark, chunk):
    rows = sample(random.Random(5))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(turnrepair.repair_damaged(df, chunk)) == expected(rows)


def test_empty_table(spark):
    assert found(turnrepair.repair_damaged(spark.createDataFrame([], SCHEMA))) == []


def test_given_table(spark):
    df = read(spark, "/root/testdata/sf0.01", "conversations")
    rows = [(r.text, r.conv_id, None, r.turn, r.role) for r in df.collect()]
    assert found(turnrepair.repair_damaged(df)) == expected(rows)


def test_few_vectors_and_stops_where_runs_agree():
    assert len(turnrepair.VECTORS) < 256
    symbols = "".join(random.Random(1).choices(turnrepair.SYMBOLS, k=500))
    for after in range(len(turnrepair.VECTORS)):
        whole = turnrepair.walk(symbols, after)
        assert turnrepair.walk(symbols, after, turnrepair.walk(symbols, 0)) == whole
