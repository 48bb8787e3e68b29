import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from paperloom.llm import prefixtrie
from paperloom.llm.common import read

SCHEMA = "text string, conv_id bigint, turn bigint, depth string, role string"


def expected(rows, rebuild):
    """Nodes by plain dictionaries, as (conv_id, depth) to the other columns."""
    convs = defaultdict(list)
    for text, conv, turn, _, role in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        kids[node[:-1]] += bool(node)
    for node, ms in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(ms) - 1) * words
    out = {}
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(ms), len(node)] = (parent, len(ms), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def sample(rng):
    rows = []
    for c in rng.sample(range(-60, 400), 260):
        n = rng.choice([0, 1, 1, 2, 3, 4, 6]) if c != 7 else 90
        hot = rng.random() < 0.4
        for t in range(n):
            text = ["", None, "a b", "one\ttwo  three", "é x"][t % 5] if hot or t < 2 and rng.random() < 0.7 else f"w {rng.randrange(6)}"
            rows.append((text, c, None if t == 0 and rng.random() < 0.3 else t, "clash", rng.choice(["user", "user", None]) if not hot else "user"))
    rows += [("lost", None, 1, "x", "user"), (None, 399, None, None, None)]
    return rows


@pytest.mark.parametrize("rebuild,sizes", [(True, {}), (True, {"band": 2, "heavy": 5, "shard_rows": 50}), (False, {"band": 4, "heavy": 20, "shard_rows": 20}), (False, {"band": 3, "heavy": 1, "shard_rows": 9})])
def test_nodes_agree_with_dictionaries(spark, rebuild, sizes):
    rows = sample(random.Random(len(sizes)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    make = prefixtrie.rebuilt_trie if rebuild else prefixtrie.conversation_trie
    assert found(make(df, **sizes)) == expected(rows, rebuild)


def test_one_long_conversation_and_many_copies(spark):
    rows = [(f"t{t % 3}", 0, t, None, "user") for t in range(700)] + [(f"t{t % 3}", c, t, None, "user") for c in range(1, 80) for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(prefixtrie.conversation_trie(df, band=8, heavy=10, shard_rows=100)) == expected(rows, False)


def test_empty_table_and_turnless(spark):
    assert found(prefixtrie.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == {}
    # crc32("3") % 4 = 1, so the one turn goes, and no conversation 0 lends another.
    rows = [("gone", 3, 0, None, "user")]
    assert zlib.crc32(b"3") % 4 >= 1
    assert found(prefixtrie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows, True)


def test_slot_table_is_minimal_perfect_and_checked():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20000):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in "ab")
        b[: n // 2] = 5  # keys that differ in one half only
        table = prefixtrie.SlotTable(a, b)
        assert sorted(table.slots(a, b)) == list(range(n))
        assert (table.slots(a + np.uint64(1), b) == -1).all()


def test_given_table(spark):
    df = read(spark, "/root/testdata/sf0.001", "conversations")
    rows = [(r.text, r.conv_id, r.turn, None, r.role) for r in df.collect()]
    assert found(prefixtrie.rebuilt_trie(df)) == expected(rows, True)
