import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import ngramlm as lm
from paperloom.llm.common import read
from paperloom.llm.eliasfano import Levels

DOCS = "doc_id bigint, text string, score int, key string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 64 - 1)), max_size=200), st.lists(st.integers(0, 2 ** 64 - 1), max_size=20))
def test_sequence_is_exact(values, others):
    values = np.sort(np.array(values, np.uint64))
    levels = Levels()
    made, odd = levels.add_sequence(values), levels.add(np.array([1, 2, 3], np.uint16))
    levels.close()
    sequence = levels.sequence(made)
    assert levels.array(odd).tolist() == [1, 2, 3]
    assert (sequence.get(np.arange(len(values))) == values).all()
    sought = np.unique(np.concatenate([np.array([*others, 0, 5, 2 ** 64 - 1], np.uint64), values]))
    assert sequence.successor(sought).tolist() == np.searchsorted(values, sought).tolist()
    n = len(values)
    first, end = np.full(len(sought), n // 3), np.full(len(sought), max(n // 3, n - 2))
    expected = np.clip(np.searchsorted(values, sought), first, end)
    assert sequence.successor(sought, first, end).tolist() == expected.tolist()


def brute(docs):
    """Per row: the contract's figures, and the model's score from plain dictionaries."""
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    codes = lm._Codes()
    group = lambda w: int((lm.START if w is None else codes[w]) & (lm.CLASSES - 1))
    words, pairs, groups = Counter(), Counter(), Counter()
    for i, t in docs:
        if not held(i):
            w = split(t)
            words.update(w)
            for a, b in zip([None, *w], w):
                pairs[group(a), b] += 1
                groups[group(a)] += 1
    n, v = sum(words.values()), len(words)
    unknown = min(0.5, max(sum(c == 1 for c in words.values()), 0.1) / n) if n else 1.0

    def back(c):
        if not c:
            return 1.0
        m = 2 ** (round(math.log2(c) * lm.OCTAVE) / lm.OCTAVE)
        by = {}
        for x in words.values():
            by.setdefault(round(math.log2(x) * lm.OCTAVE), []).append(x)
        kinds = sum(len(xs) * (1 - (1 - min(sum(xs) / len(xs) / n, 0.999999)) ** m) for xs in by.values())
        return min(1 - lm.MOST_HISTORY, kinds / m)

    backs = {c: back(c) for c in {0, *groups.values()}}

    def p(a, w):
        g = group(a)
        low = unknown if not words[w] else (1 - unknown) * words[w] / n
        return (1 - backs[groups[g]]) * pairs[g, w] / max(groups[g], 1) + backs[groups[g]] * low

    out = []
    for i, t in docs:
        w = split(t)
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, held(i), len(w), sum(words[x] > 0 for x in w), n, base, sum(math.log10(p(a, x)) for a, x in zip([None, *w], w))))
    return out, p, words


def made():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "of", "É"] * 60
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for i in range(300)]
    docs += [(400 + i, docs[i][1] + " tail") for i in range(60)]
    return docs + [(700, None), (701, ""), (702, " \t\n\x0b"), (None, "of the w1"), (703, "w1 w2 " * 30000), docs[5], docs[5], (704, "never seen   x")]


@pytest.mark.parametrize("shard", [16 << 20, 4000])
def test_scores_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD", shard)
    monkeypatch.setattr(lm, "HELD", 5000)
    monkeypatch.setattr(lm, "HOT", 300)
    docs = made()
    expected, p, words = brute(docs)
    out = lm.score_texts(spark.createDataFrame([(*d, 1, "k") for d in docs], DOCS).repartition(5))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got, key = [tuple(r) for r in out.collect()], lambda r: (str(r[0]), r[2])
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and abs(a[6] - b[6]) <= 3e-4 * a[2]
    for history in (None, b"w1", b"of", b"the", b"not there"):
        assert math.isclose(sum(p(history, w) for w in [*words, "unknown"]), 1, rel_tol=1e-9)


def test_empty_tables_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(*d, 1, "k") for d in made()], DOCS)
    assert lm.score_texts(df.limit(0)).collect() == []
    rows = lm.score_texts(df.filter("crc32(cast(doc_id as string)) % 10 = 0")).collect()
    assert rows and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in rows)


def test_better_than_the_base_on_held_out_texts(spark):
    rows = lm.score_texts(read(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) >= 0.9 * len(rows)
