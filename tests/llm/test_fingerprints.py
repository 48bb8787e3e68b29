import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import fingerprints as fp

DOCS = "doc_id bigint, text string, blk string, fingerprint int"


def made(n=260):
    rng = random.Random(4)
    words = [f"{c}{i}" for i in range(150) for c in "aé"]
    docs = [(i * 7 - 50, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 9, 30, 80]))), "x", 1) for i in range(n)]
    docs[10] = (docs[10][0], None, "x", 1)
    docs[11] = (docs[11][0], docs[12][1], "x", 1)
    docs[13] = (docs[13][0], "\U0001F600é \t" * 900 + "z" * 3000, "x", 1)
    rng.shuffle(docs)
    return docs


def brute(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    out = {}
    for d, e in zip(order, order[1:] + order[:1]):
        text, following = d[1] or "", e[1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        out[d[0]] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following)
    return out


@pytest.mark.parametrize("block_rows", [16, 100000])
def test_edited_texts_and_likeness(spark, block_rows):
    docs = made()
    expected = brute(docs)
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    rows = fp.edited_fingerprints(df, block_rows=block_rows).collect()
    assert len(rows) == len(docs)
    seen = {}
    for r in rows:
        n, sha, text, edited, following = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        for print_, t in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            assert seen.setdefault(" ".join(sorted(t.split())), print_) == print_
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (sorted(text.split()) == sorted(following.split())) or r.near_next > 0.7
    assert len(set(seen.values())) == len(seen)


def test_collisions_equal_generalised_jaccard(spark):
    rng = random.Random(9)
    pairs = []
    for i in range(400):
        a = Counter(rng.choices(range(i * 100, i * 100 + 60), k=80))
        b = a.copy()
        for w in list(a):
            if rng.random() < 0.4:
                b[w] = rng.randint(0, 6)
        pairs.append((a, +b))
    text = lambda c: " ".join(f"t{w}" for w in c.elements())
    rows = [(i, text(a), text(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    a, b = (fp.with_signatures(df, ["i"], x).withColumnRenamed("fingerprint", x) for x in "ab")
    near = {r.i: r.x for r in a.join(b, "i").select("i", fp.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    true = [sum((a & b).values()) / sum((a | b).values()) for a, b in pairs]
    n = len(true)
    assert abs(sum(near.values()) / n - sum(true) / n) < 0.012
    low = [i for i in range(n) if true[i] < sum(true) / n]
    assert abs(sum(near[i] - true[i] for i in low)) / len(low) < 0.02


def test_nulls_ties_and_few_rows(spark):
    assert fp.edited_fingerprints(spark.createDataFrame([], DOCS)).collect() == []
    one = fp.edited_fingerprints(spark.createDataFrame([(1, "abcd", "x", 1)], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    docs = [(None, "a b c d", "x", 1), (None, None, "x", 1), (3, "q r s t", "x", 1), (3, "q r s t", "x", 1), (4, "", "x", 1)] * 6
    for rows in (4, 1000):
        out = fp.edited_fingerprints(spark.createDataFrame(docs, DOCS), block_rows=rows).collect()
        assert len(out) == len(docs)
        empty = [r for r in out if r.n_chars == 0]
        assert len({r.fingerprint for r in empty}) == 1 and all(r.near_edited == 1 for r in empty)
    assert len(fp.edited_fingerprints(spark.createDataFrame([(None, "a", "x", 1)] * 40, DOCS), block_rows=4).collect()) == 40
