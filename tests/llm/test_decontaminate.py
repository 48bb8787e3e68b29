import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import decontaminate as dc

DOCS = "doc_id bigint, text string, item string, score string"
ITEMS = "item_id bigint, text string, lang string"


def plain_align(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=14), st.lists(st.integers(0, 4), max_size=30))
def test_align_matches_the_full_table(a, b):
    score, start, end = dc.align(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == plain_align(a, b) / (2 * len(a))
    assert 0 <= start <= end <= len(b)
    assert plain_align(a, b[start:end]) == plain_align(a, b)


def made():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)] + ["the", "of", "and"] * 400
    items = [(i, " ".join(rng.choices(words, k=rng.randint(13, 45))), "en") for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 300))), "x", "y") for i in range(500)]
    planted = {}
    for i in range(0, 300, 3):
        item = rng.choice(items)
        passage = item[1].split()
        kind = i % 5
        if kind in (1, 2):  # a tenth of the words changed
            for k in rng.sample(range(len(passage)), len(passage) // 10):
                passage[k] = "changed"
        if kind == 3:  # a word dropped, one inserted
            del passage[rng.randrange(len(passage))]
            passage.insert(rng.randrange(len(passage)), "inserted")
        text = docs[i][1].split()
        at = rng.randint(0, len(text))
        docs[i] = (i, " ".join(text[:at]) + " " + ", ".join(passage).upper() + "! " + " ".join(text[at:]), "x", "y")
        planted[i, item[0]] = kind
    return docs, items, planted


def test_planted_passages_and_brute_force(spark):
    docs, items, planted = made()
    docs += [(600, None, "x", "y"), (601, "", "x", "y"), (None, items[0][1], None, "y"), docs[3], (602, "the of and " * 20000 + items[5][1], "x", "y")]
    found = dc.benchmark_leaks(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame([*items, items[0], (90, None, "x"), (91, "two words", "x")], ITEMS))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert found.columns == ["doc_id", "item_id", "score", "n_words", "start_char", "end_char"]
    codes = dc._Codes()
    coded = {i: dc.coded(dc.WORDS.findall(t.lower()), codes) for i, t, _ in items}
    expected = {}
    for doc_id, text, *_ in docs:
        words = dc.coded(dc.WORDS.findall((text or "").lower()), codes)
        for i, item in coded.items():
            if (score := dc.align(item, words)[0]) >= 0.5:
                expected[doc_id, i] = score
    assert {k: r.score for k, r in got.items()} == expected
    assert set(planted) <= set(expected) and (None, 0) in expected and (602, 5) in expected
    assert len(expected) <= len(planted) + 3
    for (i, j), kind in planted.items():
        if kind in (0, 4):
            assert got[i, j].score == 1
            passage = docs[i][1].lower()[got[i, j].start_char:got[i, j].end_char]
            assert dc.WORDS.findall(passage) == items[j][1].split()
    df = spark.createDataFrame(docs, DOCS)
    kept = dc.without_leaks(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d[0] for d in docs if d[0] is None or all(k[0] != d[0] for k in expected)), key=str)


def test_passage_in_a_third_of_all_texts(spark):
    docs, items, _ = made()
    docs = [(i, t + " " + items[7][1] if i % 3 == 0 else t, x, y) for i, t, x, y in docs]
    found = dc.benchmark_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert {r.doc_id for r in found.filter("item_id = 7").collect()} >= set(range(0, 500, 3))


def test_empty_tables(spark):
    docs, items, _ = made()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert dc.benchmark_leaks(d.limit(0), b).collect() == []
    assert dc.benchmark_leaks(d, b.limit(0)).collect() == []
    assert dc.without_leaks(d, b.limit(0)).count() == 500


def test_edited_copies_beside_exact_ones(spark):
    """However often an item is in the corpus, each text that aligns at 0.5 or more is reported, also one without three words in a row."""
    item = [f"w{i}" for i in range(60)]
    short = "one two three four five six".split()
    fourth = " ".join("x" if i % 4 == 3 else w for i, w in enumerate(item))
    third = "w0 " + " ".join("x" if i % 3 == 2 and i < 58 else w for i, w in enumerate(item))
    apart = " x ".join(item)
    texts = [" ".join(item), fourth, third, apart, "a one x two three x four b", " ".join(w for i, w in enumerate(item) if i % 3), " ".join(item[:30]), " ".join(item[:29])]
    texts += [" ".join(short)] * 5 + [fourth] * 40 + [" ".join(item)] * 40
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    items = [(1, " ".join(item), "en"), (2, " ".join(short), "en")]
    codes = dc._Codes()
    expected = {}
    for j, t, _ in items:
        for i, text in enumerate(texts):
            if (score := dc.align(dc.coded(t.split(), codes), dc.coded(text.split(), codes))[0]) >= 0.5:
                expected[i, j] = score
    assert {(i, 1) for i in (0, 1, 2, 3, 5, 6)} <= set(expected) and (7, 1) not in expected
    got = {(r.doc_id, r.item_id): r.score for r in dc.benchmark_leaks(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == expected
