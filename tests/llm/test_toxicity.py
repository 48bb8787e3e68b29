import random
import zlib

import pytest

from paperloom.llm import toxicity
from paperloom.llm.common import read

DOCS = "doc_id bigint, text string, score string"
BAD = ["moron", "scumbag", "pathetic"]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    syllables = ["the", "an", "or", "in", "st", "on", "ta", "le", "ri", "so", "ma"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(400)]
    docs, labels = [], []
    for i in range(800):
        text = rng.choices(words, k=rng.randint(5, 60))
        if toxic := i % 6 == 0:
            text[rng.randrange(len(text))] = rng.choice(BAD)
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 0, int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_scores_and_disguises(spark, made):
    docs, labels = made
    hidden = [(1000, "the an m0r0n or in", "x"), (1001, "the an m o r o n or in", "x"), (1002, "the an moooorooon in st", "x"),
              (1003, "such p@th3tic st", None), (1004, None, "x"), (1005, "", "x"), (1006, " \n", "x"), (None, "the scumbag", "x"),
              (1007, "the an or in " * 20000, "x"), (1007, "the an or in " * 20000, "x"), (1008, "4 5 6 0 1 call 555-1234 !!! $$$", "x")]
    more = docs.unionByName(spark.createDataFrame(hidden, DOCS))
    out = toxicity.score_texts(more, more, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 811
    for i in range(800):
        assert got[i].predicted == int(i % 6 == 0), i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, None)] == [1] * 5
    assert [got[i].predicted for i in (1004, 1005, 1006, 1007, 1008)] == [0] * 5
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.clean_only(more, more, labels)
    assert kept.columns == more.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out.filter("predicted = 0").collect())


def test_held_out_labels_teach_nothing(spark, made):
    docs, labels = made
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    rows = [sorted(map(tuple, toxicity.score_texts(docs, docs, x).collect())) for x in (labels, flipped)]
    assert rows[0] == rows[1]


def test_empty_tables_and_no_toxic_label(spark, made):
    docs, labels = made
    assert toxicity.score_texts(docs.limit(0), docs.limit(0), labels.limit(0)).collect() == []
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_texts(docs, docs, nulls).collect()} <= {0, 1}
    assert {r.predicted for r in toxicity.score_texts(docs, docs, labels.filter("toxic = 0")).collect()} == {0}


def test_held_out_accuracy(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    judged = toxicity.score_texts(docs, docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in judged if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in judged if not r.toxic) <= 0.05 * (len(judged) - len(toxic))


def test_mixed_disguises(spark, made):
    docs, _ = made
    more = spark.createDataFrame([(2000 + i, "stupid idiot ass loss assassin a balloon", "x") for i in range(200)], DOCS)
    restorer = toxicity.Restorer(toxicity.character_counts(docs.unionByName(more)))
    spelt = {"stupid": ["s t u p 1 d", "5 t u p i d", "s  t  u  p  i  d", "s/t/u/p/i/d", "s. t. u. p. 1. d", "stuupiid", '"$tupid"', "($tup1d)", "s.t.u.p.i.d"],
             "idiot": ["i d 1 o t", "1 d 1 o t", "i.d.1.o.t", "iddiot", "!diot", "1d10t"], "ass": ["a$$", "@$$", "a$$!"], "loss": ["lo$$"]}
    for word, ways in spelt.items():
        for way in ways:
            assert word in toxicity.WORDS.findall(restorer.restore(f"the {way} moron")), way
    for clean in ("balloon", "loss", "idiot!", "1 2 3 4", "the balloon assassin"):
        assert toxicity.WORDS.findall(restorer.restore(clean)) == toxicity.WORDS.findall(clean), clean
    letters = toxicity.Restorer(toxicity.character_counts(more.selectExpr("'i hate the late hate' as text")))
    assert toxicity.WORDS.findall(letters.restore("i h8 the")) == ["i", "hate", "the"]
