"""Words gathered by id: one packed move of each text, and the same rows as from words found row by row, also for ids that repeat or are NULL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import classify as cl
from paperloom.operators import labels as lb
from paperloom.operators.taxonomy import TOPICS, derived_keywords, taxonomy, title_phrases
from paperloom.plans import packed
from paperloom.streaming.incremental import tag_each_question_once

PARTS = ["demand", "supply", "inflation", "monopolys ", "oligopoly", "price", "calculate", "growth", "market failure", "trade", "costs", "(x-m)", "taxing",
         "revenue", "unemployment", " ", " ", ",", "xx", "jobless", "cost of living", "industry competition"]


def moves(df):
    return re.findall(r"Exchange (\w+)\(", df._jdf.queryExecution().executedPlan().toString())


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def copies(spark):
    """Texts of which some ids come again, with the same text or another, some ids and texts are NULL, and some say nothing."""
    rng = random.Random(5)
    made = [(f"q{rng.randrange(60):02}" if i % 23 else None, " ".join(rng.choices(PARTS, k=rng.randrange(0, 9))) if i % 17 else None) for i in range(150)]
    return spark.createDataFrame(made + made[:15], "id string, text string")


@pytest.fixture(scope="module")
def dictionary(spark):
    topics = taxonomy(spark)
    listed = derived_keywords(topics).union(spark.createDataFrame([("1.2.2 Demand", " Demand"), ("2.1.2 Inflation", "price level")], "topic string, keyword string"))
    concepts = spark.createDataFrame([("growth", "2.1.1 Economic growth"), ("x-m", "2.2.5 Net trade (X-M)"), ("trade", "nowhere"), ("(x-m)", "2.2.5 Net trade (X-M)")],
                                     "concept string, topic string")
    return topics, listed, concepts


@pytest.mark.parametrize("pack, keys", [(1 << 25, 1 << 13), (200, 3)])
def test_all_rows_of_a_key_are_gathered(spark, monkeypatch, pack, keys):
    monkeypatch.setattr(packed, "PACK", pack)
    monkeypatch.setattr(packed, "KEYS", keys)
    made = [(None if i % 13 == 0 else i * i % 40, f"text {i}" if i % 7 else None, [i, None] if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(made, "id long, text string, more array<int>").repartition(5)
    expected = {}
    for i, text, more in made:
        expected.setdefault(i, []).append((text, more))
    alone = sorted(map(repr, expected.pop(None)))
    for tasks in (1, 4, 300):
        got = packed.gathered(df, "id", tasks).collect()
        assert sorted(repr(tuple(r.rows[0])) for r in got if r.id is None) == alone and all(len(r.rows) == 1 for r in got if r.id is None)
        found = {r.id: sorted(map(repr, map(tuple, r.rows))) for r in got if r.id is not None}
        assert found == {i: sorted(map(repr, v)) for i, v in expected.items()} and len(got) == len(expected) + len(alone)
    assert packed.gathered(df.filter("false"), "id", 4).collect() == []


def test_mentions_move_each_text_once(spark, copies, dictionary):
    got = cl.direct_mention_bonus(copies, dictionary[0])
    assert len(moves(got)) == 1
    phrases = title_phrases(dictionary[0]).select(F.col("phrase").alias("word"))
    want = rows(cl.direct_mention_bonus(copies, dictionary[0], cl.find_words(copies, phrases)))
    assert rows(got) == want and want


def test_scores_move_each_text_once(spark, copies, dictionary):
    _, listed, _ = dictionary
    flags = copies.select("id", cl.is_computational(F.col("text")).alias("computational"))
    found = cl.gather_words(copies, cl.keyword_words(listed), listed)
    got = cl.score_keywords(cl.match_keywords(copies, listed, found), listed, flags)
    assert len(moves(got)) == 1
    want = rows(cl.score_keywords(cl.match_keywords(copies, listed), listed, flags))
    assert rows(got) == want and want


def test_top_topics_move_each_text_once(spark, copies, dictionary):
    _, listed, concepts = dictionary
    got = cl.top_topics_by_keywords(copies, listed, concepts)
    assert len(moves(got)) == 1
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and not re.search(r"(contains|instr|locate|RLIKE)[^,]*text[^,]*, *(concat\()?[^,]*word#", text, re.I)
    words = cl.tagging_words(listed.select("topic").distinct(), listed, concepts)
    want = rows(cl.top_topics_by_keywords(copies, listed, concepts, cl.find_words(copies, words)))
    assert rows(got) == want and want


@pytest.fixture(scope="module")
def asked(spark, copies):
    """Candidates for each text, some of them no topics, some NULL."""
    names = F.array(*[F.lit(t) for t in TOPICS], F.lit("nowhere"), F.lit(None).cast("string"))
    spots = [F.pmod(F.xxhash64("id", "text", F.lit(k)), F.lit(30 if k else 89)).cast("int") for k in range(4)]
    return copies.filter("id is not null").select("id", "text", F.array_distinct(F.array(*[F.get(names, s) for s in spots])).alias("candidates"))


def by_rows(asked):
    text = F.col("text")
    return asked.select("id", "text", cl.is_computational(text).alias("computational"), lb.estimate_marks(text).alias("est_marks"),
                        F.posexplode("candidates").alias("pos", "topic"))


def test_relevance_moves_each_text_once(copies, dictionary, asked):
    topics, listed, _ = dictionary
    got = lb.score_relevance(lb.gather_pairs(asked), topics, listed).by_pair()
    assert len(moves(got)) == 1
    want = lb.score_relevance(by_rows(asked), topics, listed, asked.select("id", "text")).select(*got.columns)
    assert rows(got) == rows(want) and got.count() > 100


def test_selection_moves_each_text_once(dictionary, asked):
    """An id's copies may differ in marks, of which any may count: one copy of each is looked at."""
    topics, listed, _ = dictionary
    once = asked.dropDuplicates(["id"]).localCheckpoint()
    got = lb.select_topics(lb.score_relevance(lb.quality_filter(lb.gather_pairs(once)), topics, listed))
    assert len(moves(got)) == 1
    want = lb.select_topics(lb.score_relevance(lb.quality_filter(by_rows(once)), topics, listed, once.select("id", "text")))
    assert rows(got) == rows(want) and got.count() > 20


@pytest.mark.parametrize("parity", [False, True])
def test_cascade_moves_each_text_once(spark, monkeypatch, copies, dictionary, parity):
    """One packed move of texts and labels, none of words or places, and what joins by id give, also for NULL ids and repeated ones."""
    topics, listed, concepts = dictionary
    moved = []
    real = lb.stored_table
    monkeypatch.setattr(lb, "stored_table", lambda df: moved.append(moves(df)) or real(df))
    questions = copies.select(F.col("id").alias("question_id"), F.col("text").alias("question_text"), F.lit(None).cast("array<string>").alias("topics"))
    rng = random.Random(8)
    labels = [*TOPICS[:40], "junk", "Topic: 1.2.2 Demand", "'inflation'", None]
    offered = spark.createDataFrame([(f"q{i:02}" if i < 70 else None, rng.choices(labels, k=rng.randrange(0, 5)) if i % 9 else None) for i in range(0, 75, 2)]
                                    + [("q04", ["2.1.2 Inflation", "1.2.2 Demand"])], "question_id string, labels array<string>")
    got = lb.assign_topics(questions, topics, listed, concepts, offered, parity)
    assert moved == [["shufflepartitionidpassthrough"]]
    monkeypatch.setattr(lb, "fits_broadcast", lambda words: False)
    want = lb.assign_topics(questions, topics, listed, concepts, offered, parity)
    assert rows(got) == rows(want) and {r.method for r in got.collect()} >= {"suggested", "fallback"}


def test_a_compressed_bank_is_tagged_once(spark, tmp_path):
    """Files of either kind are read, and a question that comes again, in a file of the other kind, is not tagged again."""
    bank = spark.createDataFrame([("1", "2020", "EDEXCEL", f"Explain {w} here", "alevel", f"f{i}.pdf") for i, w in enumerate(["inflation", "monopoly", "nothing"])],
                                 "questionNumber string, year string, board string, questionText string, qualification string, questionFile string")
    topics = taxonomy(spark)
    offered = spark.createDataFrame([], "question_id string, labels array<string>")
    concepts = spark.createDataFrame([("steel", "1.2.4 Supply")], "concept string, topic string")
    for kind, part in (("gzip", bank.filter("questionFile <> 'f2.pdf'")), ("none", bank)):
        part.write.mode("append").option("compression", kind).json(f"{tmp_path}/bank")
        tag_each_question_once(spark, f"{tmp_path}/bank", f"{tmp_path}/tags", f"{tmp_path}/seen", topics, derived_keywords(topics), concepts, offered).awaitTermination()
        epochs = spark.read.schema("question_file string, topics array<string>, method string").parquet(f"{tmp_path}/tags/epoch=*")
        got = {r.question_file: (r.topics[0], r.method) for r in epochs.collect()}
        assert len(got) == epochs.count() == part.count()
    assert got == {"f0.pdf": ("2.1.2 Inflation", "keywords"), "f1.pdf": ("3.4.5 Monopoly", "keywords"), "f2.pdf": ("1.2.2 Demand", "fallback")}


def test_columns_come_along(spark, monkeypatch):
    """A question's file comes back with its topics, from whatever step, without a join; and by a join where the cascade takes joins."""
    topics = taxonomy(spark)
    asked = spark.createDataFrame([("a", "Explain supply", "fa"), ("b", "Explain inflation", "fb"), ("c", "nothing", None)], "question_id string, question_text string, file string")
    questions = asked.withColumn("topics", F.lit(None).cast("array<string>"))
    offered = spark.createDataFrame([("a", ["1.2.4 Supply"])], "question_id string, labels array<string>")
    concepts = spark.createDataFrame([("steel", "1.2.4 Supply")], "concept string, topic string")
    for fits in (None, False):
        if fits is not None:
            monkeypatch.setattr(lb, "fits_broadcast", lambda words: False)
        got = lb.assign_topics(questions, topics, derived_keywords(topics), concepts, offered, carried=("file",))
        assert {(r.question_id, r.method, r.file) for r in got.collect()} == {("a", "suggested", "fa"), ("b", "keywords", "fb"), ("c", "fallback", None)}
        assert fits is False or not moves(got)


@pytest.mark.parametrize("limit, fits", [("1k", True), ("1KB", True), ("0m", False), ("100", False), ("1024b", True), ("-1", False)])
def test_broadcast_limits_with_units(spark, limit, fits):
    words = spark.createDataFrame([("demand",), ("supply",)], "word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        assert cl.fits_broadcast(words) is fits
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
