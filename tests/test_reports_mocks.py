"""Reports, bundles and mocks; selections against a row-by-row reading of the rules."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from paperloom.operators import assemble as am
from paperloom.operators import dedupe, stats
from paperloom.plans import scale
from paperloom.schemas import QUESTIONS
from paperloom.sources import bank


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def pool(spark):
    """Group g0 holds most rows; a few groups are tiny."""
    return spark.range(900).selectExpr(
        "if(id < 800, 'g0', concat('g', id % 7)) as g", "concat('q', id) as question_id",
        "concat('question', 3 + id % 4) as question_number", "if(id % 41 = 0, null, cast(1 + id * 7 % 23 as int)) as marks",
        "cast(1 + id * 11 % 70 as int) as minutes", "id % 3 > 0 as is_short")


def grouped(pool):
    out = {}
    for r in pool.collect():
        out.setdefault(r["g"], []).append(r)
    return out


def essay(r):
    return r["question_number"].startswith("question6") or r["marks"] is None or r["marks"] >= 10


def test_first_per_key_and_top(spark, pool):
    firsts = {r["g"]: r["question_id"] for r in scale.first_per_key(pool, ["g"], [F.col("question_id")]).collect()}
    tops = scale.top_per_group(pool.repartition(9), ["g"], [-F.col("minutes"), F.col("question_id")], 5).collect()
    for g, rows in grouped(pool).items():
        assert firsts[g] == min(r["question_id"] for r in rows)
        want = sorted((-r["minutes"], r["question_id"]) for r in rows)[:5]
        assert [(-r["minutes"], r["question_id"]) for r in sorted((x for x in tops if x["g"] == g), key=lambda x: x["rank"])] == want


def test_running_total(spark, pool):
    got = scale.running_total(pool, ["g"], [F.substring("question_id", 1, 2)], [F.col("question_id")], F.col("minutes"), "before").collect()
    for g, rows in grouped(pool).items():
        total = 0
        want = {}
        for r in sorted(rows, key=lambda r: (r["question_id"][:2], r["question_id"])):
            want[r["question_id"]], total = total, total + r["minutes"]
        assert {r["question_id"]: r["before"] for r in got if r["g"] == g} == want


top = am.top_per_group


def test_select_time_budget(pool):
    got = {}
    for r in am.select_time_budget(pool, ["g"], F.lit(60), seed=3, restarts=6).collect():
        got.setdefault(r["g"], []).append((r["seq"], r["question_id"]))
    for g, rows in grouped(pool).items():
        best = None
        for restart in range(6):
            def order(short):
                return sorted((r for r in rows if r["is_short"] == short), key=lambda r: md5(r["question_id"], restart, 3))
            used, picked = 0, []
            for part in (order(True), order(False)):
                for r in part:
                    if used < 45 and used + r["minutes"] <= 75:
                        picked.append(r["question_id"])
                        used += r["minutes"]
            if best is None or abs(used - 60) < best[0]:
                best = (abs(used - 60), picked)
        assert [q for _, q in sorted(got[g])] == best[1]


def test_too_few_drawn_are_drawn_again(pool, monkeypatch):
    """However few rows pass the threshold, the selection stays the same."""
    whole = sorted(map(tuple, am.select_time_budget(pool, ["g"], F.lit(60), seed=3, restarts=6).collect()), key=str)
    for spread, spare in ((-3.0, 0), (-1e9, 0), (1e9, 0)):
        monkeypatch.setattr(am, "SPREAD", spread)
        monkeypatch.setattr(am, "SPARE", spare)
        assert sorted(map(tuple, am.select_time_budget(pool, ["g"], F.lit(60), seed=3, restarts=6).collect()), key=str) == whole


def test_only_drawn_rows_are_ordered(spark, monkeypatch):
    """Of 20,000 questions of one group at most a few hundred a restart reach the sort."""
    seen = []
    monkeypatch.setattr(am, "top_per_group", lambda df, *a, **k: seen.append(df.count()) or top(df, *a, **k))
    rows = spark.range(20000).selectExpr("'g' as g", "cast(id as string) as question_id", "4 as marks", "4 as minutes", "true as is_short")
    picked = am.select_time_budget(rows, ["g"], F.lit(60), seed=2, restarts=4)
    assert len(seen) == 1 and 4 * 45 <= seen[0] < 4 * 200 and picked.agg(F.sum("minutes")).first()[0] in range(45, 76)


def test_single_mock_uses_all_where_none_can_be_selected(spark):
    rows = [("as", f"q{i}", "question3", m, ["1.1.1 A"], f"c{i}") for i, m in enumerate([0, 0, 20])] + [("as", "p", "question3", 5, ["1.1.2 B"], "d")]
    questions = spark.createDataFrame(rows, "qualification string, question_id string, question_number string, marks int, topics array<string>, content_md5 string")
    questions = questions.withColumns({c: F.lit("x") for c in ("board", "year", "paper")})
    extracts = questions.select("board", "qualification", "year", "paper").limit(0)
    got = {(r.topic, r.seq): (r.question_id, r.restart is None, r.minutes) for r in am.single_topic_mock(questions, extracts, 1).collect()}
    assert got[("1.1.2 B", 1)] == ("p", False, 5) and len(got) == 3
    assert {got[("1.1.1 A", i)] for i in (1, 2)} == {("q0", True, 0), ("q1", True, 0)}


def test_skipping_in_order(spark):
    """40 and 40 minutes, then 20: the second does not fit 75 and is passed over."""
    rows = spark.createDataFrame([("g", f"q{i}", 8, m, False) for i, m in enumerate([40, 40, 20])],
                                 "g string, question_id string, marks int, minutes int, is_short boolean")
    used = am.select_time_budget(rows, ["g"], F.lit(60), seed=1, restarts=30).agg(F.sum("minutes")).first()[0]
    assert used == 60


def test_select_balanced(pool):
    got = {}
    for r in am.select_balanced(pool, ["g"], 60, 5).collect():
        got.setdefault(r["g"], []).append((r["seq"], r["question_id"]))
    for g, rows in grouped(pool).items():
        ordered = sorted(rows, key=lambda r: md5(r["question_id"], 5))
        essays, shorts = [r for r in ordered if essay(r)], [r for r in ordered if not essay(r)]
        picked, total = [], 0
        if essays:
            picked, total = [essays[0]["question_id"]], essays[0]["marks"] or 2147483647
        for r in shorts:
            if total < 50:
                picked.append(r["question_id"])
                total += r["marks"]
        assert [q for _, q in sorted(got[g])] == picked


def test_select_ascending(spark):
    rows = spark.createDataFrame([("g", f"q{m}", m) for m in (4, 5, 8, 12)], "g string, question_id string, marks int")
    got = am.select_ascending_to_target(rows, ["g"], 20, 1).orderBy("seq").collect()
    assert [r["marks"] for r in got] == [4, 5, 8]


def test_topic_mocks(pool):
    got = {}
    questions = pool.withColumns({"content_md5": F.col("question_id"), "year": F.lit("2019"), "board": F.lit("aqa")})
    for r in am.topic_mocks(questions, ["g"], 40, 3, 11).collect():
        got.setdefault((r["g"], r["mock"]), set()).add(r["question_id"])
        assert r["minutes"] == (None if r["marks"] is None else int(r["marks"] * 2.5 + 0.5) if r["marks"] >= 15 else r["marks"] * 2)
    want = {}
    for g, rows in grouped(pool).items():
        ordered = sorted(rows, key=lambda r: md5(r["question_id"], 11))
        essays, shorts = [r for r in ordered if essay(r)], [r for r in ordered if not essay(r)]
        for mock in range(1, min(3, max(1, sum(r["marks"] or 0 for r in rows) // 40)) + 1):
            picked, total = set(), 0
            if essays:
                first = essays.pop(0)
                picked, total = {first["question_id"]}, first["marks"] or 2147483647
            while shorts and total < 30:
                r = shorts.pop(0)
                picked.add(r["question_id"])
                total += r["marks"]
            if picked:
                want[(g, mock)] = picked
    assert got == want


def test_selections_do_not_depend_on_partitions(pool):
    def run(n):
        p = pool.repartition(n)
        return (sorted(map(tuple, am.select_balanced(p, ["g"], 60, 5, second_essay=True).collect()), key=str),
                sorted(map(tuple, am.select_time_budget(p, ["g"], F.lit(60), 3, restarts=4).collect()), key=str))

    assert run(1) == run(4) == run(37)


def question(i, **over):
    base = dict(question_id=f"q{i}", question_number="question1", year="2019", board="aqa", qualification="alevel", paper="1",
                question_text=f"text {i} (4)", marks=4, topics=["1.2.2 Demand"], question_file=f"/b/june/1/question{i}.pdf",
                markscheme_file=f"/m/{i}.pdf", content_md5=f"c{i}", markscheme_md5=f"m{i}")
    return tuple({**base, **over}[f.name] for f in QUESTIONS.fields)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([
        question(1), question(2, content_md5="c1", marks=5), question(3, year="2018", question_number="question6a", marks=None),
        question(4, topics=["1.2.2 Demand", "2.1.2 Inflation"], qualification="as", markscheme_md5=None, board="ocr"),
        question(5, topics=None, qualification=None)], QUESTIONS)


def test_overview(questions):
    got = {(r["qualification"], r["topic"]): (r["questions"], r["total_marks"], r["n_unknown_marks"], r["total_topics"])
           for r in stats.topic_overview(questions).collect()}
    assert got == {("a level", "1.2.2 Demand"): (2, 4, 1, 1), ("as level", "1.2.2 Demand"): (1, 4, 0, 2),
                   ("as level", "2.1.2 Inflation"): (1, 4, 0, 2)}
    shares = stats.share_of_total(stats.topic_counts(questions)).collect()
    assert math.isclose(sum(r["share"] for r in shares), 1.0)
    once = dedupe.dedupe_questions(questions)
    assert dedupe.dedupe_questions(once).count() == once.count() == 4


def test_report_and_lists(questions):
    report = {(r["qualification"], r["metric"], r["key"]): r["n"] for r in stats.topic_report(questions).collect()}
    assert report[("a level", "question_type", "Question 6 (Essays)")] == 1
    assert report[("a level", "marks_range", "11+")] == 1 and report[("unknown", "all", "")] == 1
    assert stats.topic_detail(questions, min_questions=3).collect()[0]["questions"] == 4
    listed = stats.topic_question_list(questions, n=2).filter("topic = '1.2.2 Demand'").orderBy("rank").collect()
    assert [r["label"] for r in listed] == ["2018 Q6a (? marks) - aqa", "2019 Q1 (4 marks) - aqa"] and listed[0]["more"] == 2


def test_bundle_and_index(spark, questions):
    entries = am.bundle_manifest(stats.by_topic(questions), ["topic"]).filter("topic = '1.2.2 Demand'").orderBy("seq").collect()
    assert [r["seq"] for r in entries] == list(range(1, 11))
    assert [r["question_id"] for r in entries if r["kind"] == "question"] == ["q3", "q1", "q4"]
    rows = spark.createDataFrame([question(i, markscheme_md5=f"m{i}", topics=["t"]) for i in (1, 2, 3)], QUESTIONS)
    counts = spark.createDataFrame([("m1", 3), ("m2", 2), ("m3", 4)], "markscheme_md5 string, valid_pages int")
    index = am.markscheme_index(stats.by_topic(rows), counts, ["topic"]).orderBy("start_page").collect()
    assert [r["start_page"] for r in index] == [2, 6, 9]


def test_manifest_and_extracts(spark):
    mocks = spark.createDataFrame([(1, 1, "q1", "question6a", "aqa", "alevel", "2019", "1", "/b/summer/1/question6a.pdf", "1.2.2 Demand", 8, 20),
                                   (1, 2, "q2", "question2", "aqa", "alevel", "2019", "1", "/b/x/1/question2.pdf", "t", 4, 10)],
                                  "mock int, seq int, question_id string, question_number string, board string, qualification string, "
                                  "year string, paper string, question_file string, topic string, marks int, minutes int")
    row = am.mock_manifest(mocks, ["mock"], [F.col("question_id")]).orderBy("seq").first()
    assert row["header"] == "Question 1 ( paper 1 june 2019 Q6a )" and row["cover"] == "paper 1 June 2019 Q6a [1.2.2 Demand]"
    extracts = spark.createDataFrame([("aqa", "alevel", "2019", "1", "extract2", "/e2")],
                                     "board string, qualification string, year string, paper string, extract string, extract_file string")
    found = am.required_extracts(mocks, extracts, ["mock"]).collect()
    assert [(r["question_id"], r["extract_file"]) for r in found] == [("q2", "/e2")]
    summary = am.mock_summary(mocks, ["mock"]).first()
    assert tuple(summary) == (1, 2, 12, 30, 2)


def test_bank_files(spark, questions, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2019.json").write_text(
        '[{"questionNumber": "question1", "year": "2019", "board": "AQA", "qualification": "A_LEVEL", "questionText": "x", '
        '"topics": ["t"], "questionFile": "/a/1/question1.pdf"}, {"year": "2019"}, {"questionNumber": "q", "year": "2019", '
        '"qualification": "zz"}]')
    good, bad = bank.read_question_bank(spark, str(tmp_path / "in"), recursive=True)
    row = good.collect()
    assert len(row) == 1 and (row[0]["board"], row[0]["qualification"], row[0]["paper"]) == ("aqa", "alevel", "1")
    assert sorted(r["reject"] for r in bad.collect()) == ["no question number", "unknown qualification"]
    bank.write_question_bank(questions.fillna({"qualification": "unknown"}), str(tmp_path / "out"))
    back = bank.read_written_bank(spark, str(tmp_path / "out"))
    assert back.count() == 5 and back.filter("year = '2018'").count() == 1


def test_incremental_stream(spark, tmp_path):
    from paperloom.operators.taxonomy import derived_keywords, taxonomy
    from paperloom.streaming.incremental import tag_new_bank_files
    (tmp_path / "in").mkdir()
    topics = taxonomy(spark)
    concepts = spark.createDataFrame([], "concept string, topic string")
    none = spark.createDataFrame([], "question_id string, labels array<string>")

    def arrive(name, text):
        (tmp_path / "in" / name).write_text(
            f'[{{"questionNumber": "question1", "year": "2019", "qualification": "as", "questionText": "{text}"}}]')
        tag_new_bank_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), topics,
                           derived_keywords(topics), concepts, none).awaitTermination()
        return sorted(r["topics"][0] for r in bank.read_written_bank(spark, str(tmp_path / "out")).collect())

    assert arrive("a.json", "why inflation matters") == ["2.1.2 Inflation"]
    assert arrive("b.json", "on oligopoly") == ["2.1.2 Inflation", "3.4.4 Oligopoly"]


def test_a_question_that_comes_again_is_tagged_once(spark, tmp_path):
    """The same question in two files of two runs, beside new ones and copies in one file."""
    from paperloom.operators.taxonomy import derived_keywords, taxonomy
    from paperloom.streaming.incremental import tag_each_question_once
    (tmp_path / "in").mkdir()
    topics = taxonomy(spark)
    concepts = spark.createDataFrame([], "concept string, topic string")
    none = spark.createDataFrame([], "question_id string, labels array<string>")

    def arrive(name, *texts):
        rows = [f'{{"questionNumber": "question1", "year": "2019", "qualification": "as", "questionText": "{t}"}}' for t in texts]
        (tmp_path / "in" / name).write_text("\n".join(rows) + "\nnot json\n")
        tag_each_question_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), topics,
                               derived_keywords(topics), concepts, none).awaitTermination()
        return sorted(r["topics"][0] for r in spark.read.parquet(str(tmp_path / "out/epoch=*")).collect())

    assert arrive("a.json", "why inflation matters", "why inflation matters") == ["2.1.2 Inflation"]
    assert arrive("b.json", "on oligopoly", "why inflation matters") == ["2.1.2 Inflation", "3.4.4 Oligopoly"]
    assert arrive("c.json", "on oligopoly") == ["2.1.2 Inflation", "3.4.4 Oligopoly"]
