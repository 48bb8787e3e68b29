import random

from pyspark.sql import functions as F

from paperloom.operators import segment as sg
from paperloom.plans import scale


def pages(spark, *texts, doc=1):
    return spark.createDataFrame([(doc, i + 1, t) for i, t in enumerate(texts)], "doc_id bigint, page_no int, text string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_split_sections(spark):
    p = pages(spark, "cover", "a", "b", "SECTION B", "c")
    assert rows(sg.split_sections(p), "section", "page_no") == [("A", 2), ("A", 3), ("B", 4), ("B", 5)]
    assert rows(sg.split_sections(pages(spark, "cover", "a")), "section", "page_no") == [("A", 2)]


def test_questions_by_totals(spark):
    p = pages(spark, "1 first\ntext", "(Total for Question 1 = 5 marks)\n2 second", "1 odd\n(Total for Question 2 = 4 marks)",
              "(Total for Question 9 = 4 marks)")
    assert rows(sg.find_questions_by_totals(p), "number", "start_page", "end_page") == [(1, 1, 2), (2, 2, 3)]


def test_subquestions(spark):
    p = pages(spark, "6 main", "(a) x", "cont", "(b) y", "7 next", "(c) z")
    assert rows(sg.split_subquestions(p, "6"), "letter", "start_page", "end_page") == [("a", 2, 3), ("b", 4, 4)]
    again = pages(spark, "2 main", "(a) x", "(b) y", "(a) z", "3 more")
    assert rows(sg.split_subquestions(again, "2"), "letter", "start_page", "end_page") == [("a", 2, 2), ("b", 3, 3)]
    starts = sg.find_question_start(again, "3")
    assert rows(sg.context_pages(again, starts, "1"), "page_no", "extract") == [(i, "extract1") for i in range(1, 5)]


def test_markscheme_sections(spark):
    pad = " long enough to count as a page of some marking text " * 2
    p = pages(spark, "1 (a)" + pad, "text" + pad, "tiny", "1(b) 2 (a)" + pad, "1 (b)" + pad, "knowledge" + pad, "no words here at all, plain prose "
              "running on and on and on", "x", "marks" + pad)
    sections = sg.subquestion_sections(p)
    assert rows(sections, "key", "start_page", "max_end") == [("1a", 1, 3), ("1b", 5, 9), ("2a", 4, 4)]
    ended = sg.extend_section_end(sections, p)
    assert rows(ended, "key", "start_page", "end_page") == [("1a", 1, 2), ("1b", 5, 6), ("2a", 4, 4)]
    grown = sg.markscheme_sections(p)
    assert rows(grown, *grown.columns) == rows(ended, *ended.columns)
    assert "text" not in grown._jdf.queryExecution().optimizedPlan().toString()
    assert rows(sg.group_sections_by_main(ended), "main", "page_no") == [("1", 1), ("1", 2), ("1", 5), ("1", 6), ("2", 4)]


def test_table_pages(spark):
    p = pages(spark, "short", "3(a) and more", "3 (b) 3(a) text", "6(c) some text", "0(a) nothing")
    found = sg.question_table_pages(p)
    assert rows(found, "key", "page_no") == [("0(a)", 5), ("3(a)", 2), ("3(a)", 3), ("3(b)", 3), ("6(c)", 4)]
    assert rows(sg.group_question_pages(found), "question", "page_no") == [("3", 2), ("3", 3), ("6c", 4)]


def test_valid_pages_and_guidance(spark):
    p = pages(spark, "the same page of text", "the same page of text ", "BLANK PAGE and some words", "twelve chars")
    assert rows(sg.valid_pages(p, 20, sg.BLANK_PHRASE), "page_no") == [(1,)]
    assert rows(sg.valid_pages(p), "page_no") == [(1,), (3,), (4,)]
    g = pages(spark, "x" * 60, "Pearson " + "x" * 60, "Pearson question " + "x" * 60, "Marking Guidance" + "x" * 60, "short")
    assert rows(sg.drop_guidance_pages(g), "page_no") == [(1,), (3,)]


def test_paper3(spark):
    p = pages(spark, "x", "y", "Paper THREE").union(pages(spark, "x", "y", "z", "paper 3", doc=2)).union(pages(spark, "x", doc=3))
    files = spark.createDataFrame([(3, 3), (2, 1)], "doc_id bigint, paper int")
    assert rows(sg.flag_paper3(p, files), "doc_id", "is_paper3") == [(1, True), (2, False), (3, True)]


def test_pairing(spark):
    cols = "topic string, board string, qualification string, year string, paper string, question_number string"
    q = spark.createDataFrame([("e", "aqa", "as", "2019", None, "question1", "/q1", "m1"), ("e", "aqa", "as", "2019", "1", "question2", "/q2", "m2")],
                              cols + ", question_file string, content_md5 string")
    m = spark.createDataFrame([("e", "aqa", "as", "2019", None, "question1", "/m1", "n1")], cols + ", markscheme_file string, content_md5 string")
    out = sg.pair_questions_with_markschemes(q, m).collect()
    assert [(r["question_file"], r["markscheme_file"], r["markscheme_md5"]) for r in out] == [("/q1", "/m1", "n1")]


def test_next_position_across_blocks(spark, monkeypatch):
    """One document holds most pages; blocks of 8 pages must give what one window over the whole gives."""
    monkeypatch.setattr(scale, "BLOCK", 8)
    df = spark.range(500).selectExpr("if(id < 400, 1, 2) as doc_id", "cast(id as int) as page_no").withColumn(
        "hit", F.pmod(F.xxhash64("page_no"), F.lit(13)) == 0)
    got = {(r["doc_id"], r["page_no"]): r["nxt"] for r in scale.next_position(
        df.repartition(7), ["doc_id"], "page_no", ["page_no"], F.col("hit"), "nxt", F.col("page_no")).collect()}
    data = [(r["doc_id"], r["page_no"], r["hit"]) for r in df.collect()]
    for doc, page, _ in data:
        later = [p for d, p, h in data if d == doc and h and p > page]
        assert got[(doc, page)] == (min(later) if later else None)


def test_all_numbers_come_from_one_scan(spark, monkeypatch):
    """Parts of every number, over small page blocks, equal those found for each number by itself; no text is read twice."""
    monkeypatch.setattr(scale, "BLOCK", 4)
    rng = random.Random(2)
    docs = [(d, p + 1, "\n".join(rng.choice(["plain", f"{rng.choice([1, 2, 3, 6, 7, 10])} main", "  6\tx ", "6", "(a) x", "(b) y", "then (c)", "06 odd"])
                                 for _ in range(rng.randrange(3)))) for d in range(9) for p in range((1, 5, 40)[d % 3])]
    p = spark.createDataFrame(docs, "doc_id bigint, page_no int, text string").repartition(3)
    marks = sg.page_marks(p)
    parts = sg.question_parts(marks)
    got = {}
    for r in parts.collect():
        got.setdefault(r.number, []).append((r.doc_id, r.letter, r.start_page, r.end_page))
    starts = {}
    for r in sg.question_starts(marks).collect():
        starts.setdefault(r.number, []).append((r.doc_id, r.start_page))
    assert set(starts) >= {"1", "2", "3", "6", "06", "7", "10"}
    for number in starts:
        assert sorted(starts[number]) == rows(sg.find_question_start(p, number), "doc_id", "start_page")
        assert sorted(got.get(number, [])) == rows(sg.split_subquestions(p, number), "doc_id", "letter", "start_page", "end_page")
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "NestedLoop" not in plan


def test_marks_of_empty_pages(spark):
    assert sg.question_parts(sg.page_marks(pages(spark, None, "", "\n"))).count() == 0
    none = pages(spark, "1 x").limit(0)
    assert sg.question_parts(sg.page_marks(none)).count() == sg.questions_by_totals(sg.page_marks(none)).count() == 0
