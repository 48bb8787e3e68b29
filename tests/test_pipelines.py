"""Composed runs on a few small papers written out by hand."""

from paperloom import pipelines as pl
from paperloom.operators.catalogue import parse_catalogue

PAGES = [
    (1, 1, "Front"), (1, 2, "1 Define demand\n(Total for Question 1 = 4 marks)"), (1, 3, "2 Explain supply"), (1, 4, "(Total for Question 2 = 4 marks)"),
    (1, 5, "SECTION B\n6 Read the extract"), (1, 6, "(a) Explain inflation (5)"), (1, 7, "more of a"), (1, 8, "(b) Discuss growth (10)"), (1, 9, None),
    (2, 1, "Marks for paper"), (2, 2, "1 (a) knowledge of demand, 2 marks"), (2, 3, "6 (a) analysis of inflation"), (2, 4, "6 (b) evaluation of growth"),
    (2, 5, "6 (b) evaluation, continued"),
    (3, 1, "Paper 3 front"), (3, 2, "1 Study"), (3, 3, "(a) What is the elasticity"), (3, 4, "(b) and why"), (3, 5, "SECTION B\n2 Study"), (3, 6, "(a) Inflation again"),
    (4, 1, "Paper 3 marks: front matter of the scheme with enough words to be kept"),
    (4, 2, "1 (a) knowledge of elasticity, analysis and evaluation of the answer, marks"), (4, 3, "knowledge and application: 2 marks, 4 marks, level 3 answers"),
    (4, 4, "2 (a) knowledge of inflation, analysis and evaluation of the answer, marks"), (5, 1, "Report"), (5, 2, "1 A report\n(Total for Question 1 = 4 marks)")]
NAMES = [(1, "in/qp1", "economics_alevel_edexcel_2019_paper1_questionpaper.pdf"), (2, "in/ms1", "economics_alevel_edexcel_2019_paper1_markscheme.pdf"),
         (3, "in/qp3", "economics_alevel_edexcel_2019_paper3_questionpaper.pdf"), (4, "in/ms3", "economics_alevel_edexcel_2019_paper3_markscheme.pdf"),
         (5, "in/er", "economics_alevel_edexcel_2019_examinerreport.pdf")]


def inputs(spark, names=NAMES, pages=PAGES):
    files = parse_catalogue(spark.createDataFrame(names, "doc_id bigint, path string, name string"))
    return spark.createDataFrame(pages, "doc_id bigint, page_no int, text string"), files


def test_ranges_by_section(spark):
    rows = pl.question_ranges(*inputs(spark)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "question1", 2, 2), (1, "question2", 3, 4), (1, "question6a", 6, 7), (1, "question6b", 8, 8),
                                              (3, "question1a", 3, 3), (3, "question1b", 4, 4), (3, "question2a", 6, 6)]


def test_scheme_pages(spark):
    rows = sorted(tuple(r) for r in pl.markscheme_pages(*inputs(spark)).collect())
    assert rows == [(2, "question1", 2), (2, "question6a", 3), (2, "question6b", 4), (2, "question6b", 5),
                    (4, "question1a", 2), (4, "question1a", 3), (4, "question2a", 4)]


def test_whole_run(spark):
    topics = spark.createDataFrame([("1.1 Demand", 1), ("2.1 Inflation", 2)], "topic string, ord int")
    words = spark.createDataFrame([("1.1 Demand", "demand"), ("2.1 Inflation", "inflation")], "topic string, keyword string")
    none = spark.createDataFrame([], "concept string, topic string")
    offered = spark.createDataFrame([], "question_id string, labels array<string>")
    got = {r.question_id: r for r in pl.process_past_papers(*inputs(spark), topics, words, none, offered).collect()}
    assert set(got) == {"in/qp1/question1", "in/qp1/question6a", "in/qp1/question6b", "in/qp3/question1a", "in/qp3/question2a"}
    a = got["in/qp1/question6a"]
    assert (a.markscheme_file, a.year, a.paper, a.marks) == ("in/ms1/question6a", "2019", "1", 5) and "inflation" in a.question_text.lower()
    assert "more of a" in a.question_text and got["in/qp1/question1"].marks == 5


def test_runs_on_nothing(spark):
    pages, files = inputs(spark)
    assert pl.extract_all_questions(pages.limit(0), files).count() == 0
    assert pl.extract_all_questions(pages, files.limit(0)).count() == 0
