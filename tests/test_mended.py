"""Cases that once went wrong."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import assemble as am
from paperloom.operators import catalogue as cat
from paperloom.operators import links as lk
from paperloom.operators import segment as sg
from paperloom.operators import stats as st
from paperloom.sources import bank


def test_existing_names_are_never_overwritten(spark):
    canonical = "economics_alevel_edexcel_2018_paper1_questionpaper.pdf"
    loose = "Economics Paper 1 QP 2018 edexcel a-level.pdf"
    files = spark.createDataFrame([("a/1", canonical), ("a/2", loose), ("b/1", loose), ("b/2", "x " + loose)], "path string, name string")
    got = {r.path: (r.new_name, r.status) for r in cat.file_actions(cat.parse_catalogue(files)).collect()}
    assert got["a/1"] == (canonical, "skipped") and got["b/1"] == (canonical, "renamed")
    for path in ("a/2", "b/2"):
        assert got[path][1] == "renamed" and got[path][0].startswith(canonical[:-4] + "_") and got[path][0] != canonical


def test_only_nested_sections_have_a_parent(spark):
    html = "<h4>One</h4><a href='a.pdf'>x</a><h5>Two</h5><a href='b.pdf'>x</a><strong>Three</strong><a href='c.pdf'>x</a>"
    pages = spark.createDataFrame([(1, "http://e.org/", html.replace("'", '"'))], "page_id int, url string, html string")
    got = {r.section: r.parent for r in lk.links_by_section(pages, parent_tag="h4").collect()}
    assert got == {"One": "One", "Two": "One", "Three": None}


QUESTIONS = "question_id string, question_number string, year string, board string, marks int, topics array<string>"


def test_overview_without_groups(spark):
    rows = spark.createDataFrame([("a", "question1", "2018", "aqa", 3, ["x"]), ("b", "question6a", "2019", "aqa", None, ["x", "y"])], QUESTIONS)
    row = st.overview_stats(rows, []).first()
    assert (row.total_questions, row.q6_questions, row.topics, row.years, row.boards, row.n_unknown_marks) == (2, 1, 2, 2, 1, 1)


def test_one_scheme_for_each_number(spark):
    key = ("economics", "aqa", "as", "2018", "1", "question1")
    shape = "topic string, board string, qualification string, year string, paper string, question_number string, {} string, content_md5 string"
    questions = spark.createDataFrame([(*key, f"q{i}", f"m{i}") for i in (3, 1, 2)], shape.format("question_file"))
    schemes = spark.createDataFrame([(*key, f"s{i}", f"n{i}") for i in (2, 3, 1)], shape.format("markscheme_file"))
    got = sg.pair_questions_with_markschemes(questions, schemes).collect()
    assert [(r.question_file, r.markscheme_file) for r in got] == [("q1", "s1")]


def test_numbers_with_letters(spark):
    assert sg.next_question_pattern("6a") == r"^7\s"
    assert sg.next_question_pattern("x") is not None
    pages = spark.createDataFrame([(1, 1, "6a main"), (1, 2, "(a) part"), (1, 3, "7 next")], "doc_id bigint, page_no int, text string")
    sg.split_subquestions(pages, "6a").collect()


def test_cheap_questions_are_named(spark):
    rows = spark.createDataFrame([("a", 0), ("b", -1), ("c", 1), ("d", None)], "question_id string, marks int")
    assert sorted(r.question_id for r in am.unpriced(rows).collect()) == ["a", "b"]


@pytest.mark.parametrize("target", [60, 90])
def test_time_budget_follows_its_target(spark, target):
    rows = spark.createDataFrame([("g", f"q{i}", 2, 2, True) for i in range(100)], "g string, question_id string, marks int, minutes int, is_short boolean")
    picked = am.select_time_budget(rows, ["g"], F.lit(target), seed=1, restarts=3)
    assert target - 15 <= picked.agg(F.sum("minutes")).first()[0] < target - 13


def test_bank_ids_are_unique_and_years_prune(spark, tmp_path):
    rows = [(str(2015 + i % 3), f"question{i % 7}", f"text {i}", "/bank/f.pdf") for i in range(200)]
    questions = spark.createDataFrame(rows, "year string, question_number string, question_text string, question_file string").selectExpr(
        "*", "'aqa' as board", "'as' as qualification", "3 as marks", "array('x') as topics", "cast(null as string) as markscheme_file")
    bank.write_question_bank(questions, str(tmp_path))
    back = bank.read_written_bank(spark, str(tmp_path))
    assert back.count() == back.select("question_id").distinct().count() == 200
    chosen = back.filter("year = '2016'")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "bank_year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert chosen.count() == sum(r[0] == "2016" for r in rows)
