"""Scalar rules on hand-made rows; expected values worked out from each rule."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import features as ft
from paperloom.functions import names as nm
from paperloom.functions import text as tx
from paperloom.operators import classify as cl
from paperloom.operators import labels as lb
from paperloom.operators import links as lk


def values(spark, inputs, expr, kind="string"):
    """expr(col) for each input, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_file_names(spark):
    names = ["economics_alevel_edexcel_2019_paper1_questionpaper.pdf", "question paper unit 1.pdf", "Paper 2 QP 2018.pdf",
             "June 2018 MS - Paper 1 Edexcel Economics A-level.pdf", "exams_2018.pdf", "x as-level cie.pdf", ".hidden"]
    assert values(spark, names, nm.is_canonical_name) == [True] + [False] * 6
    assert values(spark, names, nm.paper_number) == [1, None, 2, 1, None, None, None]
    assert values(spark, names, nm.paper_is_invalid) == [False, True, False, False, False, False, False]
    assert values(spark, names, nm.document_type) == [
        "questionpaper", "questionpaper", "questionpaper", "markscheme", "markscheme", None, None]
    assert values(spark, names, nm.year) == [2019, None, 2018, 2018, 2018, None, None]
    assert values(spark, names, nm.exam_board) == ["edexcel", None, None, "edexcel", None, "cambridge", None]
    assert values(spark, names, nm.qualification) == ["alevel", None, None, "alevel", None, "as", None]
    assert values(spark, names, nm.subject)[:4] == ["economics", None, None, "economics"]
    assert values(spark, names, nm.extension) == [".pdf"] * 6 + [""]
    assert values(spark, names, nm.stem)[-2:] == ["x as-level cie", ".hidden"]


def test_normalize_enum(spark):
    assert values(spark, ["CAIE", "pearson edexcel", "AQA", "zzz"], lambda c: nm.normalize_enum(c, "board")) == [
        "cambridge", "edexcel", "aqa", None]
    assert values(spark, ["GCE", "as level", "IB"], lambda c: nm.normalize_enum(c, "qualification")) == ["alevel", "as", "ib"]
    assert values(spark, ["ER", "my questionpaper x", "marks", "a question", "report", "x"],
                  lambda c: nm.normalize_enum(c, "document_type")) == [
        "examinerreport", "questionpaper", "markscheme", "questionpaper", "examinerreport", None]


def test_cleaning(spark):
    assert values(spark, ["Calculate ..... PMT (2 marks) *P123A4* Turn over", None, "a\n12\nb?? page 2 of 9 p77"],
                  tx.clean_text) == ["Calculate", "", "a b"]
    assert values(spark, ["Calculate using Figure 1", None], tx.mask_phrases) == ["for this question for this question 1", ""]
    assert values(spark, ["aaaa", "ba"], lambda c: tx.count_occurrences(c, F.lit("aa"))) == [2, 0]


def test_formatting(spark):
    assert values(spark, ["A_LEVEL", "as", "ib", "btec_first  year", None], tx.format_qualification) == [
        "A Level", "AS Level", "IB", "Btec First Year", "Unknown"]
    assert values(spark, ["a_b-c", None], tx.format_topic) == ["A B C", "Unknown Topic"]
    assert values(spark, ["question6a", "Q7", None], tx.format_question_number) == ["Question 6A", "Q7", "Unknown"]
    assert values(spark, ["1.2.3 a: b/c? ", "A-b.Pdf"], tx.sanitize_file_name) == ["1.2.3 a bc", "a_b.pdf"]
    assert values(spark, ["/x/Summer/1", "/fall/", "/winter", "/spring", "/x", None], tx.exam_month) == [
        "June", "October", "January", "March", "June", "June"]
    assert values(spark, ["123456789", "12345678"], lambda c: tx.truncate_label(c, 8)) == ["12345678...", "12345678"]
    assert values(spark, ["x" * 51, None], tx.trim_topic) == ["x" * 47 + "...", ""]
    assert values(spark, ['a {"k": {}} b', "none"], tx.extract_json_object) == ['{"k": {}}', "none"]
    assert values(spark, ['so ["a", "b"] ok', "none"], tx.json_array_items) == [["a", "b"], None]


@pytest.mark.parametrize("number,qualification,paper,text,expected", [
    ("question3", "alevel", "1", None, 5), ("question3", "as", "2", "(8)", 4), ("question3", "alevel", "3", "x (8)", 8),
    ("question6b", "alevel", "1", "(12) then (2)", 2), ("question6b", "alevel", "1", "nothing", None),
    ("question6b", "alevel", "1", None, None)])
def test_marks(spark, number, qualification, paper, text, expected):
    row = spark.createDataFrame([(number, qualification, paper, text)], "n string, q string, p string, t string")
    assert row.select(ft.marks(F.col("n"), F.col("q"), F.col("p"), F.col("t"))).first()[0] == expected


def test_question_rules(spark):
    numbers = ["question1a", "question12", "question3", "Question6c", None]
    assert values(spark, numbers, ft.is_essay) == [True, True, False, True, False]
    assert values(spark, numbers[:1], lambda c: ft.is_essay(c, F.lit("1"))) == [False]
    texts = ["Discuss it", "find the x", "Explain one x", "other", "x (11 marks)", "a (1) b", "1 mark"]
    assert values(spark, texts, ft.estimate_marks) == [12, 3, 3, 5, 5, 1, 1]
    assert values(spark, texts, lambda c: ft.estimate_marks(c, True))[4] == 1
    assert values(spark, ["x 11 mark"], lambda c: ft.estimate_marks(c, True)) == [1]
    assert values(spark, ["x 11 mark"], ft.estimate_marks) == [5]
    assert values(spark, [2, 3, 6, 10, 11, None], ft.marks_range, "int") == ["1-2", "3-4", "5-6", "7-10", "11+", "11+"]
    assert values(spark, [2, 5, 10, 25], ft.max_topics, "int") == [2, 3, 4, 4]
    for policy, plain in (("marks", 8), ("single", 4), ("unit", 8)):
        assert values(spark, [15], lambda c: ft.estimated_minutes(c, F.lit(True), policy), "int") == [38]
        assert values(spark, [4], lambda c: ft.estimated_minutes(c, F.lit(False), policy), "int") == [plain]


def test_fallback_topic(spark):
    texts = [None, "supply falls", "draw the market", "calculate the cost", "price we determine", "monopoly", "x"]
    assert values(spark, texts, cl.fallback_topic) == [
        "1.2.2 Demand", "1.2.4 Supply", "1.2.6 Price determination", "3.3.2 Costs", "1.2.6 Price determination",
        "3.4.5 Monopoly", "1.2.2 Demand"]


def test_consistent_topics(spark):
    cases = [["1.2.2 Demand", "1.2.8 Consumer and producer surplus"], ["3.4.4 Oligopoly", "1.2.4 Supply"],
             ["1.2.4 Supply", "1.2.5 Elasticity of supply"], ["2.1.2 Inflation", "1.2.4 Supply", "1.2.5 Elasticity of supply"]]
    assert values(spark, cases, lb.consistent_topics, "array<string>") == [
        ["1.2.8 Consumer and producer surplus"], ["1.2.4 Supply", "3.4.4 Oligopoly"],
        ["1.2.4 Supply", "1.2.5 Elasticity of supply"], ["2.1.2 Inflation", "1.2.5 Elasticity of supply"]]


def test_urls(spark):
    hrefs = ["a.pdf", "/x/./y/../z.pdf?q=1", "../up.pdf", "//cdn.org/f", "#top", "?p=2", "", "mailto:a@b", "HTTP://o.org/A"]
    base = "https://h.org/d/e/page.html?x=1#f"
    assert values(spark, hrefs, lambda c: lk.absolute_url(c, F.lit(base))) == [
        "https://h.org/d/e/a.pdf", "https://h.org/x/z.pdf?q=1", "https://h.org/d/up.pdf", "https://cdn.org/f",
        "https://h.org/d/e/page.html?x=1#top", "https://h.org/d/e/page.html?p=2", base, "", "HTTP://o.org/A"]
    assert values(spark, ["https://h.org/a%20b.pdf", "https://h.org/x/"], lk.url_filename)[0] == "a b.pdf"
    assert values(spark, [0, 1023, 1024, 1536, 5 * 1024 ** 2, 3 * 1024 ** 3], lk.human_bytes, "bigint") == [
        "0 B", "1023 B", "1 KB", "1.5 KB", "5 MB", "3 GB"]
    assert values(spark, ["https://h.org/theme-3/x", "https://h.org/last/"], lk.theme_from_url) == ["Theme-3", "last"]
