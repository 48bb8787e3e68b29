"""Whole runs composed of the operators: from page texts and file names to a tagged question bank."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import features
from paperloom.functions.text import clean_text
from paperloom.operators import segment as sg
from paperloom.operators.labels import assign_topics
from paperloom.plans.scale import stored_table

FOLDER = ["topic", "qualification", "board", "year", "paper"]


def _pages_of(pages: DataFrame, files: DataFrame, doc_type: str, phrases: list[str]) -> DataFrame:
    """(doc_id, page_no, text, is_paper3) of the files of one type."""
    wanted = pages.select("doc_id", "page_no", "text").join(files.filter(F.col("doc_type") == doc_type).select("doc_id").distinct(), "doc_id", "left_semi")
    third = sg.flag_paper3(wanted, files, phrases).select("doc_id", F.coalesce("is_paper3", F.lit(False)).alias("is_paper3"))
    return wanted.join(third, "doc_id")


def question_ranges(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, question_number, start_page, end_page) of all question papers.

    Section A of a paper holds the questions closed by their totals and section B the parts of question 6; in paper 3 they
    hold the parts of questions 1 and 2. `files` has doc_id, doc_type and paper. Both sections are cut from one stored table
    of page marks. A paper in which a number is closed more than once keeps the last, as its file would.
    """
    papers = _pages_of(pages, files, "questionpaper", sg.PAPER3_QUESTIONS)
    sections = papers.join(sg.split_sections(papers), ["doc_id", "page_no"]).select(
        F.struct("doc_id", "section", "is_paper3").alias("doc_id"), "page_no", "text")
    marks = sg.page_marks(sections)
    third, first = F.col("doc_id.is_paper3"), F.col("doc_id.section") == "A"
    totals = sg.questions_by_totals(marks.filter(~third & first)).select("doc_id", F.col("number").cast("string").alias("number"), "start_page", "end_page")
    main = F.when(~third, "6").when(first, "1").otherwise("2")
    parts = sg.question_parts(marks.filter(third | ~first)).filter(F.col("number") == main).select(
        "doc_id", F.concat("number", "letter").alias("number"), "start_page", "end_page")
    last = F.max(F.struct("end_page", "start_page"))
    return totals.unionByName(parts).groupBy(F.col("doc_id.doc_id").alias("doc_id"), F.concat(F.lit("question"), "number").alias("question_number")).agg(
        last.alias("l")).select("doc_id", "question_number", "l.start_page", "l.end_page")


def markscheme_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, question_number, page_no) of all mark schemes: grown sections in paper 3, question tables in the others."""
    schemes = _pages_of(pages, files, "markscheme", sg.PAPER3_MARKSCHEMES)
    sections = sg.markscheme_sections(schemes.filter("is_paper3").drop("is_paper3")).select(
        "doc_id", F.col("key").alias("question"), F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    tables = sg.group_question_pages(sg.question_table_pages(schemes.filter("not is_paper3"))).select("doc_id", "question", "page_no")
    return sections.unionByName(tables).select("doc_id", F.concat(F.lit("question"), "question").alias("question_number"), "page_no")


def _files_of(rows: DataFrame, pages: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """One row per question cut from a file: the folder's fields, its path under `name`, its text and the text's md5.

    A question's text is one value, so its pages meet in one task; they are pages of one document.
    """
    texts = rows.join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"]).groupBy("doc_id", "question_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))
    path = F.concat_ws("/", "path", "question_number")
    return texts.join(files.select("doc_id", "path", *FOLDER), "doc_id").select(
        *FOLDER, "question_number", path.alias(name), "text", F.md5("text").alias("content_md5"))


def extract_all_questions(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Questions of all papers that have a mark scheme, in engine columns; `topics` is NULL.

    `pages` has doc_id, page_no and text; `files` the catalogue's columns and doc_id, one row per document. Documents that
    are neither papers nor schemes, pages without a file and NULL texts give nothing. Texts are stored once.
    """
    asked = question_ranges(pages, files).select("doc_id", "question_number", F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    questions = stored_table(_files_of(asked, pages, files, "question_file"))
    schemes = _files_of(markscheme_pages(pages, files), pages, files, "markscheme_file")
    pairs = sg.pair_questions_with_markschemes(questions, schemes).select("question_file", "markscheme_file", "markscheme_md5")
    text = clean_text(F.col("text"))
    return questions.join(pairs, "question_file").select(
        F.col("question_file").alias("question_id"), "question_number", F.col("year").cast("string").alias("year"), "board", "qualification",
        F.col("paper").cast("string").alias("paper"), text.alias("question_text"), _marks(text).alias("marks"),
        F.lit(None).cast("array<string>").alias("topics"), "question_file", "markscheme_file", "content_md5", "markscheme_md5")


def _marks(text: Column) -> Column:
    return features.marks(F.col("question_number"), F.col("qualification"), F.col("paper").cast("string"), text)


def process_past_papers(pages: DataFrame, files: DataFrame, topics: DataFrame, keywords: DataFrame, concepts: DataFrame,
                        suggestions: DataFrame) -> DataFrame:
    """The whole run: questions cut out, paired with their mark schemes, cleaned and tagged, ready for `write_question_bank`.

    Questions that no step can tag keep NULL topics.
    """
    questions = stored_table(extract_all_questions(pages, files))
    tagged = assign_topics(questions, topics, keywords, concepts, suggestions).select("question_id", F.col("topics").alias("assigned"), "method")
    return questions.join(tagged, "question_id", "left").withColumn("topics", F.col("assigned")).drop("assigned")
