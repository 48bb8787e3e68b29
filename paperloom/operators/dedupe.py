"""De-duplication and ordering of questions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.features import question_key
from paperloom.plans.scale import first_per_key


def with_question_key(questions: DataFrame) -> DataFrame:
    return questions.withColumn("question_key", question_key(
        F.col("content_md5"), F.col("year"), F.col("board"), F.col("question_number")))


def dedupe_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by `order`; an aggregate, so hot copies are folded map-side."""
    return first_per_key(df, key, order)


def dedupe_questions(questions: DataFrame, within: list[str] = ()) -> DataFrame:
    """One question per content (or per year, board and number where content is unknown)."""
    keyed = questions if "question_key" in questions.columns else with_question_key(questions)
    return first_per_key(keyed, [*within, "question_key"], [F.col("question_id")])


def dedupe_by_content(df: DataFrame, md5: str, order: list[Column], within: list[str] = ()) -> DataFrame:
    """First row of each file content; rows without a file are dropped."""
    return first_per_key(df.filter(F.col(md5).isNotNull()), [*within, md5], order)


def sort_questions(questions: DataFrame) -> DataFrame:
    """By year and question number as strings, then question_id."""
    return questions.orderBy("year", "question_number", "question_id")
