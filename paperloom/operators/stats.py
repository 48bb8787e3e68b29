"""Counts, shares and reports over questions.

Every operator takes `by`, the columns its figures are reported for, and
pre-aggregates before each shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.features import is_question6, marks_range
from paperloom.functions.text import original_question_number, qualification_label
from paperloom.operators.dedupe import dedupe_questions, with_question_key
from paperloom.operators.taxonomy import topic_theme
from paperloom.plans.scale import null_safe_join, top_per_group

Q6_LABEL = "Question 6 (Essays)"
SHORT_LABEL = "Questions 1-5"


def by_topic(questions: DataFrame) -> DataFrame:
    """One row per (question, topic)."""
    return questions.withColumn("topic", F.explode("topics")).drop("topics")


def topic_counts(questions: DataFrame, by: list[str] = ()) -> DataFrame:
    return questions.select(*by, F.explode("topics").alias("topic")).groupBy(*by, "topic").agg(
        F.count("*").alias("n"))


def key_counts(questions: DataFrame, key: Column, name: str, by: list[str] = ()) -> DataFrame:
    return questions.groupBy(*by, key.alias(name)).agg(F.count("*").alias("n"))


def year_counts(questions: DataFrame, by: list[str] = ()) -> DataFrame:
    return key_counts(questions, F.col("year"), "year", by)


def board_counts(questions: DataFrame, by: list[str] = ()) -> DataFrame:
    return key_counts(questions, F.col("board"), "board", by)


def question_type(number: Column) -> Column:
    return F.when(is_question6(number), Q6_LABEL).otherwise(SHORT_LABEL)


def question_type_counts(questions: DataFrame, by: list[str] = ()) -> DataFrame:
    return key_counts(questions, question_type(F.col("question_number")), "question_type", by)


def number_label(number: Column) -> Column:
    return F.concat(F.lit("Q"), F.substring(original_question_number(number), 1, 1))


def question_number_counts(questions: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count per leading digit of the question number."""
    return key_counts(questions, number_label(F.col("question_number")), "number", by)


def marks_distribution(questions: DataFrame, by: list[str] = ()) -> DataFrame:
    return key_counts(questions, marks_range(F.col("marks")), "marks_range", by)


def overview_stats(questions: DataFrame, by: list[str]) -> DataFrame:
    """Questions, marks, Q6 split, distinct topics, years and boards, mean marks.

    Distinct counts run on the small (by, year, board) and (by, topic) tables.
    """
    if not by:
        everything = questions.withColumn("_all", F.lit(0))
        return overview_stats(everything, ["_all"]).drop("_all")
    cells = questions.groupBy(*by, "year", "board").agg(
        F.count("*").alias("n"), F.sum("marks").alias("m"), F.count("marks").alias("known"),
        F.count_if(is_question6(F.col("question_number"))).alias("q6"))
    totals = cells.groupBy(*by).agg(
        F.sum("n").alias("total_questions"), F.sum("m").alias("total_marks"),
        F.sum("known").alias("known_marks"), F.sum("q6").alias("q6_questions"),
        F.count_distinct("year").alias("years"), F.count_distinct("board").alias("boards"))
    topics = topic_counts(questions, by).groupBy(*by).agg(F.count("*").alias("topics"))
    joined = null_safe_join(totals, topics, list(by), "left")
    return joined.select(
        *by, "total_questions", "total_marks",
        (F.col("total_questions") - F.col("q6_questions")).alias("q1to5_questions"), "q6_questions",
        F.coalesce("topics", F.lit(0).cast("long")).alias("topics"), "years", "boards",
        (F.col("total_marks") / F.col("total_questions")).alias("avg_marks"),
        (F.col("total_questions") - F.col("known_marks")).alias("n_unknown_marks"))


def top_topics(questions: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The k most frequent topics per `by`, ties by topic."""
    return top_per_group(topic_counts(questions, by), list(by), [-F.col("n"), F.col("topic")], k)


def marks_stats(questions: DataFrame, by: list[str] = ()) -> DataFrame:
    return questions.groupBy(*by).agg(
        F.sum("marks").alias("total_marks"), F.avg("marks").alias("avg_marks"),
        F.min("marks").alias("min_marks"), F.max("marks").alias("max_marks"),
        F.count_if(F.col("marks").isNull()).alias("n_unknown_marks"))


def _topic_years(questions: DataFrame, by: list[str]) -> DataFrame:
    return by_topic(questions.select(*by, "year", "marks", "topics")).groupBy(*by, "topic", "year").agg(
        F.count("*").alias("n"), F.sum("marks").alias("m"))


def topic_detail(questions: DataFrame, by: list[str] = (), min_questions: int = 5) -> DataFrame:
    """Questions, marks, years and mean marks of topics with at least `min_questions`."""
    return _topic_years(questions, list(by)).groupBy(*by, "topic").agg(
        F.sum("n").alias("questions"), F.sum("m").alias("total_marks"), F.count("*").alias("years")
    ).filter(F.col("questions") >= min_questions).withColumn(
        "avg_marks", F.col("total_marks") / F.col("questions"))


def topic_years(questions: DataFrame, by: list[str] = (), min_questions: int = 5) -> DataFrame:
    """Per-year counts of the topics of `topic_detail` seen in more than one year."""
    cells = _topic_years(questions, list(by))
    shown = cells.groupBy(*by, "topic").agg(F.sum("n").alias("q"), F.count("*").alias("y")).filter(
        (F.col("q") >= min_questions) & (F.col("y") > 1)).select(*by, "topic")
    return null_safe_join(cells, shown, [*by, "topic"]).select(*by, "topic", "year", "n")


def topic_question_list(questions: DataFrame, by: list[str] = (), n: int = 15) -> DataFrame:
    """First n questions of each topic by year, number and id, and how many more there are."""
    rows = by_topic(questions)
    totals = rows.groupBy(*by, "topic").agg(F.count("*").alias("total"))
    top = top_per_group(rows, [*by, "topic"], [F.col(c) for c in ("year", "question_number", "question_id")], n)
    label = F.concat(F.col("year"), F.lit(" Q"), original_question_number(F.col("question_number")), F.lit(" ("),
                     F.coalesce(F.col("marks").cast("string"), F.lit("?")), F.lit(" marks) - "), F.col("board"))
    return null_safe_join(top, totals, [*by, "topic"]).select(
        *by, "topic", "rank", "question_id", label.alias("label"),
        F.greatest(F.col("total") - n, F.lit(0)).alias("more"))


def topic_overview(questions: DataFrame) -> DataFrame:
    """Per qualification and topic: distinct questions, marks and theme, with the topic total.

    Two copies of a question under one topic count once.
    """
    rows = by_topic(with_question_key(questions).select("qualification", "topics", "question_key", "question_id",
                                                        "marks"))
    unique = dedupe_questions(rows, ["qualification", "topic"])
    cells = unique.groupBy("qualification", "topic").agg(
        F.count("*").alias("questions"), F.sum("marks").alias("total_marks"),
        F.count_if(F.col("marks").isNull()).alias("n_unknown_marks"))
    # One row for each topic, so a window over them is small and the questions are folded once.
    total = F.count(F.lit(1)).over(Window.partitionBy("qualification"))
    return cells.withColumn("total_topics", total).select(
        qualification_label(F.col("qualification")).alias("qualification"), "topic",
        topic_theme(F.col("topic")).alias("theme"), "questions", "total_marks", "n_unknown_marks", "total_topics")


def share_of_total(counts: DataFrame, by: list[str] = (), value: str = "n") -> DataFrame:
    """`share`: value over the sum per `by` (pie charts, topic distribution)."""
    return _against(counts, list(by), value, F.sum(value), "share")


def share_of_max(counts: DataFrame, by: list[str] = (), value: str = "n") -> DataFrame:
    """`share`: value over the largest value per `by` (bar charts)."""
    return _against(counts, list(by), value, F.max(value), "share")


def _against(counts: DataFrame, by: list[str], value: str, whole: Column, out: str) -> DataFrame:
    """Value over the whole of its `by` group; without `by` the whole is a scalar subquery."""
    if not by:
        return counts.withColumn(out, F.col(value) / counts.agg(whole.alias("whole")).scalar())
    joined = null_safe_join(counts, counts.groupBy(*by).agg(whole.alias("_whole")), by)
    return joined.withColumn(out, F.col(value) / F.col("_whole")).drop("_whole")


def topic_distribution(questions: DataFrame, by: list[str] = ()) -> DataFrame:
    """Topic counts and their percentage of all topic assignments."""
    return share_of_total(topic_counts(questions, by), by).withColumn("pct", F.col("share") * 100).drop("share")


def multi_topic_share(questions: DataFrame) -> DataFrame:
    """Per year, the percentage of questions with more than one topic."""
    return questions.groupBy("year").agg(
        F.count("*").alias("questions"), F.count_if(F.size("topics") > 1).alias("multi")
    ).withColumn("pct", F.col("multi") / F.col("questions") * 100)


def overused_topics(questions: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Per year, topics given to more than `threshold` percent of the questions."""
    totals = year_counts(questions).withColumnRenamed("n", "questions")
    pct = F.col("n") / F.col("questions") * 100
    return null_safe_join(topic_counts(questions, ["year"]), totals, ["year"]).withColumn("pct", pct).filter(
        F.col("pct") > threshold)


def questions_by_qualification_topic(questions: DataFrame) -> DataFrame:
    """One row per (qualification, topic, question)."""
    return by_topic(questions).select(
        qualification_label(F.col("qualification")).alias("qualification"), "topic", "question_id")


def topic_report(questions: DataFrame) -> DataFrame:
    """All counts of the analysis report in long form: (qualification, metric, key, n, marks, ...).

    One scan folds the questions, and each question's topics, into cells; one aggregate over the grouping sets of the
    cells gives all metrics, told apart by which column a row is grouped by.
    """
    whole = F.struct(F.lit(True).alias("is_question"), F.lit(None).cast("string").alias("topic"), "year", "board", "question_number")
    each = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.struct(
        F.lit(False).alias("is_question"), t.alias("topic"), *[F.lit(None).cast("string").alias(c) for c in ("year", "board", "question_number")]))
    rows = questions.select("qualification", F.col("marks").alias("mark"), F.explode(F.concat(F.array(whole), each)).alias("c"))
    cells = rows.select("qualification", "mark", "c.*").groupBy(
        "qualification", "is_question", "topic", "year", "board", "question_number", "mark").agg(F.count("*").alias("n"))
    number = F.col("question_number")
    keys = {"topic": F.col("topic"), "year": F.col("year"), "board": F.col("board"), "question_type": question_type(number),
            "number": number_label(number), "marks_range": marks_range(F.col("mark"))}
    scope = ["label", "is_question"]
    named = cells.select(qualification_label(F.col("qualification")).alias("label"), "is_question", "mark", "n",
                         *[k.alias(f"by_{name}") for name, k in keys.items()])
    columns = [f"by_{name}" for name in keys]
    summed = named.groupingSets([scope, *[[*scope, c] for c in columns]], *scope, *columns).agg(
        F.sum("n").alias("n"), F.sum(F.col("mark") * F.col("n")).alias("marks"), F.min("mark").alias("min_marks"), F.max("mark").alias("max_marks"),
        *[F.grouping(c).alias(f"without_{c}") for c in columns])
    metric, key = F.lit("all"), F.lit("")
    for name, c in zip(keys, columns):
        grouped = F.col(f"without_{c}") == 0
        metric, key = F.when(grouped, name).otherwise(metric), F.when(grouped, F.col(c)).otherwise(key)
    rows = summed.select(F.col("label").alias("qualification"), "is_question", metric.alias("metric"), key.alias("key"), "n", "marks", "min_marks", "max_marks")
    return rows.filter(F.col("is_question") != (F.col("metric") == "topic")).drop("is_question")
