"""Reports from stored cells: small tables per year that merge, so that a new year never reads the questions of old ones.

Counts and sums add up. Distinct topics do not, so each cell keeps them as exact bitmaps, one bit a topic number, which merge
by OR whatever they have in common. Years and boards are the cells' own keys.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.features import is_question6
from paperloom.operators.stats import by_topic
from paperloom.plans.scale import null_safe_join


def numbered_topics(questions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(topic, number): the numbers of `known` kept, topics new to it numbered on from its largest, by name.

    The window runs over the distinct new topics, whose number the dictionary bounds. NULL topics get a number as well.
    """
    topics = questions.select(F.explode("topics").alias("topic")).distinct()
    if known is None:
        return topics.select("topic", F.row_number().over(Window.orderBy("topic")).cast("long").alias("number"))
    new = null_safe_join(topics, known.select("topic"), ["topic"], "left_anti")
    start = F.coalesce(known.agg(F.max("number").alias("n")).scalar(), F.lit(0))
    return known.select("topic", "number").unionByName(
        new.select("topic", (F.row_number().over(Window.orderBy("topic")) + start).cast("long").alias("number")))


def overview_cells(questions: DataFrame, numbers: DataFrame, by: list[str]) -> DataFrame:
    """Cells (by, year, board, bucket, n, m, known, q6, topics) of some questions; questions that come twice count twice.

    Rows without a bucket hold the counts; the others hold the bitmap of one bucket of topic numbers and no counts.
    """
    keys = list(dict.fromkeys([*by, "year", "board"]))
    counts = questions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("marks").alias("m"), F.count("marks").alias("known"),
        F.count_if(is_question6(F.col("question_number"))).alias("q6")).withColumns(
        {"bucket": F.lit(None).cast("long"), "topics": F.lit(None).cast("binary")})
    numbered = null_safe_join(by_topic(questions.select(*keys, "topics")).distinct(), numbers, ["topic"])
    bits = numbered.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("topics"))
    return counts.unionByName(bits, allowMissingColumns=True)


def overview_from_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """`stats.overview_stats` from any union of cells of one numbering."""
    per_bucket = cells.groupBy(*by, "bucket").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("known").alias("known"), F.sum("q6").alias("q6"),
        F.count_distinct(F.when(F.col("bucket").isNull(), F.col("year"))).alias("years"),
        F.count_distinct(F.when(F.col("bucket").isNull(), F.col("board"))).alias("boards"),
        F.bitmap_or_agg(F.col("topics")).alias("bits"))
    return per_bucket.groupBy(*by).agg(
        F.sum("n").alias("total_questions"), F.sum("m").alias("total_marks"), F.sum("known").alias("known_marks"), F.sum("q6").alias("q6_questions"),
        F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)).alias("topics"),
        F.max("years").alias("years"), F.max("boards").alias("boards")).select(
        *by, "total_questions", "total_marks", (F.col("total_questions") - F.col("q6_questions")).alias("q1to5_questions"), "q6_questions",
        "topics", "years", "boards", (F.col("total_marks") / F.col("total_questions")).alias("avg_marks"),
        (F.col("total_questions") - F.col("known_marks")).alias("n_unknown_marks")).filter("total_questions is not null")


def detail_cells(questions: DataFrame, by: list[str]) -> DataFrame:
    """Cells (by, topic, year, n, m) of some questions."""
    return by_topic(questions.select(*by, "year", "marks", "topics")).groupBy(*by, "topic", "year").agg(
        F.count("*").alias("n"), F.sum("marks").alias("m"))


def detail_from_cells(cells: DataFrame, by: list[str], min_questions: int = 5) -> DataFrame:
    """`stats.topic_detail` from any union of cells; a year that is in several of them counts once."""
    years = cells.groupBy(*by, "topic", "year").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return years.groupBy(*by, "topic").agg(F.sum("n").alias("questions"), F.sum("m").alias("total_marks"), F.count("*").alias("years")).filter(
        F.col("questions") >= min_questions).withColumn("avg_marks", F.col("total_marks") / F.col("questions"))


def write_cells(cells: DataFrame, path: str) -> None:
    """Adds cells to those stored by year at `path`."""
    cells.withColumn("cell_year", F.col("year")).write.mode("append").partitionBy("cell_year").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All stored cells; a filter on `cell_year` reads only its folders."""
    return spark.read.parquet(path)
