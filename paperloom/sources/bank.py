"""The question bank (JSON or Parquet, by year) and the topic overview files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.names import BOARDS, normalize_enum
from paperloom.plans.scale import null_safe_join
from paperloom.schemas import BANK_JSON
from paperloom.sources.jsonarray import WHOLE, read_json_arrays


def bank_to_questions(rows: DataFrame) -> DataFrame:
    """Bank rows in engine columns, with `reject` naming why a row cannot be used (else NULL).

    The paper is the folder of the question file. Content hashes are unknown
    here; join them from `sources.files.content_hashes` when files are at hand.
    """
    board = F.lower("board")
    qualification = normalize_enum(F.coalesce("qualification", F.lit("unknown")), "qualification")
    reject = (F.when(F.col("_corrupt_record").isNotNull(), "not JSON")
              .when(F.col("questionNumber").isNull(), "no question number")
              .when(F.col("year").isNull(), "no year")
              .when(qualification.isNull(), "unknown qualification"))
    return rows.select(
        F.concat_ws("/", "year", "board", "qualification", "questionFile", "questionNumber",
                    F.md5(F.coalesce("questionText", F.lit("")))).alias("question_id"),
        F.col("questionNumber").alias("question_number"), "year",
        F.when(board.isin(BOARDS), board).otherwise("unknown").alias("board"),
        qualification.alias("qualification"), parent_folder(F.col("questionFile")).alias("paper"),
        F.coalesce("questionText", F.lit("")).alias("question_text"), "marks", "topics",
        F.col("questionFile").alias("question_file"), F.col("markSchemeFile").alias("markscheme_file"),
        reject.alias("reject"))


def parent_folder(path: Column) -> Column:
    return F.try_element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.lit(-2))


def read_question_bank(spark: SparkSession, path: str, recursive: bool = False,
                       glob: str = "*.json", whole_up_to: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(questions, rejected rows) of a folder's bank files, with `recursive` also of the folders below.

    A bad row does not fail the load. Each file holds one JSON array; an array of more than `whole_up_to` bytes is read by
    many tasks (`sources/jsonarray.py`).
    """
    rows = read_json_arrays(spark, path, BANK_JSON, recursive, glob, whole_up_to)
    parsed = bank_to_questions(rows)
    return parsed.filter(F.col("reject").isNull()).drop("reject"), parsed.filter(F.col("reject").isNotNull())


def questions_to_bank(questions: DataFrame) -> DataFrame:
    """Engine columns under the bank's names; topics are never NULL."""
    return questions.select(
        F.col("question_number").alias("questionNumber"), "year", F.upper("board").alias("board"),
        F.col("question_text").alias("questionText"), "qualification", "marks",
        F.coalesce("topics", F.expr("cast(array() as array<string>)")).alias("topics"),
        F.col("question_file").alias("questionFile"), F.col("markscheme_file").alias("markSchemeFile"))


def write_question_bank(questions: DataFrame, path: str, fmt: str = "json", mode: str = "append",
                        max_records: int = 1_000_000) -> None:
    """The bank partitioned by year, one JSON object per line, compressed by gzip (or Parquet).

    The year is kept inside the records as well. Files are cut at `max_records`
    rows, so a year holding much of the data is written by many tasks and, as a
    compressed file has one reader, read by many.
    """
    bank = questions_to_bank(questions).withColumn("bank_year", F.col("year"))
    writer = bank.write.mode(mode).partitionBy("bank_year").option("maxRecordsPerFile", max_records)
    if fmt == "json":  # names and paths repeat: a tenth of the bytes
        writer = writer.option("compression", "gzip")
    writer.format(fmt).save(path)


def read_written_bank(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A bank written by `write_question_bank`; year filters prune its folders."""
    columns = [f for f in BANK_JSON.fields if f.name != "_corrupt_record"]
    reader = spark.read.schema(type(BANK_JSON)(columns))
    # The folder's year is the record's, so a filter on `year` prunes folders.
    rows = reader.format(fmt).load(path).withColumns(
        {"year": F.col("bank_year").cast("string"), "_corrupt_record": F.lit(None).cast("string")})
    return bank_to_questions(rows).drop("reject")


def only_new_partitions(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those already written."""
    return null_safe_join(df, existing.select(*keys).distinct(), keys, "left_anti")


def overview_lines(overview: DataFrame) -> DataFrame:
    """(qualification, topic, line): the report line of each topic."""
    line = F.format_string("%-50s | %3d questions | %4d total marks", "topic", "questions",
                           F.coalesce("total_marks", F.lit(0)))
    return overview.select("qualification", "theme", "topic", "total_topics", line.alias("line"))


def write_topic_overview(overview: DataFrame, path: str) -> None:
    """One folder of report lines per qualification, sorted by topic inside each file.

    The header line of each qualification gives its number of topics.
    """
    lines = overview_lines(overview)
    heads = lines.select("qualification", "total_topics").distinct().select(
        "qualification", F.lit("").alias("topic"),
        F.concat(F.lit("=== "), F.upper("qualification"), F.lit(" TOPIC OVERVIEW === Total topics: "),
                 F.col("total_topics").cast("string")).alias("line"))
    (heads.unionByName(lines.select("qualification", "topic", "line")).repartition("qualification")
     .sortWithinPartitions("qualification", "topic").select("qualification", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("qualification").text(path))
