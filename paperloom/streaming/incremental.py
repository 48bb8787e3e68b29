"""Bank files tagged as they arrive.

The batch rule "skip a year whose output exists" becomes a file-source stream:
its checkpoint remembers the files already read, so each run tags new files only.
`tag_each_question_once` also remembers the questions, as keyed state, so that one
that comes again in a later file is not tagged again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions.text import clean_text
from paperloom.operators.labels import assign_topics
from paperloom.schemas import BANK_JSON
from paperloom.sources.bank import bank_to_questions, write_question_bank


def tag_new_bank_files(spark: SparkSession, source: str, target: str, checkpoint: str, topics: DataFrame,
                       keywords: DataFrame, concepts: DataFrame, suggestions: DataFrame) -> StreamingQuery:
    """Tags the untagged questions of new bank files and appends all of them to the bank at `target`.

    Reads what is there and stops; run it again for later files. Each batch owns
    one folder and overwrites it, so a batch retried after a failure leaves no
    second copy.
    """
    rows = spark.readStream.schema(BANK_JSON).option("multiLine", True).option(
        "columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").json(source)
    questions = bank_to_questions(rows)

    def store(batch: DataFrame, epoch: int) -> None:
        usable = batch.filter("reject is null").drop("reject").withColumn("question_text", clean_text(batch.question_text))
        distinct = usable.dropDuplicates(["question_id"])
        tagged = assign_topics(distinct, topics, keywords, concepts, suggestions).select(
            "question_id", F.col("topics").alias("assigned"))
        merged = usable.join(tagged, "question_id", "left").withColumn("topics", F.coalesce("assigned", "topics"))
        write_question_bank(merged, f"{target}/epoch={epoch}", mode="overwrite")

    return (questions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def tag_each_question_once(spark: SparkSession, source: str, target: str, checkpoint: str, topics: DataFrame, keywords: DataFrame,
                           concepts: DataFrame, suggestions: DataFrame, lines: bool = True) -> StreamingQuery:
    """Appends (question_id, question_file, topics, method) of each question of the bank once, whatever files and runs it comes in.

    The ids seen so far are the stream's state, kept by key under the checkpoint and carried from run to run; an id holds
    the md5 of its text, so its copies are tagged alike and the first to come is as good as any. For a large bank, let
    the session keep the state in RocksDB. Reads what is there and stops. Each batch owns one folder and overwrites it, so a
    batch retried after a failure leaves no second copy. Rows that cannot be used and questions without a text are left
    out. `lines` says that files hold an object per line, not one array; files may be compressed by gzip.
    """
    rows = (spark.readStream.schema(BANK_JSON).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("pathGlobFilter", "{*.json,*.json.gz}").json(source))
    usable = bank_to_questions(rows).filter("reject is null").select(
        "question_id", "question_file", clean_text(F.col("question_text")).alias("question_text"), F.lit(None).cast("array<string>").alias("topics"))
    firsts = usable.dropDuplicates(["question_id"])

    def store(batch: DataFrame, epoch: int) -> None:
        tagged = assign_topics(batch, topics, keywords, concepts, suggestions, carried=("question_file",))
        tagged.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/epoch={epoch}")

    return firsts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
