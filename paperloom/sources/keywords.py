"""Dictionary tables of the tagging step, given as files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.schemas import CONCEPTS, TAXONOMY_KEYWORDS


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(topic, keyword) from JSON lines of the form {"topic": ..., "keywords": [...]}."""
    rows = spark.read.schema("topic string, keywords array<string>").json(path)
    return rows.select("topic", F.explode("keywords").alias("keyword")).to(TAXONOMY_KEYWORDS)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(concept, topic) from JSON lines of the form {"concept": ..., "topics": [...]}."""
    rows = spark.read.schema("concept string, topics array<string>").json(path)
    return rows.select("concept", F.explode("topics").alias("topic")).to(CONCEPTS)
