"""Schemas of the engine's tables. NULL stands for a missing year, paper or marks."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()),
])

PAGES_TEXT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("question_number", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("board", T.StringType()),
    T.StructField("qualification", T.StringType()),
    T.StructField("paper", T.StringType()),
    T.StructField("question_text", T.StringType()),
    T.StructField("marks", T.IntegerType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("question_file", T.StringType()),
    T.StructField("markscheme_file", T.StringType()),
    T.StructField("content_md5", T.StringType()),
    T.StructField("markscheme_md5", T.StringType()),
])

# Question bank JSON: one array of objects per file.
BANK_JSON = T.StructType([
    T.StructField("questionNumber", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("board", T.StringType()),
    T.StructField("questionText", T.StringType()),
    T.StructField("qualification", T.StringType()),
    T.StructField("marks", T.IntegerType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("questionFile", T.StringType()),
    T.StructField("markSchemeFile", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

TAXONOMY = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("ord", T.IntegerType()),
])

TAXONOMY_KEYWORDS = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("keyword", T.StringType()),
])

CONCEPTS = T.StructType([
    T.StructField("concept", T.StringType()),
    T.StructField("topic", T.StringType()),
])
