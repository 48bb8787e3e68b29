"""Files of a folder: names, content hashes and text previews."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.names import extension
from paperloom.functions.text import PREVIEW_EXTENSIONS, preview_text

UNCATEGORIZED = "uncategorized"


def _glob(extension: str | None) -> str:
    """Glob matching one extension in any case."""
    if not extension:
        return "*"
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension.lstrip("."))


def scan_files(spark: SparkSession, path: str, extension: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, name, size) of the visible files, contents not read.

    Files in an "uncategorized" folder are left out.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _glob(extension))
    files = reader.option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.substring_index("path", "/", -1)
    folder = F.element_at(F.split("path", "/"), F.lit(-2))
    return files.select("path", name.alias("name"), F.col("length").alias("size")).filter(
        ~F.col("name").startswith(".") & (folder != UNCATEGORIZED))


def content_hashes(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """(path, content_md5) of all files below the folder."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _glob(extension))
    return reader.option("recursiveFileLookup", "true").load(path).select("path", F.md5("content").alias("content_md5"))


def read_previews(spark: SparkSession, path: str, n: int = 1000) -> DataFrame:
    """(path, preview): the first n characters of text files, a notice for the others.

    Only files with a text extension are opened.
    """
    scanned = scan_files(spark, path)
    listed = scanned.withColumn("extension", F.lower(F.regexp_replace(extension(F.col("name")), r"^\.", "")))
    texts = spark.read.format("binaryFile").option(
        "pathGlobFilter", "*.{" + ",".join(PREVIEW_EXTENSIONS) + "}").load(path).select(
        "path", F.decode("content", "UTF-8").alias("text"))
    return listed.join(texts, "path", "left").select(
        "path", preview_text(F.col("text"), F.col("extension"), n).alias("preview"))
