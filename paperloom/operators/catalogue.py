"""File catalogue: parsed names, filled gaps, planned renames and their summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import names
from paperloom.functions.text import extract_json_object
from paperloom.plans.scale import first_per_key, stored_table

ENRICHMENT = ("topic string, qualification string, examBoard string, year string, "
              "paper string, documentType string")


def parse_catalogue(files: DataFrame) -> DataFrame:
    """Typed columns read from the `name` column; map-only."""
    name = F.col("name")
    return files.select(
        "*",
        names.is_canonical_name(name).alias("is_canonical"),
        names.extension(name).alias("extension"),
        names.subject(name).alias("topic"),
        names.qualification(name).alias("qualification"),
        names.exam_board(name).alias("board"),
        names.year(name).alias("year"),
        names.paper_number(name).alias("paper"),
        names.paper_is_invalid(name).alias("bad_paper"),
        names.document_type(name).alias("doc_type"))


def parse_enrichment(answers: DataFrame) -> DataFrame:
    """(path, answer text) -> (path, e_* columns): the JSON object in each answer, typed and normalised."""
    parsed = F.from_json(extract_json_object(F.col("answer")), ENRICHMENT)
    rows = answers.select("path", parsed.alias("j"))
    return rows.select(
        "path",
        F.regexp_replace(F.lower("j.topic"), "[^a-z0-9]", "").alias("e_topic"),
        names.normalize_enum(F.col("j.qualification"), "qualification").alias("e_qualification"),
        names.normalize_enum(F.col("j.examBoard"), "board").alias("e_board"),
        F.col("j.year").try_cast("int").alias("e_year"),
        F.regexp_replace("j.paper", "[^0-9]", "").try_cast("int").alias("e_paper"),
        names.normalize_enum(F.col("j.documentType"), "document_type").alias("e_doc_type"))


def fill_missing(files: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Only missing fields of files that are not canonical take the enrichment's values."""
    fields = ["topic", "qualification", "board", "year", "paper", "doc_type"]
    joined = files.join(enrichment, "path", "left")
    filled = {f: F.when(F.col("is_canonical"), F.col(f)).otherwise(F.coalesce(f, f"e_{f}"))
              for f in fields}
    return joined.withColumns(filled).drop(*[f"e_{f}" for f in fields])


def with_target_name(files: DataFrame) -> DataFrame:
    c = F.col
    parts = [c("topic"), c("qualification"), c("board"), c("year")]
    return files.withColumns({
        "is_complete": names.is_complete(*parts, c("doc_type")),
        "target": names.canonical_name(*parts, c("paper"), c("doc_type"), c("extension")),
    })


def resolve_name_collisions(files: DataFrame) -> DataFrame:
    """new_name: the target, with the md5 of the path added for all but one file of a folder's target.

    Every file of the folder claims its own name, whether it is renamed or not, so
    no existing file is overwritten; a name that no file has goes to the first
    path that wants it. The keeper of each name is an aggregate, folded map-side,
    and joined back by path and name: neither a target wanted by a large share of
    the files nor the lack of one makes a key that many rows share. Files without
    a target get no new name. The files are read three times here, so they are stored
    first and their names parsed once; the keepers are stored for the planner, which
    moves no file where few names are claimed.
    """
    files = stored_table(files)
    target, folder = F.col("target"), F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1)
    placed = files.withColumn("_folder", folder)
    wanted = placed.filter(target.isNotNull()).select("_folder", "target", "path", (F.col("name") != target).alias("late"))
    claims = wanted.unionByName(placed.select("_folder", F.col("name").alias("target"), "path", F.lit(False).alias("late")))
    keepers = stored_table(first_per_key(claims, ["_folder", "target"], [F.col("late"), F.col("path")]).select(
        "path", "target", F.lit(True).alias("keeps")))
    unique = F.concat(names.stem(target), F.lit("_"), F.md5("path"), names.extension(target))
    return files.join(keepers, ["path", "target"], "left").withColumn("new_name", F.when(F.col("keeps"), target).otherwise(unique)).drop("keeps")


def file_actions(files: DataFrame) -> DataFrame:
    """One action per parsed (and filled) file: skipped, moved or renamed, with the reason."""
    targeted = with_target_name(files)
    renames = ~F.col("is_canonical") & ~F.col("bad_paper") & F.col("is_complete")
    resolved = resolve_name_collisions(targeted.withColumn("target", F.when(renames, F.col("target"))))
    same = F.col("new_name") == F.col("name")
    rules = [
        (F.col("is_canonical"), F.lit("skipped"), F.lit("Already correctly formatted"), F.col("name")),
        (F.col("bad_paper"), F.lit("moved"), F.lit("Paper number is not numeric"), F.lit(None)),
        (~F.col("is_complete"), F.lit("moved"), F.lit("Missing required information"), F.lit(None)),
        (same, F.lit("skipped"), F.lit("New filename same as old"), F.col("name")),
        (F.lit(True), F.lit("renamed"), F.lit("Successfully renamed"), F.col("new_name")),
    ]

    def pick(i):
        return names.first_case([(r[0], r[i]) for r in rules])

    return resolved.select("path", F.col("name").alias("original_name"), pick(3).alias("new_name"),
                           pick(1).alias("status"), pick(2).alias("message"))


def catalogue_summary(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count("*").alias("processed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("skipped", "renamed", "moved")])
