"""Files that hold one large JSON array, read by as many tasks as their bytes ask for.

Spark reads a multi-line JSON file in one task. Here the file is read as text cut at every closing brace, which Spark can
split anywhere. Whether a brace lies inside a string, and how deep it is, depends on all text before it; both are running
totals, scanned inside blocks and carried from block to block in one row for each, so no task reads a file from its start.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.plans.scale import stored_table

LONGEST = 1 << 28
#: Bytes of a usual split.
WHOLE = 1 << 27
CORRUPT = "_corrupt_record"
_PLACE = ["_file", "_block", "_at"]


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _opened(text: Column) -> Column:
    """Opening braces outside strings, for a text that starts outside one."""
    return _count(F.regexp_replace(text, r'"[^"]*+("|\z)', ""), "{")


def _pieces(spark: SparkSession, path: str, recursive: bool, glob: str, above: int) -> DataFrame:
    """(file, block, at, value): the text before each closing brace in files of more than `above` bytes. `at` orders a block's pieces."""
    return (spark.read.option("lineSep", "}").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(path)
            .filter(F.col("_metadata.file_size") > above).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_at"), "value"))


def _placed(pieces: DataFrame) -> DataFrame:
    """The pieces with the braces they open, the depth before them, whether an outermost object ends with them, and its name.

    Texts move once, to the task of their block. There both cases are scanned, that the block starts outside a string and
    inside one; a row for each block then tells which holds, how deep it starts and where the last object before it ended.
    """
    spot = ["_file", "_block"]
    here = Window.partitionBy(*spot).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def before(value: Column, window) -> Column:
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    bare = F.regexp_replace("value", r"(?s)\\.", "")
    rows = pieces.withColumn("b", bare).select(
        *_PLACE, "value", _count(F.col("b"), '"').alias("quotes"), _opened(F.col("b")).alias("outside"),
        _opened(F.concat(F.lit('"'), F.col("b"))).alias("inside")).withColumn("said", before(F.col("quotes"), here))
    for case in (0, 1):
        opens = F.when((F.col("said") + case) % 2 == 1, F.col("inside")).otherwise(F.col("outside"))
        ends_inside = ((F.col("said") + F.col("quotes") + case) % 2).cast("int")
        rows = rows.withColumns({f"opens{case}": opens, f"inside{case}": ends_inside, f"step{case}": opens - 1 + ends_inside})
    rows = rows.withColumns({f"deep{case}": before(F.col(f"step{case}"), here) for case in (0, 1)})
    blocks = rows.groupBy(*spot).agg(*[F.sum(c).alias(c) for c in ("quotes", "step0", "step1")])
    blocks = blocks.withColumn("case", before(F.col("quotes"), across) % 2)
    starts = blocks.withColumn("start", before(F.when(F.col("case") == 1, F.col("step1")).otherwise(F.col("step0")), across))

    def held(name: str) -> Column:
        return F.when(F.col("case") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    known = rows.join(starts.select(*spot, "case", "start"), spot).select(
        *_PLACE, "value", held("opens").alias("opens"), (F.col("start") + held("deep")).alias("depth"), held("inside").alias("in_string"))
    known = known.withColumn("ends", (F.col("in_string") == 0) & (F.col("depth") + F.col("opens") <= 1))
    known = known.withColumn("done", before(F.col("ends").cast("int"), here))
    ended = known.groupBy(*spot).agg(F.sum(F.col("ends").cast("int")).alias("all"))
    last = F.last(F.when(F.col("all") > 0, F.struct("_block", F.col("all").alias("n"))), ignorenulls=True).over(across)
    first = F.struct(F.lit(-1).cast("long").alias("_block"), F.lit(0).cast("long").alias("n"))
    named = known.join(ended.select(*spot, F.coalesce(last, first).alias("last")), spot)
    return named.withColumn("object", F.when(F.col("done") > 0, F.struct("_block", F.col("done").alias("n"))).otherwise(F.col("last")))


def json_object_texts(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.json",
                      longest: int = LONGEST, above: int = 0) -> DataFrame:
    """(file, text): every outermost object of the files, and whatever else than brackets and commas stands between them.

    Nearly all objects are one piece and stay where they are; the pieces of objects with braces in strings or with objects
    inside are stored and put together by file and object. A file with an unbalanced quote can seem to hold an object
    without end: texts of more than `longest` characters come back as an error text. A file whose last closing brace is
    missing is read as if it were there. An empty file or array gives no row.
    """
    placed = _placed(_pieces(spark, path, recursive, glob, above))
    outer = F.col("depth") <= 0
    between, whole = outer & (F.col("opens") == 0), outer & F.col("ends") & (F.col("opens") > 0)
    trimmed = F.regexp_replace("value", r"^[\s,\[\]\x{FEFF}]+", "")
    text = F.when(whole, F.concat(trimmed, F.lit("}"))).otherwise(trimmed)
    single = placed.filter(whole | between).select(F.col("_file").alias("file"), text.alias("text")).filter("text <> ''")
    parts = stored_table(placed.filter(~(whole | between)).select("_file", "object", "_block", "_at", "value"))
    sizes = parts.groupBy("_file", "object").agg(F.sum(F.length("value") + 1).alias("size"))
    over = sizes.filter(F.col("size") > longest)
    bounded = parts.join(over, ["_file", "object"], "left_anti").groupBy("_file", "object").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))).alias("parts"))
    joined = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    many = bounded.select(F.col("_file").alias("file"), F.regexp_replace(joined, r"^[\s,\[\]\x{FEFF}]+", "").alias("text"))
    long = over.select(F.col("_file").alias("file"), F.format_string("object of %d characters", "size").alias("text"))
    return single.unionByName(many).unionByName(long)


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType, recursive: bool = False, glob: str = "*.json",
                     whole_up_to: int = WHOLE) -> DataFrame:
    """The objects of the files in the columns of `schema`; a text that is none fills only `_corrupt_record`, if the schema has it.

    Files of at most `whole_up_to` bytes, which one task would read in any case, go through Spark's multi-line reader: well
    formed files give the same rows, a malformed one is a corrupt record as a whole and not object by object.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    size = F.col("_metadata.file_size")
    whole = (spark.read.schema(schema).options(multiLine=True, pathGlobFilter=glob, recursiveFileLookup=recursive, **options).json(path)
             .filter(size <= whole_up_to).select(*schema.names))
    texts = json_object_texts(spark, path, recursive, glob, above=whole_up_to)
    return whole.unionByName(texts.select(F.from_json("text", schema, options).alias("row")).select("row.*"))
