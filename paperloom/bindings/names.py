"""Catalogue queries over file names (B) and files (A)."""

from pyspark.sql import functions as F

from paperloom.bindings import tables as t
from paperloom.functions import names
from paperloom.functions.text import extract_json_array, extract_json_object, json_array_items, preview_text
from paperloom.operators import catalogue as cat
from paperloom.plans.scale import scratch_folder
from paperloom.sources.files import scan_files

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


_STEM = "CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END"
_EXT = "regexp_extract(name, '^.+(\\.[^.]*)$', 1)"
_PAPER = r"'(?i)(?:paper|p)[\s_-]*(\d+)|paper[\s_-]*([a-z0-9]+)'"
_PTOKEN = (f"CASE WHEN regexp_extract(name, {_PAPER}, 1) <> '' THEN regexp_extract(name, {_PAPER}, 1) "
           f"WHEN regexp_extract(name, {_PAPER}, 2) <> '' THEN regexp_extract(name, {_PAPER}, 2) END")
_TOKENS = f"string_split(regexp_replace(lower({_STEM}), '[^a-z0-9]', '_', 'g'), '_')"
_DOC = r"""CASE WHEN contains(lower(name), ' ms ') OR contains(lower(name), 'markscheme') OR contains(lower(name), 'mark scheme')
   THEN 'markscheme'
  WHEN contains(lower(name), ' qp ') OR contains(lower(name), 'questionpaper') OR contains(lower(name), 'question paper')
   THEN 'questionpaper'
  WHEN regexp_matches(lower(name), 'mark|scheme|ms|solution|answers') THEN 'markscheme'
  WHEN regexp_matches(lower(name), 'question|paper|qp|\bq\b') THEN 'questionpaper'
  WHEN regexp_matches(lower(name), 'examiner|report|er') THEN 'examinerreport' END"""


def _first_token(listed):
    return f"([x FOR x IN {_TOKENS} IF x IN ({', '.join(repr(x) for x in listed)})])[1]"


_BOARD = (f"CASE {_first_token(names.BOARDS + ['cie', 'caie', 'pearsonedexcel'])} WHEN 'cie' THEN 'cambridge' WHEN 'caie' "
          f"THEN 'cambridge' WHEN 'pearsonedexcel' THEN 'edexcel' ELSE {_first_token(names.BOARDS)} END")
_QUAL = (f"CASE WHEN contains(lower(name), 'as-level') OR contains(lower(name), 'as level') THEN 'as' "
         f"WHEN contains(lower(name), 'a-level') OR contains(lower(name), 'a level') THEN 'alevel' "
         f"WHEN {_first_token(names.QUALIFICATIONS + ['gce'])} = 'gce' THEN 'alevel' "
         f"ELSE {_first_token(names.QUALIFICATIONS + ['gce'])} END")
_SUBJECT = (f"coalesce({_first_token(names.SUBJECTS)}, CASE " + " ".join(
    f"WHEN contains(lower(name), '{f}') THEN '{s}'" for f, s in names.SUBJECT_FRAGMENTS) + " END)")
_CANON = (r"regexp_matches(name, '(?i)^[a-z0-9]+_[a-z0-9]+_[a-z0-9]+_\d{4}(_paper\d+)?"
          r"_(?:questionpaper|markscheme|examinerreport)\.[a-z0-9]+$')")
PARSED_SQL = t.FILES_SQL + f""", parsed AS (
 SELECT path, name, {_CANON} AS is_canonical, {_EXT} AS extension, {_SUBJECT} AS topic, {_QUAL} AS qualification,
  {_BOARD} AS board, TRY_CAST(regexp_extract(name, '(?:19|20)\\d{{2}}', 0) AS INTEGER) AS year,
  TRY_CAST({_PTOKEN} AS INTEGER) AS paper,
  ({_PTOKEN}) IS NOT NULL AND TRY_CAST({_PTOKEN} AS INTEGER) IS NULL AS bad_paper, {_DOC} AS doc_type FROM files)"""
FILLED_SQL = PARSED_SQL + ", " + t.ANSWERS_SQL + """, filled AS (
 SELECT p.path, name, is_canonical, extension, bad_paper,
  CASE WHEN is_canonical THEN topic ELSE coalesce(topic, e_topic) END AS topic,
  CASE WHEN is_canonical THEN qualification ELSE coalesce(qualification, e_qualification) END AS qualification,
  CASE WHEN is_canonical THEN board ELSE coalesce(board, e_board) END AS board,
  CASE WHEN is_canonical THEN year ELSE coalesce(year, e_year) END AS year,
  CASE WHEN is_canonical THEN paper ELSE coalesce(paper, e_paper) END AS paper,
  CASE WHEN is_canonical THEN doc_type ELSE coalesce(doc_type, e_doc_type) END AS doc_type
 FROM parsed p LEFT JOIN answers USING (path))"""
_COMPLETE = ("topic IS NOT NULL AND qualification IS NOT NULL AND board IS NOT NULL AND coalesce(year, 0) > 0 "
             "AND doc_type IS NOT NULL")
_TARGET = ("coalesce(topic, 'unknown') || '_' || coalesce(qualification, 'unknown') || '_' || coalesce(board, 'unknown') "
           "|| '_' || coalesce(year, 0) || CASE WHEN paper > 0 THEN '_paper' || paper ELSE '' END || '_' || "
           "coalesce(doc_type, 'unknown') || extension")
TARGET_SQL = FILLED_SQL + f", targeted AS (SELECT *, {_COMPLETE} AS is_complete, {_TARGET} AS target FROM filled)"
ACTIONS_SQL = TARGET_SQL + """, renames AS (
 SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM targeted
 WHERE NOT is_canonical AND NOT bad_paper AND is_complete),
claims AS (SELECT folder, target, path, name <> target AS late FROM renames
 UNION ALL SELECT regexp_extract(path, '^(.*)/[^/]*$', 1), name, path, false FROM targeted),
keepers AS (SELECT folder, target, path AS keeper FROM claims
 QUALIFY row_number() OVER (PARTITION BY folder, target ORDER BY late, path) = 1),
named AS (
 SELECT path, name, CASE WHEN path = keeper THEN target ELSE
  regexp_replace(target, '\\.[^.]*$', '') || '_' || md5(path) || regexp_extract(target, '(\\.[^.]*)$', 1) END AS new_name
 FROM renames JOIN keepers USING (folder, target)),
actions AS (
 SELECT f.path, f.name AS original_name,
  CASE WHEN is_canonical THEN f.name WHEN bad_paper OR NOT is_complete THEN NULL ELSE new_name END AS new_name,
  CASE WHEN is_canonical THEN 'skipped' WHEN bad_paper OR NOT is_complete THEN 'moved'
   WHEN new_name = f.name THEN 'skipped' ELSE 'renamed' END AS status,
  CASE WHEN is_canonical THEN 'Already correctly formatted' WHEN bad_paper THEN 'Paper number is not numeric'
   WHEN NOT is_complete THEN 'Missing required information' WHEN new_name = f.name THEN 'New filename same as old'
   ELSE 'Successfully renamed' END AS message
 FROM targeted f LEFT JOIN named USING (path))"""


def _parsed(spark, sf):
    return cat.parse_catalogue(t.files(spark, sf))


def _filled(spark, sf):
    return cat.fill_missing(_parsed(spark, sf), cat.parse_enrichment(t.answers(spark, sf)))


def _column(sql_name, alias=None):
    return f"WITH {PARSED_SQL} SELECT path, {sql_name}{' AS ' + alias if alias else ''} FROM parsed"


@query("canonical_name_test", _column("is_canonical"))
def _(spark, sf):
    return t.files(spark, sf).select("path", names.is_canonical_name(F.col("name")).alias("is_canonical"))


@query("split_extension", f"WITH {t.FILES_SQL} SELECT path, {_EXT} AS extension, {_STEM} AS stem FROM files")
def _(spark, sf):
    name = F.col("name")
    return t.files(spark, sf).select("path", names.extension(name).alias("extension"), names.stem(name).alias("stem"))


@query("parse_paper_number", f"WITH {PARSED_SQL} SELECT path, paper, bad_paper FROM parsed")
def _(spark, sf):
    name = F.col("name")
    return t.files(spark, sf).select("path", names.paper_number(name).alias("paper"),
                                     names.paper_is_invalid(name).alias("bad_paper"))


for _name, _fn, _col in [("parse_document_type", names.document_type, "doc_type"), ("parse_year", names.year, "year"),
                         ("parse_exam_board", names.exam_board, "board"),
                         ("parse_qualification", names.qualification, "qualification"),
                         ("parse_subject", names.subject, "topic")]:
    query(_name, _column(_col))(
        lambda spark, sf, fn=_fn, col=_col: t.files(spark, sf).select("path", fn(F.col("name")).alias(col)))

_SPELLED = """CASE o_custkey % 9 WHEN 0 THEN 'CAIE' WHEN 1 THEN 'Pearson Edexcel' WHEN 2 THEN 'GCE' WHEN 3 THEN 'AS Level'
 WHEN 4 THEN 'Mark scheme ' || o_orderkey WHEN 5 THEN 'QP' WHEN 6 THEN 'the examinerreport' WHEN 7 THEN 'ib'
 ELSE 'Examiner Report' END"""


@query("normalize_enum", f"""WITH s AS (SELECT o_orderkey, lower({_SPELLED}) AS s FROM orders)
 SELECT o_orderkey, CASE s WHEN 'caie' THEN 'cambridge' WHEN 'pearson edexcel' THEN 'edexcel' WHEN 'ib' THEN 'ib' END AS board,
  CASE s WHEN 'gce' THEN 'alevel' WHEN 'as level' THEN 'as' WHEN 'ib' THEN 'ib' END AS qualification,
  CASE WHEN s = 'qp' THEN 'questionpaper' WHEN contains(s, 'examinerreport') THEN 'examinerreport'
   WHEN contains(s, 'mark') THEN 'markscheme' WHEN contains(s, 'report') THEN 'examinerreport' END AS doc_type FROM s""")
def _(spark, sf):
    rows = t.table(spark, sf, "orders").selectExpr("o_orderkey", f"{_SPELLED} as s")
    return rows.select("o_orderkey", names.normalize_enum(F.col("s"), "board").alias("board"),
                       names.normalize_enum(F.col("s"), "qualification").alias("qualification"),
                       names.normalize_enum(F.col("s"), "document_type").alias("doc_type"))


@query("is_complete", f"WITH {PARSED_SQL} SELECT path, {_COMPLETE} AS is_complete FROM parsed")
def _(spark, sf):
    return cat.with_target_name(_parsed(spark, sf)).select("path", "is_complete")


@query("fill_missing", f"WITH {FILLED_SQL} SELECT path, topic, qualification, board, year, paper, doc_type FROM filled")
def _(spark, sf):
    return _filled(spark, sf).select("path", "topic", "qualification", "board", "year", "paper", "doc_type")


_ANSWER = """'Sure: {"a": ' || o_custkey || ', "b": {"c": "' || o_orderpriority || '"}} and ["x", "' || o_orderkey || '"] ok'"""


@query("extract_json", f"""WITH a AS (SELECT o_orderkey, {_ANSWER} AS answer FROM orders)
 SELECT o_orderkey, regexp_extract(answer, '(?s)\\{{.*\\}}', 0) AS object,
  CAST(json_extract(regexp_extract(answer, '(?s)\\{{.*\\}}', 0), '$.a') AS BIGINT) AS a,
  regexp_extract(answer, '(?s)\\[.*\\]', 0) AS array_text, CAST(o_orderkey AS VARCHAR) AS second FROM a""")
def _(spark, sf):
    rows = t.table(spark, sf, "orders").selectExpr("o_orderkey", f"{_ANSWER} as answer")
    answer = F.col("answer")
    return rows.select("o_orderkey", extract_json_object(answer).alias("object"),
                       F.get_json_object(extract_json_object(answer), "$.a").cast("long").alias("a"),
                       extract_json_array(answer).alias("array_text"),
                       F.get(json_array_items(answer), 1).alias("second"))


@query("canonical_name", f"WITH {TARGET_SQL} SELECT path, target FROM targeted")
def _(spark, sf):
    return cat.with_target_name(_filled(spark, sf)).select("path", "target")


@query("resolve_name_collisions", f"WITH {ACTIONS_SQL} SELECT path, new_name FROM named")
def _(spark, sf):
    renamed = F.expr("not is_canonical and not bad_paper and is_complete")
    targeted = cat.with_target_name(_filled(spark, sf)).withColumn("target", F.when(renamed, F.col("target")))
    return cat.resolve_name_collisions(targeted).filter("target is not null").select("path", "new_name")


@query("file_actions", f"WITH {ACTIONS_SQL} SELECT * FROM actions")
def _(spark, sf):
    return cat.file_actions(_filled(spark, sf))


@query("catalogue_summary", f"""WITH {ACTIONS_SQL} SELECT count(*) AS processed,
 count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'renamed') AS renamed,
 count(*) FILTER (status = 'moved') AS moved FROM actions""")
def _(spark, sf):
    return cat.catalogue_summary(cat.file_actions(_filled(spark, sf)))


@query("preview_text", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN
  CASE WHEN length(html) > 1000 THEN substr(html, 1, 1000) || '...' ELSE html END
  ELSE 'File type ' || CASE page_id % 3 WHEN 1 THEN 'pdf' ELSE 'docx' END || ' - content extraction not implemented' END
  AS preview FROM pages""")
def _(spark, sf):
    extension = F.expr("case page_id % 3 when 0 then '.HTML' when 1 then '.pdf' else 'DOCX' end")
    return t.table(spark, sf, "pages").select("page_id", preview_text(F.col("html"), extension).alias("preview"))


def _folder():
    return F.regexp_extract("path", r"part=(\d+)/[^/]*$", 1).alias("part")


def _page_files(spark, sf):
    """Pages as text files, in a folder for each last digit of their number."""
    folder = scratch_folder(spark)
    t.table(spark, sf, "pages").selectExpr("page_id % 10 as part", "coalesce(html, '') as value").write.partitionBy("part").text(folder)
    return folder


@query("scan_files", """SELECT CAST(page_id % 10 AS VARCHAR) AS part, CAST(sum(strlen(coalesce(html, '')) + 1) AS BIGINT) AS bytes
 FROM pages GROUP BY 1""")
def _(spark, sf):
    """All text files below a folder."""
    files = scan_files(spark, _page_files(spark, sf), "TXT", recursive=True)
    return files.groupBy(_folder()).agg(F.sum("size").alias("bytes"))


@query("scan_files_of_folder", """SELECT '3' AS part, CAST(sum(strlen(coalesce(html, '')) + 1) AS BIGINT) AS bytes FROM pages
 WHERE page_id % 10 = 3""")
def _(spark, sf):
    """Text files of one folder; the folder above has none of its own."""
    folder = _page_files(spark, sf)
    own = scan_files(spark, f"{folder}/part=3", "txt")
    return own.groupBy(_folder()).agg(F.sum("size").alias("bytes"))
