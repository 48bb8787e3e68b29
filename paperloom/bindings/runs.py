"""Whole runs over the test documents, read as exam papers and mark schemes."""

from paperloom import pipelines as pl
from paperloom.bindings import pages as pg
from paperloom.bindings import tables as t
from paperloom.operators.catalogue import parse_catalogue

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def document_files(spark, sf):
    """Every document as a file: papers and their schemes by turns, now and then a report; a few share a folder."""
    return parse_catalogue(t.table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('in/', doc_id) as path", """concat('economics_', case (doc_id div 450) % 2 when 0 then 'alevel' else 'as' end, '_',
         case (doc_id div 150) % 3 when 0 then 'edexcel' when 1 then 'aqa' else 'ocr' end, '_', 2000 + (doc_id div 2) % 25,
         case when doc_id % 20 = 7 then '' else concat('_paper', 1 + (doc_id div 2) % 3) end,
         case when doc_id % 20 = 7 then '_examinerreport' when doc_id % 2 = 0 then '_questionpaper' else '_markscheme' end, '.pdf') as name"""))


_BASE = t.EXAM_PAGES_SQL.replace("pages_text AS (", "exam_pages AS (") + """, cat AS (SELECT doc_id, 'in/' || doc_id AS path,
  CASE (doc_id // 450) % 2 WHEN 0 THEN 'alevel' ELSE 'as' END AS qualification,
  CASE (doc_id // 150) % 3 WHEN 0 THEN 'edexcel' WHEN 1 THEN 'aqa' ELSE 'ocr' END AS board,
  CAST(2000 + (doc_id // 2) % 25 AS VARCHAR) AS year, CAST(1 + (doc_id // 2) % 3 AS VARCHAR) AS paper,
  CASE WHEN doc_id % 20 = 7 THEN 'examinerreport' WHEN doc_id % 2 = 0 THEN 'questionpaper' ELSE 'markscheme' END AS doc_type FROM documents)"""


def _of_type(doc_type, phrases):
    said = " OR ".join(f"contains(lower(text), '{p}')" for p in phrases)
    return _BASE + f""", typed AS (SELECT e.*, paper FROM exam_pages e JOIN cat USING (doc_id) WHERE doc_type = '{doc_type}'),
 thirds AS (SELECT doc_id, coalesce(bool_or(page_no <= 3 AND ({said})), false) OR any_value(paper) = '3' AS third FROM typed GROUP BY doc_id)"""


# A section's id: four times the document's, 2 more in paper 3, 1 more in section B.
_SECTIONS = _of_type("questionpaper", ["paper 3", "paper three"]) + """, b AS (SELECT doc_id, min(page_no) AS start FROM typed
  WHERE contains(text, 'SECTION B') GROUP BY doc_id),
 pages_text AS (SELECT doc_id * 4 + CAST(third AS INTEGER) * 2 + CAST(coalesce(page_no >= start, false) AS INTEGER) AS doc_id, page_no, text
  FROM typed JOIN thirds USING (doc_id) LEFT JOIN b USING (doc_id) WHERE page_no >= 2 OR page_no >= start)"""
_SCHEMES = _of_type("markscheme", ["paper 3", "paper 03", "paper three"])


def _scheme_pages(third):
    return _SCHEMES + f", pages_text AS (SELECT doc_id, page_no, text FROM typed JOIN thirds USING (doc_id) WHERE {third})"


_EXTENDED = pg.EXTENDED_SQL.replace(t.EXAM_PAGES_SQL, _scheme_pages("third"))
_QUESTIONS = f"""{_BASE}, totals AS MATERIALIZED ({pg.ORACLE["find_questions_by_totals"].replace(t.EXAM_PAGES_SQL, _SECTIONS)}),
 parts AS MATERIALIZED ({pg.ORACLE["all_subquestions"].replace(t.EXAM_PAGES_SQL, _SECTIONS)}),
 ranges AS (SELECT doc_id // 4 AS doc_id, 'question' || number AS question_number, start_page, end_page FROM (
   SELECT doc_id, CAST(number AS VARCHAR) AS number, start_page, end_page FROM totals WHERE doc_id % 4 = 0
   UNION ALL SELECT doc_id, number || letter, start_page, end_page FROM parts
    WHERE number = CASE doc_id % 4 WHEN 1 THEN '6' WHEN 2 THEN '1' WHEN 3 THEN '2' END)
  QUALIFY row_number() OVER (PARTITION BY doc_id // 4, question_number ORDER BY end_page DESC, start_page DESC) = 1)"""
_RUN = _QUESTIONS + f""", grown_schemes AS MATERIALIZED (WITH {_EXTENDED} SELECT doc_id, key, start_page, end_page FROM extended),
 tables AS MATERIALIZED ({pg.ORACLE["group_question_pages"].replace(t.EXAM_PAGES_SQL, _scheme_pages("NOT third"))}),
 scheme_pages AS (SELECT doc_id, 'question' || key AS question_number, unnest(range(start_page, end_page + 1)) AS page_no FROM grown_schemes
  UNION ALL SELECT doc_id, 'question' || question, page_no FROM tables),
 q AS (SELECT r.doc_id, question_number, md5(string_agg(text, chr(10) ORDER BY page_no)) AS content_md5 FROM ranges r
  JOIN exam_pages e ON e.doc_id = r.doc_id AND page_no BETWEEN start_page AND end_page GROUP BY ALL),
 m AS (SELECT doc_id, question_number, md5(string_agg(text, chr(10) ORDER BY page_no)) AS markscheme_md5 FROM scheme_pages
  JOIN exam_pages USING (doc_id, page_no) GROUP BY ALL),
 qf AS (SELECT board, qualification, year, paper, question_number, path || '/' || question_number AS question_id, content_md5 FROM q JOIN cat USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY board, qualification, year, paper, question_number ORDER BY path || '/' || question_number) = 1),
 mf AS (SELECT board, qualification, year, paper, question_number, path || '/' || question_number AS markscheme_file, markscheme_md5 FROM m JOIN cat USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY board, qualification, year, paper, question_number ORDER BY path || '/' || question_number) = 1)
 SELECT * FROM qf JOIN mf USING (board, qualification, year, paper, question_number)"""


@query("question_ranges", f"WITH {_QUESTIONS} SELECT * FROM ranges")
def _(spark, sf):
    return pl.question_ranges(t.exam_pages(spark, sf), document_files(spark, sf))


@query("extract_all_questions", f"WITH {_RUN}")
def _(spark, sf):
    rows = pl.extract_all_questions(t.exam_pages(spark, sf), document_files(spark, sf))
    return rows.select("question_id", "question_number", "year", "board", "qualification", "paper", "markscheme_file", "content_md5", "markscheme_md5")
