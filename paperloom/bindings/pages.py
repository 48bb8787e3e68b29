"""Segmentation queries (D) over exam pages cut from documents."""

from pyspark.sql import functions as F

from paperloom.bindings import tables as t
from paperloom.operators import segment as sg

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


P = t.EXAM_PAGES_SQL
_TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def trim_sql(expr):
    return _TRIM.format(expr)


def _any(expr, phrases):
    return "(" + " OR ".join(f"contains({expr}, '{p}')" for p in phrases) + ")"


@query("flag_paper3", f"""WITH {P}, said AS (SELECT doc_id, bool_or({_any('lower(text)', sg.PAPER3_MARKSCHEMES)}) AS said
 FROM pages_text WHERE page_no <= 3 GROUP BY doc_id)
 SELECT doc_id, said OR n_chars % 4 = 3 AS is_paper3 FROM said JOIN documents USING (doc_id)""")
def _(spark, sf):
    return sg.flag_paper3(t.exam_pages(spark, sf), t.paper_numbers(spark, sf), sg.PAPER3_MARKSCHEMES)


@query("split_sections", f"""WITH {P}, s AS (SELECT doc_id, min(page_no) AS start FROM pages_text WHERE contains(text, 'SECTION B')
 GROUP BY doc_id), x AS (SELECT p.doc_id, page_no, CASE WHEN page_no >= start THEN 'B' WHEN page_no >= 2 THEN 'A' END AS section
 FROM pages_text p LEFT JOIN s USING (doc_id)) SELECT * FROM x WHERE section IS NOT NULL""")
def _(spark, sf):
    return sg.split_sections(t.exam_pages(spark, sf))


_LINES = """, line_rows AS (SELECT doc_id, page_no, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
 FROM (SELECT doc_id, page_no, regexp_split_to_array(text, '\\r?\\n') AS l FROM pages_text))"""


@query("find_questions_by_totals", f"""WITH {P}{_LINES}, items AS (
  SELECT doc_id, page_no, line_no, 0 AS idx, regexp_extract(line, '^\\s*(\\d+)(\\s|$)', 1) AS number, false AS is_end FROM line_rows
   WHERE regexp_matches(line, '^\\s*(\\d+)(\\s|$)')
  UNION ALL SELECT doc_id, page_no, line_no, generate_subscripts(n, 1), unnest(n), true FROM (
   SELECT *, regexp_extract_all(line, '{sg.TOTAL}', 1) AS n FROM line_rows)),
 pos AS (SELECT *, page_no * 1000000 + line_no * 1000 + idx AS p FROM items),
 nxt AS (SELECT *, min(CASE WHEN is_end THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 1 FOLLOWING
   AND UNBOUNDED FOLLOWING) AS ep FROM pos)
 SELECT s.doc_id, CAST(e.number AS INTEGER) AS number, min(s.page_no) AS start_page, e.page_no AS end_page FROM nxt s
 JOIN pos e ON e.doc_id = s.doc_id AND e.p = s.ep AND e.is_end WHERE NOT s.is_end AND s.number = e.number
 GROUP BY s.doc_id, e.number, e.page_no, e.p""")
def _(spark, sf):
    return sg.find_questions_by_totals(t.exam_pages(spark, sf))


def _start_sql(number):
    return (f", starts AS (SELECT doc_id, min(page_no) AS start_page FROM line_rows WHERE regexp_matches({trim_sql('line')}, "
            f"'^{number}\\s') GROUP BY doc_id)")


@query("find_question_start", f"WITH {P}{_LINES}{_start_sql('6')} SELECT * FROM starts")
def _(spark, sf):
    return sg.find_question_start(t.exam_pages(spark, sf), "6")


@query("context_pages", f"""WITH {P}{_LINES}{_start_sql('2')} SELECT p.doc_id, page_no, 'extract2' AS extract FROM pages_text p
 JOIN starts USING (doc_id) WHERE page_no < start_page""")
def _(spark, sf):
    pages = t.exam_pages(spark, sf)
    return sg.context_pages(pages, sg.find_question_start(pages, "2"), "2")


def _sub_sql(number, next_pattern):
    stop = f"regexp_matches({trim_sql('line')}, '{next_pattern}')" if next_pattern else "false"
    return f"""WITH {P}{_LINES}{_start_sql(number)},
 heads AS (SELECT doc_id, page_no, bool_or({stop}) AS is_next FROM line_rows GROUP BY ALL),
 after AS (SELECT p.doc_id, p.page_no, is_next, regexp_extract(text, '\\(([a-z])\\)', 1) AS letter FROM pages_text p
  JOIN starts s ON s.doc_id = p.doc_id AND p.page_no > start_page JOIN heads h ON h.doc_id = p.doc_id AND h.page_no = p.page_no),
 stops AS (SELECT doc_id, coalesce(min(page_no) FILTER (is_next), max(page_no) + 1) AS stop FROM after GROUP BY doc_id),
 openers AS (SELECT doc_id, page_no, letter, stop, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) AS nxt
  FROM after JOIN stops USING (doc_id) WHERE letter <> '' AND page_no < stop)
 SELECT doc_id, letter, page_no AS start_page, coalesce(nxt, stop) - 1 AS end_page FROM openers
 QUALIFY row_number() OVER (PARTITION BY doc_id, letter ORDER BY page_no) = 1"""


for _n in ("1", "2", "6"):
    query(f"split_subquestions_{_n}", _sub_sql(_n, sg.next_question_pattern(_n)))(
        lambda spark, sf, n=_n: sg.split_subquestions(t.exam_pages(spark, sf), n))


_ALL_STARTS = _LINES + f""", heads AS MATERIALIZED (SELECT DISTINCT doc_id, page_no, regexp_extract({trim_sql('line')}, '^(\\d+)\\s', 1) AS number
  FROM line_rows WHERE regexp_matches({trim_sql('line')}, '^\\d+\\s')),
 starts AS MATERIALIZED (SELECT doc_id, number, min(page_no) AS start_page FROM heads GROUP BY ALL)"""


@query("all_question_starts", f"WITH {P}{_ALL_STARTS} SELECT * FROM starts")
def _(spark, sf):
    return sg.question_starts(sg.page_marks(t.exam_pages(spark, sf)))


@query("all_context_ranges", f"""WITH {P}{_ALL_STARTS} SELECT doc_id, number, CASE number WHEN '1' THEN 'extract1' WHEN '2' THEN 'extract2'
 ELSE 'extract' END AS extract, 1 AS first_page, start_page - 1 AS last_page FROM starts WHERE start_page > 1""")
def _(spark, sf):
    return sg.context_ranges(sg.question_starts(sg.page_marks(t.exam_pages(spark, sf))))


@query("all_subquestions", f"""WITH {P}{_ALL_STARTS},
 letters AS (SELECT doc_id, page_no, regexp_extract(text, '\\(([a-z])\\)', 1) AS letter FROM pages_text),
 stops AS (SELECT s.doc_id, s.number, s.start_page, coalesce((SELECT min(h.page_no) FROM heads h WHERE h.doc_id = s.doc_id AND h.page_no > s.start_page
    AND s.number <> '2' AND CASE WHEN s.number = '6' THEN regexp_matches(h.number, '^([7-9]|[1-9][0-9])$')
     ELSE h.number = CAST(CAST(s.number AS HUGEINT) + 1 AS VARCHAR) END),
   (SELECT max(page_no) + 1 FROM pages_text p WHERE p.doc_id = s.doc_id)) AS stop FROM starts s),
 openers AS (SELECT s.doc_id, s.number, l.page_no, letter, stop, lead(l.page_no) OVER (PARTITION BY s.doc_id, s.number ORDER BY l.page_no) AS nxt
  FROM stops s JOIN letters l ON l.doc_id = s.doc_id AND l.page_no > s.start_page AND l.page_no < stop WHERE letter <> '')
 SELECT doc_id, number, letter, page_no AS start_page, CAST(coalesce(nxt, stop) - 1 AS INTEGER) AS end_page FROM openers
 QUALIFY row_number() OVER (PARTITION BY doc_id, number, letter ORDER BY page_no) = 1""")
def _(spark, sf):
    return sg.question_parts(sg.page_marks(t.exam_pages(spark, sf)))


@query("split_conversation_parts", """WITH p AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, role FROM conversations),
 o AS (SELECT *, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) AS nxt FROM p WHERE role = 'user'),
 n AS (SELECT doc_id, max(page_no) AS last FROM p GROUP BY doc_id)
 SELECT doc_id, page_no AS start_page, coalesce(nxt - 1, last) AS end_page FROM o JOIN n USING (doc_id)""")
def _(spark, sf):
    """Parts of a conversation: each user turn with the answers up to the next one."""
    pages = t.table(spark, sf, "conversations").selectExpr("conv_id as doc_id", "cast(turn + 1 as int) as page_no", "role")
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    openers = sg.next_position(pages.filter("role = 'user'"), ["doc_id"], "page_no", ["page_no"], F.lit(True), "nxt",
                               F.col("page_no"))
    return openers.join(last, "doc_id").select("doc_id", F.col("page_no").alias("start_page"),
                                               F.coalesce(F.col("nxt") - 1, "last").alias("end_page"))


_LOW, _LEN = "lower(text)", f"length({trim_sql('text')})"
_GUIDE = f"({_LEN} < 50 OR {_any(_LOW, sg.GUIDANCE)} OR (contains({_LOW}, 'pearson') AND NOT contains({_LOW}, 'question')))"


@query("drop_guidance_pages", f"WITH {P} SELECT doc_id, page_no, text FROM pages_text WHERE NOT {_GUIDE}")
def _(spark, sf):
    return sg.drop_guidance_pages(t.exam_pages(spark, sf))


SECTIONS_SQL = P + f""", marks AS (SELECT doc_id, page_no, generate_subscripts(n, 1) AS idx, unnest(n) || unnest(l) AS key FROM (
  SELECT doc_id, page_no, regexp_extract_all(text, '{sg.SUBQUESTION}', 1) AS n, regexp_extract_all(text, '{sg.SUBQUESTION}', 2) AS l
  FROM pages_text WHERE NOT {_GUIDE})),
 ahead AS (SELECT *, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no, idx) AS nxt FROM marks),
 lasts AS (SELECT doc_id, max(page_no) AS last_page FROM pages_text GROUP BY doc_id),
 sections AS (SELECT doc_id, key, page_no AS start_page, CASE WHEN nxt IS NULL THEN last_page ELSE greatest(page_no, nxt - 1) END
   AS max_end FROM ahead JOIN lasts USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY page_no DESC, idx DESC) = 1)"""
_CONTENT = f"({_LEN} >= 30 AND ({_any(_LOW, sg.MARKSCHEME_WORDS)} OR {_any('text', sg.MARKSCHEME_SIGNS)}))"
EXTENDED_SQL = SECTIONS_SQL + f""", flags AS (SELECT doc_id, page_no, {_CONTENT} AS content, {_LEN} < 50 AS short FROM pages_text),
 inside AS (SELECT s.*, page_no, content, short FROM sections s JOIN flags f ON f.doc_id = s.doc_id AND page_no > start_page
   AND page_no <= max_end),
 stop AS (SELECT doc_id, key, min(page_no) AS stop FROM inside WHERE NOT content AND short GROUP BY ALL),
 grown AS (SELECT doc_id, key, max(page_no) AS grown FROM inside LEFT JOIN stop USING (doc_id, key)
   WHERE content AND (stop IS NULL OR page_no < stop) GROUP BY ALL),
 extended AS (SELECT doc_id, key, start_page, coalesce(grown, start_page) AS end_page FROM sections LEFT JOIN grown USING (doc_id, key))"""


@query("subquestion_sections", f"WITH {SECTIONS_SQL} SELECT * FROM sections")
def _(spark, sf):
    return sg.subquestion_sections(t.exam_pages(spark, sf))


def _extended(spark, sf):
    return sg.markscheme_sections(t.exam_pages(spark, sf))


@query("extend_section_end", f"WITH {EXTENDED_SQL} SELECT * FROM extended")
def _(spark, sf):
    return _extended(spark, sf)


@query("group_sections_by_main", f"""WITH {EXTENDED_SQL} SELECT DISTINCT doc_id, substr(key, 1, 1) AS main,
 CAST(unnest(range(start_page, end_page + 1)) AS INTEGER) AS page_no FROM extended""")
def _(spark, sf):
    return sg.group_sections_by_main(_extended(spark, sf))


_TABLE_SQL = P + f""", found AS (SELECT DISTINCT doc_id, page_no, unnest(n) AS n, unnest(n) || '(' || unnest(l) || ')' AS key FROM (
  SELECT doc_id, page_no, regexp_extract_all(text, '{sg.TABLE_KEY}', 1) AS n, regexp_extract_all(text, '{sg.TABLE_KEY}', 2) AS l
  FROM pages_text WHERE {_LEN} >= 10))"""


@query("question_table_pages", f"WITH {_TABLE_SQL} SELECT doc_id, key, page_no FROM found")
def _(spark, sf):
    return sg.question_table_pages(t.exam_pages(spark, sf))


@query("group_question_pages", f"""WITH {_TABLE_SQL} SELECT DISTINCT doc_id, CASE WHEN CAST(n AS BIGINT) <= 5
 THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE replace(replace(key, '(', ''), ')', '') END AS question, page_no
 FROM found WHERE CAST(n AS BIGINT) > 0""")
def _(spark, sf):
    return sg.group_question_pages(sg.question_table_pages(t.exam_pages(spark, sf)))


def _valid_sql(min_len, phrase):
    blank = f" AND NOT contains(lower(text), '{phrase}')" if phrase else ""
    return f"""WITH {P} SELECT doc_id, md5({trim_sql('text')}) AS text_md5, min(page_no) AS page_no FROM pages_text
 WHERE {_LEN} >= {min_len}{blank} GROUP BY ALL"""


@query("valid_pages", _valid_sql(10, None))
def _(spark, sf):
    return sg.valid_pages(t.exam_pages(spark, sf))


@query("valid_mock_pages", _valid_sql(20, "marking guidance"))
def _(spark, sf):
    return sg.valid_pages(t.exam_pages(spark, sf), 20, "marking guidance")


_FOLDER = ["topic", "board", "qualification", "year", "paper", "question_number"]


@query("pair_questions_with_markschemes", f"""WITH {t.QUESTIONS_SQL}, q AS (SELECT board, qualification, year, paper, question_number,
  question_file, content_md5 FROM questions QUALIFY row_number() OVER (PARTITION BY board, qualification, year, paper,
   question_number ORDER BY question_file, content_md5) = 1),
 m AS (SELECT board, qualification, year, paper, question_number, markscheme_file, markscheme_md5 FROM questions
  WHERE markscheme_file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY board, qualification, year, paper,
   question_number ORDER BY markscheme_file, markscheme_md5) = 1)
 SELECT 'economics' AS topic, * FROM q JOIN m USING (board, qualification, year, paper, question_number)""")
def _(spark, sf):
    rows = t.questions(spark, sf).withColumn("topic", F.lit("economics"))
    schemes = rows.filter("markscheme_file is not null").select(*_FOLDER, "markscheme_file", F.col("markscheme_md5").alias("content_md5"))
    return sg.pair_questions_with_markschemes(rows, schemes)
