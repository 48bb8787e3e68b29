"""Bundle and mock queries (J) over questions."""

from pyspark.sql import functions as F

from paperloom.bindings import tables as t
from paperloom.bindings.texts import CONTEXT_SQL
from paperloom.operators import assemble as am
from paperloom.operators.stats import by_topic

QUERIES, ORACLE = {}, {}
SEED = 7


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


SCOPE = ["qualification", "topic"]
BT = t.BY_TOPIC_SQL
_ESSAY = f"({t.essay_sql()} OR coalesce(marks, 2147483647) >= 10)"


def _by_topic(spark, sf):
    return by_topic(t.questions(spark, sf))


@query("bundle_manifest", f"""WITH {BT}, u AS (SELECT * FROM by_topic QUALIFY row_number() OVER (PARTITION BY qualification, topic,
   content_md5 ORDER BY year, question_number, question_id) = 1),
 p AS (SELECT *, CASE WHEN markscheme_md5 IS NULL THEN 2 ELSE 4 END AS size FROM u),
 o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY qualification, topic ORDER BY year, question_number, content_md5
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
 e AS (SELECT *, unnest(range(1, size + 1)) AS i FROM o)
 SELECT qualification, topic, CAST(before + i AS BIGINT) AS seq, question_id,
  ['question_separator', 'question', 'markscheme_separator', 'markscheme'][i] AS kind FROM e""")
def _(spark, sf):
    return am.bundle_manifest(t.questions(spark, sf), SCOPE)


def _page_counts(spark, sf):
    return t.table(spark, sf, "orders").selectExpr(
        "explode(array(0, 1, 2)) as k", "o_orderkey", "cast(o_orderkey % 7 + 1 as int) as valid_pages").selectExpr(
        "md5(concat_ws('-', 'ms', o_orderkey, k)) as markscheme_md5", "valid_pages")


_INDEX_SQL = f"""WITH {BT}, u AS (SELECT * FROM by_topic WHERE markscheme_md5 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY qualification, topic, markscheme_md5 ORDER BY year, question_number, question_id) = 1),
 counts AS (SELECT md5('ms-' || o_orderkey || '-' || k) AS markscheme_md5, o_orderkey % 7 + 1 AS valid_pages
  FROM orders, (VALUES (0), (1), (2)) AS v(k)),
 o AS (SELECT u.*, 2 + coalesce(sum(valid_pages + 1) OVER w, 0) AS start_page, row_number() OVER v AS rn FROM u
  JOIN counts USING (markscheme_md5)
  WINDOW w AS (PARTITION BY qualification, topic ORDER BY year, question_number, markscheme_md5
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  v AS (PARTITION BY qualification, topic ORDER BY year, question_number, markscheme_md5))
 SELECT qualification, topic, question_id, question_number, year, board, marks, CAST(start_page AS BIGINT) AS start_page FROM o"""


@query("markscheme_index", _INDEX_SQL)
def _(spark, sf):
    return am.markscheme_index(t.questions(spark, sf), _page_counts(spark, sf), SCOPE)


@query("markscheme_index_page", _INDEX_SQL + " WHERE rn <= 25")
def _(spark, sf):
    return am.markscheme_index(_by_topic(spark, sf), _page_counts(spark, sf), SCOPE, am.INDEX_ROWS)


_BALANCED_SQL = f"""WITH {BT}, r AS (SELECT qualification, topic, question_id, marks, {_ESSAY} AS essay,
   md5(question_id || '|{SEED}') AS ord FROM by_topic),
 es AS (SELECT *, row_number() OVER (PARTITION BY qualification, topic ORDER BY ord) AS rn FROM r WHERE essay),
 sh AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rn, coalesce(sum(marks) OVER (PARTITION BY qualification, topic
   ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE NOT essay
   WINDOW w AS (PARTITION BY qualification, topic ORDER BY ord)),
 picked AS (SELECT qualification, topic, question_id, marks, 'essay' AS kind, 0 AS seq FROM es WHERE rn = 1
  UNION ALL SELECT sh.qualification, sh.topic, sh.question_id, sh.marks, 'short', sh.rn FROM sh
  LEFT JOIN (SELECT * FROM es WHERE rn = 1) e USING (qualification, topic)
  WHERE CASE WHEN e.question_id IS NULL THEN 0 ELSE coalesce(e.marks, 2147483647) END + before < 50)"""


@query("select_balanced", _BALANCED_SQL + " SELECT * FROM picked")
def _(spark, sf):
    return am.select_balanced(_by_topic(spark, sf), SCOPE, 60, SEED)


@query("select_balanced_two_essays", _BALANCED_SQL.replace("< 50", "< 10") + """, totals AS (SELECT qualification, topic,
  sum(coalesce(marks, 2147483647)) AS total FROM picked GROUP BY ALL)
 SELECT * FROM picked UNION ALL SELECT qualification, topic, question_id, marks, 'second essay', 20 FROM es
 JOIN totals USING (qualification, topic) WHERE rn = 2 AND total < 5""")
def _(spark, sf):
    return am.select_balanced(_by_topic(spark, sf), SCOPE, 20, SEED, second_essay=True)


@query("select_ascending_to_target", f"""WITH {BT}, r AS (SELECT qualification, topic, question_id, marks,
  row_number() OVER w AS rn, sum(marks) OVER (PARTITION BY qualification, topic ORDER BY marks, md5(question_id || '|{SEED}')
   ROWS UNBOUNDED PRECEDING) AS total FROM by_topic WHERE marks IS NOT NULL
  WINDOW w AS (PARTITION BY qualification, topic ORDER BY marks, md5(question_id || '|{SEED}')))
 SELECT qualification, topic, question_id, marks, CAST(rn AS INTEGER) AS seq FROM r WHERE total <= 70 AND total - marks < 50""")
def _(spark, sf):
    return am.select_ascending_to_target(_by_topic(spark, sf), SCOPE, 60, SEED)


@query("select_time_budget", f"""WITH RECURSIVE {t.QUESTIONS_SQL}, pool AS (SELECT *, CAST(round(marks * 2.5) AS INTEGER) AS minutes
  FROM questions WHERE round(marks * 2.5) BETWEEN 1 AND 75),
 tries AS MATERIALIZED (SELECT board, paper, CAST(r AS INTEGER) AS restart, question_id, marks, minutes, row_number() OVER (
   PARTITION BY board, paper, r ORDER BY marks > 10, md5(question_id || '|' || r || '|{SEED}'), question_id) AS i
  FROM pool, range(50) AS t(r)),
 fill(board, paper, restart, i, used, took) AS (
  SELECT DISTINCT board, paper, restart, CAST(0 AS BIGINT), 0, false FROM tries
  UNION ALL SELECT f.board, f.paper, f.restart, t.i, CASE WHEN f.used + t.minutes <= 75 THEN f.used + t.minutes ELSE f.used END,
   f.used + t.minutes <= 75 FROM fill f JOIN tries t ON f.board = t.board AND f.paper = t.paper AND f.restart = t.restart
   AND t.i = f.i + 1 WHERE f.used < 45),
 best AS (SELECT board, paper, restart FROM fill GROUP BY board, paper, restart
  QUALIFY row_number() OVER (PARTITION BY board, paper ORDER BY abs(max(used) - 60), restart) = 1)
 SELECT board, paper, restart, question_id, marks, minutes, CAST(row_number() OVER (PARTITION BY board, paper ORDER BY i) AS INTEGER) AS seq
 FROM fill JOIN best USING (board, paper, restart) JOIN tries USING (board, paper, restart, i) WHERE took""")
def _(spark, sf):
    """Questions of all lengths, so that long ones are skipped on the way to 60 minutes."""
    rows = t.questions(spark, sf).withColumn("minutes", F.round(F.col("marks") * 2.5).cast("int")).withColumn(
        "is_short", F.col("marks") <= 10)
    return am.select_time_budget(rows, ["board", "paper"], F.lit(60), SEED, restarts=50)


_CTX = t.QUESTIONS_SQL + ", " + CONTEXT_SQL
_CTX_TOPIC = _CTX + """, context_topic AS (SELECT * EXCLUDE (topic1, topic2), topic1 AS topic FROM context
 UNION ALL SELECT * EXCLUDE (topic1, topic2), topic2 FROM context WHERE topic2 IS NOT NULL)"""

# Questions of up to 10 marks take at most 25 minutes, less than twice the tolerance, so none is ever skipped
# and a restart is a prefix of its order.
SINGLE_SQL = _CTX_TOPIC + f""", pool AS (SELECT * FROM context_topic
  QUALIFY row_number() OVER (PARTITION BY qualification, topic, content_md5 ORDER BY question_id) = 1),
 timed AS (SELECT qualification, topic, question_id, marks, CASE WHEN reads_context THEN 1 ELSE 0 END AS kind,
   CASE WHEN reads_context THEN CAST(round(marks * 2.5) AS INTEGER) ELSE marks END AS minutes,
   CASE WHEN substr(md5(qualification || '|' || topic || '|{SEED}'), 1, 1) < '8' THEN 60 ELSE 90 END AS target
  FROM pool WHERE marks <= 10),
 tries AS (SELECT *, md5(question_id || '|' || restart || '|{SEED}') AS ord FROM timed, range(50) AS r(restart)),
 run AS (SELECT *, coalesce(sum(minutes) OVER (PARTITION BY qualification, topic, restart ORDER BY kind, ord
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   row_number() OVER (PARTITION BY qualification, topic, restart ORDER BY kind, ord) AS seq FROM tries),
 taken AS (SELECT * FROM run WHERE before < target - 15),
 best AS (SELECT qualification, topic, restart FROM taken GROUP BY qualification, topic, restart, target
  QUALIFY row_number() OVER (PARTITION BY qualification, topic ORDER BY abs(sum(minutes) - target), restart) = 1)"""


def _single(spark, sf):
    return am.single_topic_mock(t.questions(spark, sf), t.extracts(spark, sf), SEED)


@query("single_topic_mock", f"""WITH {SINGLE_SQL} SELECT qualification, topic, CAST(restart AS INTEGER) AS restart, question_id, marks,
 minutes, CAST(seq AS INTEGER) AS seq, target AS label_minutes FROM taken JOIN best USING (qualification, topic, restart)""")
def single_topic_mock(spark, sf):
    return _single(spark, sf)


@query("topic_mocks", f"""WITH RECURSIVE {BT}, u AS (SELECT * FROM by_topic
  QUALIFY row_number() OVER (PARTITION BY qualification, topic, content_md5 ORDER BY question_id) = 1),
 totals AS (SELECT qualification, topic, CAST(least(greatest(coalesce(sum(marks), 0) // 60, 1), 4) AS BIGINT) AS n FROM u GROUP BY ALL),
 r AS (SELECT qualification, topic, question_id, marks, {_ESSAY} AS essay, md5(question_id || '|{SEED}') AS ord FROM u
  WHERE coalesce(marks, 2147483647) >= 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY qualification, topic, essay ORDER BY ord) AS rn FROM r),
 mocks AS (SELECT qualification, topic, unnest(range(1, n + 1)) AS mock FROM totals),
 needs AS (SELECT m.qualification, m.topic, list(greatest(50 - coalesce(CASE WHEN e.rn IS NULL THEN 0 ELSE coalesce(e.marks, 2147483647) END, 0), 0)
   ORDER BY mock) AS need FROM mocks m LEFT JOIN ranked e ON e.qualification = m.qualification AND e.topic = m.topic AND e.essay AND e.rn = m.mock
  GROUP BY ALL),
 fill AS (SELECT qualification, topic, need, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS mock, CAST(0 AS BIGINT) AS used FROM needs
  UNION ALL SELECT f.qualification, f.topic, f.need, f.i + 1, f.nxt, CASE WHEN f.nxt = f.mock THEN f.used ELSE 0 END + s.marks FROM (
   SELECT *, CASE WHEN used < need[mock] THEN mock ELSE list_filter(range(mock + 1, len(need) + 1), lambda j: need[j] > 0)[1] END AS nxt FROM fill) f
  JOIN ranked s ON s.qualification = f.qualification AND s.topic = f.topic AND NOT s.essay AND s.rn = f.i + 1 WHERE f.nxt IS NOT NULL),
 dealt AS (SELECT e.qualification, e.topic, e.rn AS mock, 'essay' AS kind, question_id, marks FROM ranked e JOIN totals t USING (qualification, topic)
   WHERE essay AND rn <= n
  UNION ALL SELECT f.qualification, f.topic, f.mock, 'short', question_id, marks FROM fill f JOIN ranked s
   ON s.qualification = f.qualification AND s.topic = f.topic AND NOT s.essay AND s.rn = f.i)
 SELECT qualification, topic, CAST(mock AS INTEGER) AS mock, kind, question_id, marks,
  CASE WHEN marks >= 15 THEN CAST(round(marks * 2.5) AS INTEGER) ELSE marks * 2 END AS minutes FROM dealt""")
def _(spark, sf):
    return am.topic_mocks(_by_topic(spark, sf), SCOPE, 60, 4, SEED)


_PAPERS = " OR ".join(f"(theme = {k} AND paper IN ({', '.join(repr(p) for p in v)}))" for k, v in am.THEME_PAPERS.items())
UNIT_SQL = _CTX_TOPIC + f""", listed AS (SELECT DISTINCT topic, regexp_extract(topic, '^\\d+\\.\\d+', 0) AS section FROM context_topic),
 drawn AS (SELECT topic, section, mock, CAST(substr(section, 1, 1) AS INTEGER) AS theme FROM listed, range(1, 4) AS r(mock)
  QUALIFY row_number() OVER (PARTITION BY section, mock ORDER BY md5(mock || '|' || topic || '|{SEED}')) = 1),
 fitting AS (SELECT theme, mock, section, c.* FROM context_topic c JOIN drawn USING (topic) WHERE marks < 10 AND ({_PAPERS})
  QUALIFY row_number() OVER (PARTITION BY theme, mock, section, content_md5 ORDER BY question_id) = 1),
 two AS (SELECT * FROM fitting QUALIFY row_number() OVER (PARTITION BY theme, mock, section
   ORDER BY md5(theme || '|' || mock || '|' || content_md5 || '|{SEED}')) <= 2),
 once AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY theme, mock, content_md5 ORDER BY section) = 1),
 unit AS (SELECT theme, CAST(mock AS INTEGER) AS mock, section, topic, question_id, question_number, year, paper, marks,
   CASE WHEN reads_context THEN CAST(round(marks * 2.5) AS INTEGER) ELSE marks * 2 END AS minutes, 75 AS label_minutes,
   question_file, board, qualification FROM once)"""


def _context(spark, sf):
    return am.with_context(t.questions(spark, sf), t.extracts(spark, sf))


def _unit(spark, sf):
    return am.unit_mock(_context(spark, sf), seed=SEED)


@query("unit_mock", f"""WITH {UNIT_SQL} SELECT theme, mock, section, topic, question_id, question_number, year, paper, marks, minutes,
 label_minutes FROM unit""")
def unit_mock(spark, sf):
    return _unit(spark, sf).drop("question_key", "reads_context")


@query("mock_summary", f"""WITH {UNIT_SQL} SELECT theme, mock, count(*) AS questions, CAST(sum(marks) AS BIGINT) AS total_marks,
 CAST(sum(minutes) AS BIGINT) AS total_minutes, count(*) FILTER ({t.essay_sql()}) AS essays FROM unit GROUP BY ALL""")
def _(spark, sf):
    return am.mock_summary(_unit(spark, sf), ["theme", "mock"])


def _unit_files(spark, sf):
    details = t.questions(spark, sf).select("question_id", "question_file", "board", "qualification")
    return _unit(spark, sf).join(details, "question_id")


_NAME = f"""CASE WHEN starts_with(question_number, 'question1') THEN 'extract1' WHEN starts_with(question_number, 'question2')
 THEN 'extract2' ELSE 'extract' END"""


@query("required_extracts", f"""WITH {UNIT_SQL}, essays AS (SELECT *, {_NAME} AS extract,
  CAST(row_number() OVER (PARTITION BY theme, mock ORDER BY section, question_id) AS INTEGER) AS seq FROM unit)
 SELECT theme, mock, question_id, extract, extract_file FROM essays JOIN extracts USING (board, qualification, year, paper, extract)
 WHERE {t.essay_sql()} QUALIFY row_number() OVER (PARTITION BY theme, mock ORDER BY seq) = 1""")
def _(spark, sf):
    rows = _unit_files(spark, sf)
    seq = F.row_number().over(am.Window.partitionBy("theme", "mock").orderBy("section", "question_id"))
    return am.required_extracts(rows.withColumn("seq", seq), t.extracts(spark, sf), ["theme", "mock"])


_MONTH = """CASE WHEN contains(question_file, 'autumn') THEN 'October' WHEN contains(question_file, 'january') THEN 'January'
 WHEN contains(question_file, 'spring') THEN 'March' ELSE 'June' END"""


@query("mock_manifest", f"""WITH {UNIT_SQL}, n AS (SELECT *, {_MONTH} AS month, substr(question_number, 9) AS q,
  CAST(row_number() OVER (PARTITION BY theme, mock ORDER BY topic, question_id) AS INTEGER) AS seq FROM unit)
 SELECT theme, mock, seq, question_id, printf('Question %d ( paper %s %s %s Q%s )', seq, paper, lower(month), year, q) AS header,
  printf('paper %s %s %s Q%s', paper, month, year, q) || ' [' || CASE WHEN length(topic) > 50 THEN substr(topic, 1, 47) || '...'
   ELSE topic END || ']' AS cover, marks, minutes FROM n""")
def _(spark, sf):
    return am.mock_manifest(_unit_files(spark, sf), ["theme", "mock"], [F.col("topic"), F.col("question_id")])


@query("order_by_first_topic", f"WITH {t.QUESTIONS_SQL} SELECT question_id, topic1 AS first_topic, marks FROM questions ORDER BY 2, 1")
def _(spark, sf):
    ordered = am.order_by_first_topic(t.questions(spark, sf))
    return ordered.select("question_id", am.first_topic(F.col("topics")).alias("first_topic"), "marks")
