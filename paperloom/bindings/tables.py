"""Engine tables built from the test tables, as DataFrames and as SQL of the same meaning.

Every table is a projection or an equi-join of whole test tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.taxonomy import TOPICS, taxonomy

N_TOPICS = len(TOPICS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _topic_array() -> str:
    return "array(" + ", ".join("'" + t.replace("'", "''") + "'" for t in TOPICS) + ")"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order line; lines with equal order and number are copies of one file."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    names = F.expr(_topic_array())
    base = lines.join(orders, "l_orderkey").selectExpr(
        "*", "cast(l_quantity as int) as qty",
        "case l_returnflag when 'A' then 'aqa' when 'N' then 'edexcel' else 'ocr' end as board",
        "case l_linestatus when 'O' then 'alevel' else 'as' end as qualification",
        "case priority when '4' then '1' when '5' then '2' else priority end as paper",
        "cast(year(l_shipdate) as string) as year",
        "case month(l_shipdate) when 6 then 'june' when 10 then 'autumn' when 1 then 'january' "
        "when 3 then 'spring' else 'other' end as session",
        "concat('question', l_linenumber, case when l_linenumber = 6 then chr(97 + l_partkey % 5) else '' end) "
        "as question_number")
    rows = base.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'), qty, "
        "cast(round(l_extendedprice * 100) as bigint)) as question_id",
        "question_number", "year", "board", "qualification", "paper",
        "concat('Evaluate item ', l_partkey, ' (', qty, ')') as question_text",
        "case when l_partkey % 50 = 0 then null else qty end as marks",
        "cast(l_partkey % 87 as int) as t1", "cast((l_suppkey * 7 + l_linenumber) % 87 as int) as t2",
        "concat_ws('/', '/bank', board, year, session, paper, concat(question_number, '.pdf')) as question_file",
        "case when l_suppkey % 10 <> 0 then concat_ws('/', '/bank', board, year, session, paper, 'markscheme', "
        "concat(question_number, '.pdf')) end as markscheme_file",
        "md5(concat_ws('-', l_orderkey, l_linenumber)) as content_md5",
        "case when l_suppkey % 10 <> 0 then md5(concat_ws('-', 'ms', l_orderkey, l_linenumber % 3)) end "
        "as markscheme_md5")
    topics = F.array_distinct(F.array(F.get(F.col("names"), F.col("t1")), F.get(F.col("names"), F.col("t2"))))
    return rows.withColumn("names", names).withColumn("topics", topics).drop("names", "t1", "t2")


TOPICS_SQL = "topics(ord, topic) AS (VALUES " + ", ".join(
    f"({i}, '{t}')" for i, t in enumerate(TOPICS)) + ")"

QUESTIONS_SQL = TOPICS_SQL + """, lines AS (
 SELECT *, CAST(l_quantity AS INTEGER) AS qty,
  CASE l_returnflag WHEN 'A' THEN 'aqa' WHEN 'N' THEN 'edexcel' ELSE 'ocr' END AS board,
  CASE l_linestatus WHEN 'O' THEN 'alevel' ELSE 'as' END AS qualification,
  CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN '1' WHEN '5' THEN '2'
   ELSE substr(o_orderpriority, 1, 1) END AS paper,
  CAST(year(l_shipdate) AS VARCHAR) AS year,
  CASE month(l_shipdate) WHEN 6 THEN 'june' WHEN 10 THEN 'autumn' WHEN 1 THEN 'january'
   WHEN 3 THEN 'spring' ELSE 'other' END AS session,
  'question' || l_linenumber || CASE WHEN l_linenumber = 6 THEN chr(CAST(97 + l_partkey % 5 AS INTEGER))
   ELSE '' END AS question_number
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
questions AS (
 SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' ||
   strftime(l_shipdate, '%Y%m%d') || '-' || qty || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS question_id,
  question_number, year, board, qualification, paper,
  'Evaluate item ' || l_partkey || ' (' || qty || ')' AS question_text,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE qty END AS marks,
  t1.topic AS topic1, CASE WHEN t2.topic <> t1.topic THEN t2.topic END AS topic2,
  '/bank/' || board || '/' || year || '/' || session || '/' || paper || '/' || question_number || '.pdf'
   AS question_file,
  CASE WHEN l_suppkey % 10 <> 0 THEN '/bank/' || board || '/' || year || '/' || session || '/' || paper ||
   '/markscheme/' || question_number || '.pdf' END AS markscheme_file,
  md5(l_orderkey || '-' || l_linenumber) AS content_md5,
  CASE WHEN l_suppkey % 10 <> 0 THEN md5('ms-' || l_orderkey || '-' || (l_linenumber % 3)) END AS markscheme_md5
 FROM lines JOIN topics t1 ON t1.ord = l_partkey % 87
 JOIN topics t2 ON t2.ord = (l_suppkey * 7 + l_linenumber) % 87)"""

# One row per (question, topic).
BY_TOPIC_SQL = QUESTIONS_SQL + """, by_topic AS (
 SELECT * EXCLUDE (topic1, topic2), topic1 AS topic FROM questions
 UNION ALL SELECT * EXCLUDE (topic1, topic2), topic2 AS topic FROM questions WHERE topic2 IS NOT NULL)"""


def essay_sql(number: str = "question_number") -> str:
    return (f"(starts_with({number}, 'question6') OR starts_with({number}, 'question1') "
            f"OR starts_with({number}, 'question2'))")


def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract files of papers, one at most for each order."""
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr(
        "case o_orderkey % 3 when 0 then 'aqa' when 1 then 'edexcel' else 'ocr' end as board",
        "case o_orderkey % 2 when 0 then 'alevel' else 'as' end as qualification",
        "cast(year(o_orderdate) as string) as year",
        "case when o_orderpriority like '5%' then '2' when o_orderpriority like '4%' then '1' "
        "else substr(o_orderpriority, 1, 1) end as paper",
        "case o_orderkey % 5 when 0 then 'extract1' when 1 then 'extract2' else 'extract' end as extract"
    ).distinct().selectExpr("*", "concat_ws('/', '/bank', board, qualification, year, paper, concat(extract, '.pdf')) "
                                 "as extract_file")


EXTRACTS_SQL = """extracts AS (
 SELECT *, '/bank/' || board || '/' || qualification || '/' || year || '/' || paper || '/' || extract || '.pdf'
  AS extract_file FROM (
  SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'aqa' WHEN 1 THEN 'edexcel' ELSE 'ocr' END AS board,
   CASE o_orderkey % 2 WHEN 0 THEN 'alevel' ELSE 'as' END AS qualification,
   CAST(year(o_orderdate) AS VARCHAR) AS year,
   CASE WHEN o_orderpriority LIKE '5%' THEN '2' WHEN o_orderpriority LIKE '4%' THEN '1'
    ELSE substr(o_orderpriority, 1, 1) END AS paper,
   CASE o_orderkey % 5 WHEN 0 THEN 'extract1' WHEN 1 THEN 'extract2' ELSE 'extract' END AS extract
  FROM orders))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order, named in one of eight house styles."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(year(o_orderdate) as string) as y", "cast(substr(o_orderpriority, 1, 1) as int) as p",
        "o_custkey", "o_orderkey").selectExpr(
        "concat('in/', o_orderkey) as path", """case o_orderkey % 8
        when 0 then concat('economics_alevel_edexcel_', y, '_paper', p, '_questionpaper.pdf')
        when 1 then concat('June ', y, case when o_custkey % 2 = 0 then ' MS' else ' QP' end, ' - Paper ', p, ' Edexcel Economics A-level.pdf')
        when 2 then concat(case when o_custkey % 3 = 0 then 'Edexcel Economics A-level ' else '' end, 'Paper ', p, ' QP ', y, '.pdf')
        when 3 then concat('question paper unit ', p, '.pdf')
        when 4 then concat('x as-level aqa maths ', y, ' mark scheme p', p, '.docx')
        when 5 then concat('exams_', y)
        when 6 then concat('ocr_gcse_physics_examreport_', y, ' p', p, '.doc')
        else concat('cie igcse chemistry ', y, ' qp .', o_custkey % 7) end as name""")


FILES_SQL = """files AS (
 SELECT 'in/' || o_orderkey AS path, CASE o_orderkey % 8
   WHEN 0 THEN 'economics_alevel_edexcel_' || y || '_paper' || p || '_questionpaper.pdf'
   WHEN 1 THEN 'June ' || y || CASE WHEN o_custkey % 2 = 0 THEN ' MS' ELSE ' QP' END || ' - Paper ' || p || ' Edexcel Economics A-level.pdf'
   WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 'Edexcel Economics A-level ' ELSE '' END || 'Paper ' || p || ' QP ' || y || '.pdf'
   WHEN 3 THEN 'question paper unit ' || p || '.pdf'
   WHEN 4 THEN 'x as-level aqa maths ' || y || ' mark scheme p' || p || '.docx'
   WHEN 5 THEN 'exams_' || y
   WHEN 6 THEN 'ocr_gcse_physics_examreport_' || y || ' p' || p || '.doc'
   ELSE 'cie igcse chemistry ' || y || ' qp .' || (o_custkey % 7) END AS name
 FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y, substr(o_orderpriority, 1, 1) AS p FROM orders))"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source's answer about each file: a JSON object with text around it."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('in/', o_orderkey) as path",
        """concat('Sure: {"topic": "Eco-nomics ', o_custkey % 3, '", "qualification": "',
          case o_custkey % 4 when 0 then 'GCE' when 1 then 'AS Level' when 2 then 'BTEC' else 'none' end,
          '", "examBoard": "', case o_custkey % 3 when 0 then 'CAIE' when 1 then 'Pearson Edexcel' else 'x' end,
          '", "year": ', year(o_orderdate), ', "paper": "Paper ', o_custkey % 5, '", "documentType": "',
          case o_custkey % 4 when 0 then 'marking notes' when 1 then 'QP' when 2 then 'a report' else 'other' end,
          '"} done') as answer""")


ANSWERS_SQL = """answers AS (
 SELECT 'in/' || o_orderkey AS path,
  'economics' || (o_custkey % 3) AS e_topic,
  CASE o_custkey % 4 WHEN 0 THEN 'alevel' WHEN 1 THEN 'as' WHEN 2 THEN 'btec' END AS e_qualification,
  CASE o_custkey % 3 WHEN 0 THEN 'cambridge' WHEN 1 THEN 'edexcel' END AS e_board,
  CAST(year(o_orderdate) AS INTEGER) AS e_year, CAST(o_custkey % 5 AS INTEGER) AS e_paper,
  CASE o_custkey % 4 WHEN 0 THEN 'markscheme' WHEN 1 THEN 'questionpaper' WHEN 2 THEN 'examinerreport' END
   AS e_doc_type
 FROM orders)"""


def exam_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into pages at line ends, with exam marks added by document and page number."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.selectExpr("doc_id", "i + 1 as page_no", "line").selectExpr(
        "doc_id", "page_no", r"""concat(line,
        case when page_no = 3 + doc_id % 4 then '\nSECTION B' else '' end,
        case when page_no % 5 = 1 then concat('\n', page_no div 5 + 1, ' Study the extract') else '' end,
        case when page_no % 5 = 4 then concat('\n(Total for Question ', page_no div 5 + 1, ' = 5 marks)') else '' end,
        case when (page_no + doc_id) % 3 = 0 then concat('\n(', chr(97 + page_no % 5), ') part') else '' end,
        case when (page_no + doc_id) % 4 = 0
         then concat('\n', 1 + page_no % 2, ' (', chr(97 + page_no % 5), ') then 2(b) here') else '' end,
        case when (page_no + doc_id) % 11 = 0 then concat('\n', 4 + page_no % 4, ' (c) table') else '' end,
        case when page_no % 7 = 0 then '\nGeneral Marking Guidance' else '' end,
        case when doc_id % 10 = 0 and page_no = 2 then '\nPaper 3' else '' end,
        case when page_no % 6 in (2, 5) then '\nknowledge' else '' end) as text""")


EXAM_PAGES_SQL = r"""page_lines AS (
 SELECT doc_id, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) AS INTEGER) AS page_no
 FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
pages_text AS (
 SELECT doc_id, page_no, concat(line,
  CASE WHEN page_no = 3 + doc_id % 4 THEN chr(10) || 'SECTION B' ELSE '' END,
  CASE WHEN page_no % 5 = 1 THEN chr(10) || (page_no // 5 + 1) || ' Study the extract' ELSE '' END,
  CASE WHEN page_no % 5 = 4 THEN chr(10) || '(Total for Question ' || (page_no // 5 + 1) || ' = 5 marks)' ELSE '' END,
  CASE WHEN (page_no + doc_id) % 3 = 0 THEN chr(10) || '(' || chr(CAST(97 + page_no % 5 AS INTEGER)) || ') part' ELSE '' END,
  CASE WHEN (page_no + doc_id) % 4 = 0 THEN chr(10) || (1 + page_no % 2) || ' (' ||
   chr(CAST(97 + page_no % 5 AS INTEGER)) || ') then 2(b) here' ELSE '' END,
  CASE WHEN (page_no + doc_id) % 11 = 0 THEN chr(10) || (4 + page_no % 4) || ' (c) table' ELSE '' END,
  CASE WHEN page_no % 7 = 0 THEN chr(10) || 'General Marking Guidance' ELSE '' END,
  CASE WHEN doc_id % 10 = 0 AND page_no = 2 THEN chr(10) || 'Paper 3' ELSE '' END,
  CASE WHEN page_no % 6 IN (2, 5) THEN chr(10) || 'knowledge' ELSE '' END) AS text
 FROM page_lines)"""


def paper_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, paper) as a catalogue would give it."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(n_chars % 4 as int) as paper")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))


def _item_topics(spark: SparkSession) -> DataFrame:
    return taxonomy(spark).select("topic", F.col("ord").cast("long").alias("ord"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, keyword): words of 5 or more letters of each benchmark item, and pairs of such neighbours."""
    items = _benchmark_words(spark, sf_dir).select("item_id", "w", F.posexplode("w").alias("i", "word"))
    after = F.get("w", F.col("i") + 1)
    pair = F.when(F.length(after) >= 5, F.concat_ws(" ", "word", after))
    both = items.filter(F.length("word") >= 5).select(
        (F.col("item_id") % N_TOPICS).alias("ord"), F.explode(F.array("word", pair)).alias("keyword"))
    return both.filter(F.col("keyword").isNotNull()).distinct().join(_item_topics(spark), "ord").select("topic", "keyword")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept, topic): the first three words of each benchmark item."""
    items = _benchmark_words(spark, sf_dir).select(
        (F.col("item_id") * 3 % N_TOPICS).alias("ord"), F.explode(F.slice("w", 1, 3)).alias("concept"))
    return items.distinct().join(_item_topics(spark), "ord").select("concept", "topic")


DICTIONARY_SQL = TOPICS_SQL + """, words AS (
 SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, w
 FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)),
keywords AS (SELECT DISTINCT topic, keyword FROM (
  SELECT item_id, word AS keyword FROM words WHERE length(word) >= 5
  UNION ALL SELECT item_id, word || ' ' || w[i + 1] FROM words WHERE length(word) >= 5 AND length(w[i + 1]) >= 5)
 JOIN topics ON ord = item_id % 87),
concepts AS (SELECT DISTINCT word AS concept, topic FROM words JOIN topics ON ord = item_id * 3 % 87 WHERE i <= 3)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): a suggested label per part, spelled in one of eight ways."""
    parts = table(spark, sf_dir, "part").withColumn("ord", F.col("p_partkey") % N_TOPICS)
    return parts.join(_item_topics(spark), "ord").select(F.col("p_partkey").alias("id"), F.expr("""
        case p_partkey % 8 when 0 then topic when 1 then concat('"', topic, '"')
         when 2 then concat('Topic: ', topic) when 3 then concat(substring_index(topic, ' ', 1), ' ', p_name)
         when 4 then lower(topic) when 5 then substr(topic, instr(topic, ' ') + 1)
         when 6 then concat('The main topic is: ', topic) else p_name end""").alias("label"))


LABELS_SQL = TOPICS_SQL + """, labels AS (
 SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN topic WHEN 1 THEN '"' || topic || '"'
   WHEN 2 THEN 'Topic: ' || topic WHEN 3 THEN split_part(topic, ' ', 1) || ' ' || p_name
   WHEN 4 THEN lower(topic) WHEN 5 THEN substr(topic, strpos(topic, ' ') + 1)
   WHEN 6 THEN 'The main topic is: ' || topic ELSE p_name END AS label
 FROM part JOIN topics ON ord = p_partkey % 87)"""


def label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, answer, n_questions): one answer per order with three question lines."""
    orders = table(spark, sf_dir, "orders").withColumn("names", F.expr(_topic_array()))
    return orders.selectExpr("o_orderkey as batch_id", "2 as n_questions", """concat(
        'Question 1: ', names[cast(o_orderkey % 87 as int)], ', ', names[cast(o_custkey % 87 as int)],
        '\nQUESTION 2 : the topics are: "', names[cast((o_orderkey + 5) % 87 as int)], '" and ',
        names[cast((o_custkey + 9) % 87 as int)], '\nQuestion 3: ', names[0]) as answer""")


LABEL_ANSWERS_SQL = TOPICS_SQL + """, label_answers AS (
 SELECT o_orderkey AS batch_id, [a.topic, b.topic] AS l1, [c.topic, d.topic] AS l2
 FROM orders JOIN topics a ON a.ord = o_orderkey % 87 JOIN topics b ON b.ord = o_custkey % 87
 JOIN topics c ON c.ord = (o_orderkey + 5) % 87 JOIN topics d ON d.ord = (o_custkey + 9) % 87)"""


def exam_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): order lines and their parts worded as exam questions."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").join(parts, "l_partkey").withColumn("names", F.expr(_topic_array())).selectExpr(
        "*", "cast(l_quantity as int) as qty").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'), qty, "
        "cast(round(l_extendedprice * 100) as bigint)) as id", "l_partkey", "l_suppkey",
        EXAM_TEXT.format(title="names[cast(l_suppkey % 87 as int)]") + " as text")


EXAM_TEXT = """concat(
  case l_linenumber when 1 then 'Calculate the price elasticity of ' when 2 then 'Discuss the government policy on '
   when 3 then 'Draw a supply and demand diagram of the market for ' when 4 then 'Explain one cost of '
   when 5 then 'Using Figure 1, work out the revenue from ' when 6 then 'Evaluate how inflation and growth affect '
   else 'Assess the monopoly in ' end,
  p_name, ' and ', {title}, ' (', qty, case when l_partkey % 2 = 0 then ' marks' else '' end, ')')"""

EXAM_TEXTS_SQL = TOPICS_SQL + """, exam_texts AS (
 SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' ||
   strftime(l_shipdate, '%Y%m%d') || '-' || qty || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
  l_partkey, l_suppkey, """ + EXAM_TEXT.format(title="topic") + """ AS text
 FROM (SELECT *, CAST(l_quantity AS INTEGER) AS qty FROM lineitem) JOIN part ON p_partkey = l_partkey
 JOIN topics ON ord = l_suppkey % 87)"""


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages with a block of sections and document links added at their end."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", r"""concat(html,
        '<h4>Theme ', page_id % 4, ' notes</h4><p><a class="x" href="files/../docs/n', page_id, '.pdf">Notes &amp; more</a>',
        '<a href="https://docs.example.org/theme-', page_id % 5, '/">On <b>site</b></a></p><h5>Past: papers</h5><ul>',
        '<li><a href="//cdn.example.org/p', page_id % 50, '.docx">Paper</a></li>',
        '<li><a href="mailto:a@example.org">Mail</a></li></ul><strong> </strong><a href="?page=', page_id % 3, '">More</a>',
        '<strong>Set ', page_id % 6, '</strong><a href="https://docs.example.org/s.pdf">Extra</a>')
        as html""")


SITE_PAGES_SQL = """site_pages AS (
 SELECT page_id, url, concat(html,
  '<h4>Theme ', page_id % 4, ' notes</h4><p><a class="x" href="files/../docs/n', page_id, '.pdf">Notes &amp; more</a>',
  '<a href="https://docs.example.org/theme-', page_id % 5, '/">On <b>site</b></a></p><h5>Past: papers</h5><ul>',
  '<li><a href="//cdn.example.org/p', page_id % 50, '.docx">Paper</a></li>',
  '<li><a href="mailto:a@example.org">Mail</a></li></ul><strong> </strong><a href="?page=', page_id % 3, '">More</a>',
        '<strong>Set ', page_id % 6, '</strong><a href="https://docs.example.org/s.pdf">Extra</a>')
  AS html FROM pages)"""
