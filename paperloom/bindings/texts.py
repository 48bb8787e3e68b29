"""Scalar text functions and question features (E, F) over documents and questions."""

from pyspark.sql import functions as F

from paperloom.bindings import tables as t
from paperloom.functions import features as ft
from paperloom.functions import text as tx
from paperloom.operators.assemble import with_context

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# Whole documents with exam-paper noise put between their lines, in Spark and in DuckDB.
_NOISE = r"""concat('*P', doc_id, 'A', n_chars, '* D O NOT WRITE IN  THIS AREA ', replace(text, '. ', CASE doc_id % 5
  WHEN 0 THEN ' ..... ' WHEN 1 THEN ' (2 marks) ' WHEN 2 THEN ' PMT Turn Over ' WHEN 3 THEN ' p12 page 3 of 9 ' ELSE '. . .' END),
 {nl}, doc_id, {nl}, '(Total for Question 3: 12 marks) TOTAL FOR SECTION B = 20 MARKS (Total for Question 4 = 1 mark)???')"""


def _clean_sql(expr):
    for pattern, repl in tx.NOISE:
        expr = f"regexp_replace({expr}, '{pattern}', '{repl}', 'g')"
    return f"trim({expr})"


@query("clean_text", f"""SELECT doc_id, {_clean_sql("noisy")} AS cleaned
 FROM (SELECT doc_id, {_NOISE.format(nl='chr(10)')} AS noisy FROM documents)""")
def _(spark, sf):
    noisy = F.expr(_NOISE.format(nl="chr(10)").replace("CASE", "case"))
    return t.table(spark, sf, "documents").select("doc_id", tx.clean_text(noisy).alias("cleaned"))


_PHRASED = """concat('Calculate using Figure 1, ', replace(text, '. ', CASE doc_id % 4 WHEN 0 THEN ' Section A '
 WHEN 1 THEN ' using the data from the Extract, ' WHEN 2 THEN ' SHOW YOUR WORKING ' ELSE ' marks available ' END))"""


def mask_sql(expr):
    for phrase in tx.IGNORE_PHRASES:
        expr = f"regexp_replace({expr}, '{phrase}', '{tx.MASK}', 'gi')"
    return expr


@query("mask_phrases", f"SELECT doc_id, {mask_sql(_PHRASED)} AS masked FROM documents")
def _(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", tx.mask_phrases(F.expr(_PHRASED)).alias("masked"))


@query("count_occurrences", """SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) // 2 AS INTEGER) AS n_th,
 CAST((length(text) - length(replace(text, lang, ''))) // length(lang) AS INTEGER) AS n_lang FROM documents""")
def _(spark, sf):
    text = F.col("text")
    return t.table(spark, sf, "documents").select(
        "doc_id", tx.count_occurrences(text, F.lit("th")).alias("n_th"),
        tx.count_occurrences(text, F.col("lang")).alias("n_lang"))


_CODES = """CASE p_partkey % 7 WHEN 0 THEN 'A_LEVEL' WHEN 1 THEN 'as' WHEN 2 THEN 'GCSE' WHEN 3 THEN 'igcse' WHEN 4 THEN 'IB'
 WHEN 5 THEN concat(p_type, '_', replace(p_name, ' ', '__')) END"""


def _words_sql(expr):
    return f"array_to_string([upper(w[1]) || w[2:] FOR w IN regexp_split_to_array(lower({expr}), '\\s+') IF w <> ''], ' ')"


@query("format_qualification", f"""WITH c AS (SELECT p_partkey, {_CODES} AS code FROM part)
 SELECT p_partkey, CASE upper(code) WHEN 'A_LEVEL' THEN 'A Level' WHEN 'AS' THEN 'AS Level' WHEN 'GCSE' THEN 'GCSE'
 WHEN 'IGCSE' THEN 'IGCSE' WHEN 'IB' THEN 'IB' ELSE coalesce({_words_sql("replace(code, '_', ' ')")}, 'Unknown') END
 AS label FROM c""")
def _(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", tx.format_qualification(F.expr(_CODES)).alias("label"))


_TOPIC = "CASE WHEN p_partkey % 9 > 0 THEN concat(p_name, '-', lower(p_type), '_x  y', p_size) END"


@query("format_topic", f"""SELECT p_partkey, coalesce({_words_sql(f"replace(replace({_TOPIC}, '_', ' '), '-', ' ')")},
 'Unknown Topic') AS label FROM part""")
def _(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", tx.format_topic(F.expr(_TOPIC)).alias("label"))


@query("format_question_number", f"""WITH {t.QUESTIONS_SQL} SELECT question_id,
 'Question ' || upper(substr(question_number, 9)) AS label, substr(question_number, 9) AS original FROM questions""")
def _(spark, sf):
    number = F.col("question_number")
    return t.questions(spark, sf).select("question_id", tx.format_question_number(number).alias("label"),
                                         tx.original_question_number(number).alias("original"))


_FILE = "CASE p_partkey % 2 WHEN 0 THEN concat('1.', p_size, ' ', p_name, ': <\"', p_type, '\">? ') ELSE concat(p_name, '-', p_brand, '.Pdf') END"


@query("sanitize_file_name", f"""WITH f AS (SELECT p_partkey, {_FILE} AS f FROM part) SELECT p_partkey,
 CASE WHEN regexp_matches(f, '^\\d+\\.\\d+') THEN trim(regexp_replace(f, '[<>:"/\\\\|?*]', '', 'g'))
 ELSE lower(regexp_replace(f, '[^a-zA-Z0-9_\\s\\.]', '_', 'g')) END AS name FROM f""")
def _(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", tx.sanitize_file_name(F.expr(_FILE)).alias("name"))


@query("exam_month", f"""WITH {t.QUESTIONS_SQL} SELECT question_id, CASE WHEN contains(question_file, 'autumn') THEN 'October'
 WHEN contains(question_file, 'january') THEN 'January' WHEN contains(question_file, 'spring') THEN 'March' ELSE 'June' END
 AS month FROM questions""")
def _(spark, sf):
    return t.questions(spark, sf).select("question_id", tx.exam_month(F.col("question_file")).alias("month"))


@query("paper_identifier", f"""WITH {t.QUESTIONS_SQL} SELECT question_id,
 year || '_' || board || CASE WHEN marks > 3 THEN '_' || paper ELSE '' END AS paper_id FROM questions""")
def _(spark, sf):
    return t.questions(spark, sf).select("question_id", tx.paper_identifier(
        F.col("year"), F.col("board"), F.when(F.col("marks") > 3, F.col("paper"))).alias("paper_id"))


@query("truncate_label", f"""WITH {t.BY_TOPIC_SQL} SELECT DISTINCT topic,
 CASE WHEN length(topic) > 8 THEN substr(topic, 1, 8) || '...' ELSE topic END AS chart_label,
 CASE WHEN length(topic) > 50 THEN substr(topic, 1, 47) || '...' ELSE topic END AS trimmed FROM by_topic""")
def _(spark, sf):
    topic = F.col("topic")
    return t.questions(spark, sf).select(F.explode("topics").alias("topic")).distinct().select(
        "topic", tx.truncate_label(topic, 8).alias("chart_label"), tx.trim_topic(topic).alias("trimmed"))


_MARKS = "CASE " + " ".join(f"WHEN contains(question_text, '({m})') THEN {m}" for m in ft.MARK_VALUES) + " END"


@query("marks", f"""WITH {t.QUESTIONS_SQL} SELECT question_id, CASE WHEN paper <> '3' AND question_number IN
 ('question1', 'question2', 'question3', 'question4', 'question5') THEN CASE qualification WHEN 'alevel' THEN 5 ELSE 4 END
 ELSE {_MARKS} END AS marks FROM questions""")
def _(spark, sf):
    c = F.col
    return t.questions(spark, sf).select("question_id", ft.marks(
        c("question_number"), c("qualification"), c("paper"), c("question_text")).alias("marks"))


@query("essay_flags", f"""WITH {t.QUESTIONS_SQL} SELECT question_id, starts_with(question_number, 'question6') AS is_question6,
 starts_with(question_number, 'question1') OR starts_with(question_number, 'question2') AS is_q1or2,
 {t.essay_sql()} AS is_essay, starts_with(question_number, 'question6') OR (paper = '3' AND {t.essay_sql()}) AS paper3_only
 FROM questions""")
def _(spark, sf):
    number = F.col("question_number")
    return t.questions(spark, sf).select(
        "question_id", ft.is_question6(number).alias("is_question6"), ft.is_paper3_q1or2(number).alias("is_q1or2"),
        ft.is_essay(number).alias("is_essay"), ft.is_essay(number, F.col("paper")).alias("paper3_only"))


CONTEXT_SQL = t.EXTRACTS_SQL + f""", papers AS (SELECT DISTINCT board, qualification, year, paper FROM extracts),
context AS (SELECT q.*, p.paper IS NOT NULL AS has_extract,
 {t.essay_sql()} OR p.paper IS NOT NULL OR coalesce(marks, 2147483647) >= 10 AS reads_context
 FROM questions q LEFT JOIN papers p USING (board, qualification, year, paper))"""


@query("is_context_based", f"""WITH {t.QUESTIONS_SQL}, {CONTEXT_SQL} SELECT question_id, has_extract, reads_context FROM context""")
def _(spark, sf):
    return with_context(t.questions(spark, sf), t.extracts(spark, sf)).select("question_id", "has_extract", "reads_context")


def any_sql(expr, phrases):
    return "(" + " OR ".join(f"contains({expr}, '{p}')" for p in phrases) + ")"


def estimate_sql(expr, parity=False):
    rules = []
    for n in ft.ESTIMATE_VALUES:
        unit = "mark" if n == 1 else "marks"
        said = (f"contains({expr}, '{n} {unit}')" if parity else
                f"regexp_matches({expr}, '(^|[^0-9]){n} {unit}{'([^s]|$)' if n == 1 else ''}')")
        rules.append(f"WHEN contains({expr}, '({n})') OR {said} THEN {n}")
    rules.append(f"WHEN {any_sql(f'lower({expr})', ft.COMPUTATIONAL)} OR contains(lower({expr}), 'explain one') THEN 3")
    rules.append(f"WHEN {any_sql(f'lower({expr})', ft.ESSAY_VERBS)} THEN 12")
    return "CASE " + " ".join(rules) + " ELSE 5 END"


@query("text_flags", f"""WITH {t.EXAM_TEXTS_SQL} SELECT id, {any_sql('lower(text)', ft.COMPUTATIONAL)} AS computational,
 {any_sql('lower(text)', ft.DIAGRAM)} AS diagram, {estimate_sql('text')} AS est_marks, {estimate_sql('text', True)} AS est_parity,
 CASE WHEN {estimate_sql('text')} <= 2 THEN 2 WHEN {estimate_sql('text')} <= 5 THEN 3 ELSE 4 END AS max_topics,
 {estimate_sql('text')} >= 5 AND {any_sql('lower(text)', ft.SCARCITY)} AS economic_problem FROM exam_texts""")
def _(spark, sf):
    text, est = F.col("text"), F.col("est_marks")
    return t.exam_texts(spark, sf).select("id", "text", ft.estimate_marks(text).alias("est_marks")).select(
        "id", ft.is_computational(text).alias("computational"), ft.requires_diagram(text).alias("diagram"), "est_marks",
        ft.estimate_marks(text, parity=True).alias("est_parity"), ft.max_topics(est).alias("max_topics"),
        ft.allows_economic_problem(text, est).alias("economic_problem"))


_LONG = "CAST(round(marks * 2.5) AS INTEGER)"


@query("estimated_minutes", f"""WITH {t.QUESTIONS_SQL}, {CONTEXT_SQL} SELECT question_id,
 CASE WHEN marks >= 15 THEN {_LONG} ELSE marks * 2 END AS by_marks,
 CASE WHEN reads_context THEN {_LONG} ELSE marks END AS single,
 CASE WHEN reads_context THEN {_LONG} ELSE marks * 2 END AS unit FROM context""")
def _(spark, sf):
    rows = with_context(t.questions(spark, sf), t.extracts(spark, sf))
    m, c = F.col("marks"), F.col("reads_context")
    return rows.select("question_id", ft.estimated_minutes(m, c, "marks").alias("by_marks"),
                       ft.estimated_minutes(m, c, "single").alias("single"),
                       ft.estimated_minutes(m, c, "unit").alias("unit"))


@query("question_key", f"""WITH {t.QUESTIONS_SQL} SELECT question_id, CASE WHEN marks > 5 THEN content_md5
 ELSE year || '_' || board || '_' || question_number END AS question_key FROM questions""")
def _(spark, sf):
    md5 = F.when(F.col("marks") > 5, F.col("content_md5"))
    return t.questions(spark, sf).select("question_id", ft.question_key(
        md5, F.col("year"), F.col("board"), F.col("question_number")).alias("question_key"))
