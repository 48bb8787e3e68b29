"""Counting, report and bank queries over questions (A, H, I)."""

from pyspark.sql import functions as F

from paperloom.bindings import tables as t
from paperloom.operators import dedupe, rollup, stats
from paperloom.plans.scale import scratch_folder, stored_table
from paperloom.sources import bank

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


Q, BT = t.QUESTIONS_SQL, t.BY_TOPIC_SQL
_LABEL = "CASE qualification WHEN 'alevel' THEN 'a level' WHEN 'as' THEN 'as level' END"
_RANGE = """CASE WHEN coalesce(marks, 2147483647) <= 2 THEN '1-2' WHEN marks <= 4 THEN '3-4' WHEN marks <= 6 THEN '5-6'
 WHEN marks <= 10 THEN '7-10' ELSE '11+' END"""
_NUMBER = "'Q' || substr(question_number, 9, 1)"
_TYPE = "CASE WHEN starts_with(question_number, 'question6') THEN 'Question 6 (Essays)' ELSE 'Questions 1-5' END"
_UNIQUE_BY_TOPIC = BT + """, uniq AS (SELECT qualification, topic, content_md5, min(question_id) AS question_id FROM by_topic
 GROUP BY ALL), unique_topic AS (SELECT u.qualification, u.topic, b.question_id, b.marks, b.question_number, b.content_md5
 FROM uniq u JOIN by_topic b ON u.question_id = b.question_id AND u.topic = b.topic)"""


@query("topic_counts", f"WITH {BT} SELECT topic, count(*) AS n FROM by_topic GROUP BY topic")
def _(spark, sf):
    return stats.topic_counts(t.questions(spark, sf))


@query("year_counts", f"WITH {Q} SELECT year, count(*) AS n FROM questions GROUP BY year")
def _(spark, sf):
    return stats.year_counts(t.questions(spark, sf))


@query("board_counts", f"WITH {Q} SELECT board, count(*) AS n FROM questions GROUP BY board")
def _(spark, sf):
    return stats.board_counts(t.questions(spark, sf))


@query("overview_stats", f"""WITH {BT} SELECT qualification, count(*) AS total_questions, CAST(sum(marks) AS BIGINT) AS total_marks,
 count(*) - count(*) FILTER (starts_with(question_number, 'question6')) AS q1to5_questions,
 count(*) FILTER (starts_with(question_number, 'question6')) AS q6_questions,
 (SELECT count(DISTINCT topic) FROM by_topic b WHERE b.qualification = q.qualification) AS topics,
 count(DISTINCT year) AS years, count(DISTINCT board) AS boards, CAST(sum(marks) AS DOUBLE) / count(*) AS avg_marks,
 count(*) - count(marks) AS n_unknown_marks FROM questions q GROUP BY qualification""")
def _(spark, sf):
    return stats.overview_stats(t.questions(spark, sf), ["qualification"])


@query("top_topics", f"""WITH {BT}, c AS (SELECT qualification, topic, count(*) AS n FROM by_topic GROUP BY ALL)
 SELECT qualification, topic, n, CAST(row_number() OVER (PARTITION BY qualification ORDER BY n DESC, topic) AS INTEGER) AS rank
 FROM c QUALIFY rank <= 5""")
def _(spark, sf):
    return stats.top_topics(t.questions(spark, sf), ["qualification"])


@query("question_type_counts", f"WITH {Q} SELECT {_TYPE} AS question_type, count(*) AS n FROM questions GROUP BY 1")
def _(spark, sf):
    return stats.question_type_counts(t.questions(spark, sf))


@query("question_number_counts", f"WITH {Q} SELECT {_NUMBER} AS number, count(*) AS n FROM questions GROUP BY 1")
def _(spark, sf):
    return stats.question_number_counts(t.questions(spark, sf))


@query("marks_distribution", f"WITH {Q} SELECT {_RANGE} AS marks_range, count(*) AS n FROM questions GROUP BY 1")
def _(spark, sf):
    return stats.marks_distribution(t.questions(spark, sf))


@query("marks_stats", f"""WITH {Q} SELECT qualification, CAST(sum(marks) AS BIGINT) AS total_marks,
 CAST(sum(marks) AS DOUBLE) / count(marks) AS avg_marks, min(marks) AS min_marks, max(marks) AS max_marks,
 count(*) - count(marks) AS n_unknown_marks FROM questions GROUP BY qualification""")
def _(spark, sf):
    return stats.marks_stats(t.questions(spark, sf), ["qualification"])


@query("topic_detail", f"""WITH {BT} SELECT qualification, topic, count(*) AS questions, CAST(sum(marks) AS BIGINT) AS total_marks,
 count(DISTINCT year) AS years, CAST(sum(marks) AS DOUBLE) / count(*) AS avg_marks FROM by_topic
 GROUP BY ALL HAVING count(*) >= 5""")
def _(spark, sf):
    return stats.topic_detail(t.questions(spark, sf), ["qualification"])


@query("topic_years", f"""WITH {BT}, cells AS (SELECT qualification, topic, year, count(*) AS n FROM by_topic
 GROUP BY qualification, topic, year) SELECT * FROM cells
 QUALIFY sum(n) OVER (PARTITION BY qualification, topic) >= 5 AND count(*) OVER (PARTITION BY qualification, topic) > 1""")
def _(spark, sf):
    return stats.topic_years(t.questions(spark, sf), ["qualification"])


@query("topic_question_list", f"""WITH {BT} SELECT topic, question_id,
 CAST(row_number() OVER (PARTITION BY topic ORDER BY year, question_number, question_id) AS INTEGER) AS rank,
 year || ' Q' || substr(question_number, 9) || ' (' || coalesce(CAST(marks AS VARCHAR), '?') || ' marks) - ' || board AS label,
 greatest(count(*) OVER (PARTITION BY topic) - 15, 0) AS more FROM by_topic QUALIFY rank <= 15""")
def _(spark, sf):
    return stats.topic_question_list(t.questions(spark, sf))


OVERVIEW_SQL = _UNIQUE_BY_TOPIC + f""", cells AS (SELECT qualification, topic, count(*) AS questions,
 CAST(sum(marks) AS BIGINT) AS total_marks, count(*) - count(marks) AS n_unknown_marks FROM unique_topic GROUP BY ALL),
overview AS (SELECT {_LABEL} AS qualification, topic, 'Theme ' || substr(topic, 1, 1) AS theme, questions, total_marks,
 n_unknown_marks, count(*) OVER (PARTITION BY qualification) AS total_topics FROM cells)"""


@query("topic_overview", f"WITH {OVERVIEW_SQL} SELECT * FROM overview")
def topic_overview(spark, sf):
    return stats.topic_overview(t.questions(spark, sf))


@query("topic_distribution", f"""WITH {BT}, c AS (SELECT topic, count(*) AS n FROM by_topic GROUP BY topic)
 SELECT topic, n, n / (SELECT CAST(sum(n) AS DOUBLE) FROM c) * 100 AS pct FROM c""")
def _(spark, sf):
    return stats.topic_distribution(t.questions(spark, sf))


@query("multi_topic_share", f"""WITH {Q} SELECT year, count(*) AS questions, count(topic2) AS multi,
 count(topic2) / CAST(count(*) AS DOUBLE) * 100 AS pct FROM questions GROUP BY year""")
def _(spark, sf):
    return stats.multi_topic_share(t.questions(spark, sf))


@query("overused_topics", f"""WITH {BT}, n AS (SELECT year, count(*) AS questions FROM questions GROUP BY year)
 SELECT year, topic, count(*) AS n, any_value(questions) AS questions,
 count(*) / CAST(any_value(questions) AS DOUBLE) * 100 AS pct FROM by_topic JOIN n USING (year) GROUP BY year, topic
 HAVING pct > 2.5""")
def _(spark, sf):
    return stats.overused_topics(t.questions(spark, sf), 2.5)


@query("questions_by_qualification_topic", f"WITH {BT} SELECT {_LABEL} AS qualification, topic, question_id FROM by_topic")
def _(spark, sf):
    return stats.questions_by_qualification_topic(t.questions(spark, sf))


@query("share_of_max", f"""WITH {Q}, c AS (SELECT board, year, count(*) AS n FROM questions GROUP BY ALL)
 SELECT board, year, n, n / CAST(max(n) OVER (PARTITION BY board) AS DOUBLE) AS share FROM c""")
def _(spark, sf):
    return stats.share_of_max(stats.year_counts(t.questions(spark, sf), ["board"]), ["board"])


@query("share_of_total", f"""WITH {Q}, c AS (SELECT board, year, count(*) AS n FROM questions GROUP BY ALL)
 SELECT board, year, n, n / CAST(sum(n) OVER (PARTITION BY board) AS DOUBLE) AS share FROM c""")
def _(spark, sf):
    return stats.share_of_total(stats.year_counts(t.questions(spark, sf), ["board"]), ["board"])


def _report_part(metric, key, source="questions"):
    return (f"SELECT {_LABEL} AS qualification, '{metric}' AS metric, {key} AS key, count(*) AS n, CAST(sum(marks) AS BIGINT) "
            f"AS marks, min(marks) AS min_marks, max(marks) AS max_marks FROM {source} GROUP BY 1, 2, 3")


@query("topic_report", f"WITH {BT} " + " UNION ALL ".join([
    _report_part("year", "year"), _report_part("board", "board"), _report_part("question_type", _TYPE),
    _report_part("number", _NUMBER), _report_part("marks_range", _RANGE), _report_part("all", "''"),
    _report_part("topic", "topic", "by_topic")]))
def _(spark, sf):
    return stats.topic_report(t.questions(spark, sf))


def _halves(spark, sf):
    """The questions as two batches that share years, boards and topics, stored once as each is read several times."""
    half = F.crc32(F.col("question_id").cast("binary")) % 2
    rows = stored_table(t.questions(spark, sf).select(
        "qualification", "year", "board", "question_number", "marks", "topics", half.alias("half")))
    return [rows.filter(F.col("half") == i).drop("half") for i in (0, 1)]


@query("overview_from_cells", ORACLE["overview_stats"])
def _(spark, sf):
    """Cells of one half stored, then those of the other; its new topics are numbered on. The report reads cells only."""
    folder, numbers = scratch_folder(spark), None
    for half in _halves(spark, sf):
        numbers = stored_table(rollup.numbered_topics(half, numbers))
        rollup.write_cells(rollup.overview_cells(half, numbers, ["qualification"]), folder)
    return rollup.overview_from_cells(rollup.read_cells(spark, folder), ["qualification"])


@query("detail_from_cells", ORACLE["topic_detail"])
def _(spark, sf):
    folder = scratch_folder(spark)
    for half in _halves(spark, sf):
        rollup.write_cells(rollup.detail_cells(half, ["qualification"]), folder)
    return rollup.detail_from_cells(rollup.read_cells(spark, folder), ["qualification"])


@query("dedupe_first", f"""WITH {Q} SELECT question_id, year, board, marks, content_md5 FROM questions
 QUALIFY row_number() OVER (PARTITION BY content_md5 ORDER BY question_id) = 1""")
def _(spark, sf):
    rows = t.questions(spark, sf).select("question_id", "year", "board", "marks", "content_md5")
    return dedupe.dedupe_first(rows, ["content_md5"], [F.col("question_id")])


@query("dedupe_by_content", f"""WITH {Q} SELECT markscheme_md5, year, question_number, question_id FROM questions
 WHERE markscheme_md5 IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY markscheme_md5 ORDER BY year, question_number, question_id) = 1""")
def _(spark, sf):
    rows = t.questions(spark, sf).select("markscheme_md5", "year", "question_number", "question_id")
    return dedupe.dedupe_by_content(rows, "markscheme_md5",
                                    [F.col("year"), F.col("question_number"), F.col("question_id")])


@query("dedupe_documents", """SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def _(spark, sf):
    rows = t.table(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    first = dedupe.dedupe_by_content(rows, "text_md5", [F.col("doc_id")])
    return first.join(rows.groupBy("text_md5").agg(F.count("*").alias("copies")), "text_md5")


@query("sort_questions", f"WITH {Q} SELECT question_id, year, question_number, board FROM questions ORDER BY 2, 3, 1")
def _(spark, sf):
    return dedupe.sort_questions(t.questions(spark, sf).select("question_id", "year", "question_number", "board"))


@query("only_new_partitions", f"""WITH {Q} SELECT question_id, year, board FROM questions
 WHERE (year, board) NOT IN (SELECT CAST(year(o_orderdate) AS VARCHAR), 'aqa' FROM orders WHERE o_orderkey % 2 = 0)""")
def _(spark, sf):
    done = t.table(spark, sf, "orders").filter("o_orderkey % 2 = 0").selectExpr(
        "cast(year(o_orderdate) as string) as year", "'aqa' as board")
    return bank.only_new_partitions(t.questions(spark, sf).select("question_id", "year", "board"), done, ["year", "board"])


def _write_arrays(objects, folder, rows_a_file=2000):
    """JSON texts as compressed files of one array each. Which file a row is in does not matter, so each task fills its own and no row moves."""
    def joined(batches):
        import pyarrow as pa
        held = []
        for batch in batches:
            held += batch["value"].to_pylist()
            while len(held) >= rows_a_file:
                yield pa.RecordBatch.from_pydict({"value": [f"[{','.join(held[:rows_a_file])}]"]})
                held = held[rows_a_file:]
        if held:
            yield pa.RecordBatch.from_pydict({"value": [f"[{','.join(held)}]"]})

    arrays = objects.mapInArrow(joined, "value string")
    arrays.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)


@query("read_question_bank", f"""WITH {Q} SELECT CASE WHEN marks = 13 THEN NULL ELSE question_number END AS question_number, year, board,
 CASE WHEN marks = 17 THEN NULL ELSE qualification END AS qualification, marks, question_text,
 topic1 || coalesce('|' || topic2, '') AS topics,
 CASE WHEN marks = 13 THEN 'no question number' WHEN marks = 17 THEN 'unknown qualification' END AS reject FROM questions""")
def _(spark, sf):
    """Files of one JSON array each, some rows of which cannot be used."""
    folder, rows = scratch_folder(spark), t.questions(spark, sf)
    spoiled = rows.withColumn("question_number", F.expr("case when marks = 13 then null else question_number end")).withColumn(
        "qualification", F.expr("case when marks = 17 then 'doctorate' else qualification end"))
    _write_arrays(bank.questions_to_bank(spoiled).select(F.to_json(F.struct("*")).alias("value")), folder)
    good, bad = bank.read_question_bank(spark, folder, recursive=True, glob="*.txt.gz")
    return good.withColumn("reject", F.lit(None).cast("string")).unionByName(bad).select(
        "question_number", "year", "board", "qualification", "marks", "question_text", F.array_join("topics", "|").alias("topics"), "reject")


@query("bank_round_trip", f"""WITH {Q} SELECT question_number, year, board, qualification, paper, question_text, marks, question_file,
 markscheme_file, topic1 || coalesce('|' || topic2, '') AS topics FROM questions""")
def _(spark, sf):
    folder = scratch_folder(spark)
    bank.write_question_bank(t.questions(spark, sf), folder)
    read = bank.read_written_bank(spark, folder)
    return read.select("question_number", "year", "board", "qualification", "paper", "question_text", "marks",
                       "question_file", "markscheme_file", F.array_join("topics", "|").alias("topics"))


@query("write_topic_overview", f"""WITH {OVERVIEW_SQL}
 SELECT qualification, printf('%-50s | %3d questions | %4d total marks', topic, questions, coalesce(total_marks, 0)) AS value
 FROM overview
 UNION ALL SELECT DISTINCT qualification, '=== ' || upper(qualification) || ' TOPIC OVERVIEW === Total topics: ' || total_topics
 FROM overview""")
def _(spark, sf):
    folder = scratch_folder(spark)
    bank.write_topic_overview(topic_overview(spark, sf), folder)
    return spark.read.text(folder).select("qualification", "value")
