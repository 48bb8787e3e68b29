"""Taxonomy and tagging queries (G) over documents and exam-style texts."""

from pyspark.sql import functions as F

from paperloom.bindings import tables as t
from paperloom.bindings.texts import any_sql, estimate_sql, mask_sql
from paperloom.functions import features as ft
from paperloom.operators import classify as cl
from paperloom.operators import labels as lb
from paperloom.operators import taxonomy as tax
from paperloom.plans.scale import scratch_folder
from paperloom.streaming.incremental import tag_each_question_once

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


_MAJORS = "majors(section, major) AS (VALUES " + ", ".join(f"('{m.split(' ')[0]}', '{m}')" for m in tax.MAJORS) + ")"
_CODED = "'^\\d+\\.\\d+\\.\\d+\\s+'"


@query("describe_topics", f"""WITH {t.BY_TOPIC_SQL}, {_MAJORS} SELECT topic, count(*) AS n, 'Theme ' || substr(topic, 1, 1) AS theme,
 any_value(major) AS major, split_part(topic, ' ', 1) AS code, substr(topic, strpos(topic, ' ') + 1) AS name
 FROM by_topic JOIN majors ON section = regexp_extract(topic, '^\\d+\\.\\d+', 0) GROUP BY topic""")
def _(spark, sf):
    counts = t.questions(spark, sf).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    return tax.describe_topics(counts)


@query("theme_allowed", f"""WITH {t.BY_TOPIC_SQL} SELECT DISTINCT qualification, topic,
 qualification <> 'as' OR substr(topic, 1, 1) IN ('1', '2') AS allowed FROM by_topic""")
def _(spark, sf):
    rows = t.questions(spark, sf).select("qualification", F.explode("topics").alias("topic")).distinct()
    return rows.select("qualification", "topic",
                       tax.theme_allowed(tax.topic_theme(F.col("topic")), F.col("qualification")).alias("allowed"))


@query("topics_of_theme", f"""WITH {t.BY_TOPIC_SQL} SELECT topic, count(*) AS n FROM by_topic WHERE topic LIKE '3.%' GROUP BY topic""")
def _(spark, sf):
    rows = t.questions(spark, sf).select(F.explode("topics").alias("topic"))
    return tax.topics_of_theme(rows, 3).groupBy("topic").agg(F.count("*").alias("n"))


# The dictionary made of topic titles, and a concept per topic: the title of the topic before it.
_TITLES_SQL = f""", bare AS (SELECT topic, ord, lower(regexp_replace(topic, {_CODED}, '')) AS b FROM topics),
title_phrases AS (SELECT DISTINCT topic, phrase FROM (
  SELECT topic, lower(topic) AS phrase FROM topics UNION ALL
  SELECT topic, trim(unnest(regexp_split_to_array(b, '\\s+and\\s+|,\\s*'))) FROM bare) WHERE length(phrase) > 3),
keywords AS (SELECT topic, unnest([w FOR w IN regexp_split_to_array(regexp_replace(b, '[(),]', '', 'g'), '\\s+')
   IF length(w) > 3]) AS keyword FROM bare
  UNION SELECT topic, phrase FROM title_phrases WHERE phrase <> lower(topic)),
concepts AS (SELECT a.b AS concept, b.topic FROM bare a JOIN bare b ON b.ord = a.ord + 1)"""
_EXAM_DOCS = t.EXAM_TEXTS_SQL + _TITLES_SQL + f""", docs AS (
 SELECT id, lower(text) AS text, {any_sql('lower(text)', ft.COMPUTATIONAL)} AS computational FROM exam_texts)"""
_CORPUS_DOCS = t.DICTIONARY_SQL + f""", docs AS (
 SELECT doc_id AS id, lower(text) AS text, {any_sql('lower(text)', ft.COMPUTATIONAL)} AS computational FROM documents)"""


def _exam_dictionary(spark):
    topics = tax.taxonomy(spark)
    titles = topics.select("topic", "ord", F.lower(F.regexp_replace("topic", tax.CODED + r"\s+", "")).alias("concept"))
    shifted = titles.select("concept", (F.col("ord") + 1).alias("ord")).join(topics, "ord").select("concept", "topic")
    return topics, tax.derived_keywords(topics), shifted


def _related_sql():
    rules = [f"(keyword = '{w}' AND {' AND '.join(any_sql('text', g) for g in groups)})" for w, groups in cl.RELATED.items()]
    return "(" + " OR ".join(rules) + ")"


def _bounded_sql(word):
    return f"regexp_matches(text, '(^|[^a-z0-9_])' || {word} || '($|[^a-z0-9_])')"


def _bounded_or_delimited_sql(word):
    """Titles with brackets are matched by their delimiters only."""
    delimited = " OR ".join(f"contains(text, '{a}' || {word} || '{b}')" for a, b in [(" ", " "), (" ", ","), (" ", "."), ("(", ")")])
    quoted = f"replace(replace({word}, '(', '\\('), ')', '\\)')"
    return (f"CASE WHEN regexp_matches({word}, '^[a-z0-9_](.*[a-z0-9_])?$') THEN {_bounded_sql(quoted)} "
            f"ELSE {delimited} OR starts_with(text, {word} || ' ') OR ends_with(text, ' ' || {word}) END")


MATCH_SQL = f""", kw AS (SELECT DISTINCT keyword FROM keywords WHERE length(keyword) >= 3),
met AS MATERIALIZED (SELECT id, text, keyword, contains(text, keyword) AS has, {_related_sql()} AS rel
 FROM docs JOIN kw ON contains(text, keyword) OR {_related_sql()}),
matches AS MATERIALIZED (SELECT id, keyword, CASE WHEN has AND {_bounded_or_delimited_sql('keyword')} THEN 'EXACT'
  WHEN has AND length(keyword) > 4 AND (contains(text, keyword || 's ') OR contains(text, keyword || 'ing')
   OR contains(text, keyword || 'ed') OR contains(text, keyword || '''s')) THEN 'PARTIAL'
  WHEN rel THEN 'RELATED' END AS match FROM met)"""
_CALC = any_sql("topic", cl.CALCULATION_TOPICS)
SCORE_SQL = MATCH_SQL + f""", sums AS (SELECT id, topic, count(*) FILTER (match = 'EXACT') AS e, count(*) FILTER (match = 'PARTIAL') AS p,
  count(*) FILTER (match = 'RELATED') AS r, count(*) FILTER (match = 'EXACT' AND length(keyword) > 6) AS le
 FROM matches JOIN keywords USING (keyword) WHERE match IS NOT NULL GROUP BY id, topic),
base AS (SELECT id, topic, (e * 3.0::DOUBLE + p * 1.5::DOUBLE + r * 0.5::DOUBLE + CASE WHEN e > 1 THEN 2 ELSE 0 END
  + CASE WHEN le > 0 THEN 1 ELSE 0 END) * CASE WHEN e = 0 AND p < 2 THEN 0.3::DOUBLE ELSE 1 END AS base FROM sums),
scores AS (SELECT id, topic, CASE WHEN NOT computational THEN base WHEN {_CALC} THEN base + 1 ELSE base * 0.5::DOUBLE END AS score
 FROM base JOIN docs USING (id)),
concept_hits AS (SELECT id, concept FROM docs JOIN (SELECT DISTINCT concept FROM concepts) ON contains(text, concept)
  AND {_bounded_or_delimited_sql('concept').replace(" OR contains(text, '(' || concept || ')')", '')}),
bonus AS (SELECT id, topic, count(*) * 2.0::DOUBLE AS bonus FROM concept_hits JOIN concepts USING (concept) GROUP BY id, topic)"""
MENTION_SQL = """, mentions AS (SELECT DISTINCT id, topic, 5.0::DOUBLE AS bonus FROM docs JOIN title_phrases ON contains(text, phrase))"""
TOP_SQL = f""", summed AS (SELECT id, topic, sum(s) AS score, bool_or(hit) AS hit FROM (
  SELECT id, topic, score AS s, true AS hit FROM scores UNION ALL
  SELECT id, topic, bonus, false FROM bonus WHERE topic IN (SELECT topic FROM keywords) UNION ALL
  SELECT id, topic, bonus, false FROM mentions WHERE topic IN (SELECT topic FROM keywords)) GROUP BY id, topic),
passed AS (SELECT id, topic, round(score + CASE WHEN computational AND NOT hit AND {_CALC} THEN 1 ELSE 0 END, 6) AS score, computational
 FROM summed JOIN docs USING (id)),
top AS (SELECT id, topic, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS INTEGER) AS rank, computational
 FROM passed WHERE score >= CASE WHEN computational THEN 3 ELSE 2 END)"""
_CORPUS_PHRASES = f""", title_phrases AS (SELECT DISTINCT topic, phrase FROM (
  SELECT topic, lower(topic) AS phrase FROM topics UNION ALL
  SELECT topic, trim(unnest(regexp_split_to_array(lower(regexp_replace(topic, {_CODED}, '')), '\\s+and\\s+|,\\s*')))
  FROM topics) WHERE length(phrase) > 3)"""


def _exam(spark, sf):
    return t.exam_texts(spark, sf).select("id", "text")


def _flags(texts):
    return texts.select("id", ft.is_computational(F.col("text")).alias("computational"))


@query("match_keywords", f"WITH {_CORPUS_DOCS} {MATCH_SQL} SELECT id, keyword, match FROM matches WHERE match IS NOT NULL")
def _(spark, sf):
    return cl.match_keywords(t.texts(spark, sf), t.keywords(spark, sf))


@query("match_title_keywords", f"WITH {_EXAM_DOCS} {MATCH_SQL} SELECT id, keyword, match FROM matches WHERE match IS NOT NULL")
def _(spark, sf):
    return cl.match_keywords(_exam(spark, sf), _exam_dictionary(spark)[1])


@query("score_keywords", f"WITH {_EXAM_DOCS} {SCORE_SQL} SELECT id, topic, round(score, 6) AS score FROM scores")
def _(spark, sf):
    texts, words = _exam(spark, sf), _exam_dictionary(spark)[1]
    found = cl.gather_words(texts, cl.keyword_words(words), words)
    scored = cl.score_keywords(cl.match_keywords(texts, words, found), words, _flags(texts))
    return scored.select("id", "topic", F.round("score", 6).alias("score"))


@query("concept_bonus", f"WITH {_CORPUS_DOCS} {SCORE_SQL} SELECT id, topic, bonus FROM bonus")
def _(spark, sf):
    return cl.concept_bonus(t.texts(spark, sf), t.concepts(spark, sf))


@query("direct_mention_bonus", f"WITH {_EXAM_DOCS} {MENTION_SQL} SELECT id, topic, bonus FROM mentions")
def _(spark, sf):
    return cl.direct_mention_bonus(_exam(spark, sf), tax.taxonomy(spark))


@query("top_topics_by_keywords", f"""WITH {_EXAM_DOCS} {SCORE_SQL} {MENTION_SQL} {TOP_SQL}
 SELECT id, rank, topic, score FROM top WHERE rank <= CASE WHEN computational THEN 2 ELSE 3 END""")
def _(spark, sf):
    _, words, concepts = _exam_dictionary(spark)
    return cl.top_topics_by_keywords(_exam(spark, sf), words, concepts).withColumn("score", F.round("score", 6))


@query("top_topics_of_documents", f"""WITH {_CORPUS_DOCS} {_CORPUS_PHRASES} {SCORE_SQL} {MENTION_SQL} {TOP_SQL}
 SELECT id, rank, topic, score FROM top WHERE rank <= CASE WHEN computational THEN 2 ELSE 3 END""")
def _(spark, sf):
    return cl.top_topics_by_keywords(t.texts(spark, sf), t.keywords(spark, sf), t.concepts(spark, sf)).withColumn(
        "score", F.round("score", 6))


def _fallback_sql(low):
    def rules(table, condition):
        return [f"WHEN {condition} AND {' AND '.join(f'contains({low}, {w!r})' for w in words)} THEN '{topic}'"
                for words, topic in table]

    chain = rules(cl.FALLBACK_CALCULATION, any_sql(low, ["calculate", "work out"]))
    chain += rules(cl.FALLBACK_DRAWING, any_sql(low, ["draw", "diagram"]))
    chain += [f"WHEN contains({low}, 'supply') AND NOT contains({low}, 'demand') THEN '{cl.FALLBACK_SUPPLY}'"]
    chain += rules(cl.FALLBACK_TERMS, "true")
    return "CASE " + " ".join(chain) + f" ELSE '{cl.FALLBACK_DEFAULT}' END"


@query("fallback_topic", f"WITH {t.EXAM_TEXTS_SQL} SELECT id, {_fallback_sql('lower(text)')} AS topic FROM exam_texts")
def _(spark, sf):
    return _exam(spark, sf).select("id", cl.fallback_topic(F.col("text")).alias("topic"))


@query("parse_topic_labels", f"""WITH {t.LABEL_ANSWERS_SQL}, lines AS (SELECT batch_id, 1 AS question_no, l1 AS l FROM label_answers
  UNION ALL SELECT batch_id, 2, l2 FROM label_answers),
 flat AS (SELECT batch_id, question_no, unnest(l) AS label, generate_subscripts(l, 1) AS pos FROM lines)
 SELECT batch_id, question_no, CAST(pos - 1 AS INTEGER) AS pos, regexp_replace(label, '[()]', '', 'g') AS label FROM flat""")
def _(spark, sf):
    parsed = lb.parse_topic_labels(t.label_answers(spark, sf))
    return parsed.select("batch_id", "question_no", F.posexplode("labels").alias("pos", "label"))


@query("parse_topic_labels_parity", f"""WITH {t.LABEL_ANSWERS_SQL}, lines AS (
  SELECT batch_id, 1 AS question_no, l1[1] || ', ' || l1[2] AS s FROM label_answers
  UNION ALL SELECT batch_id, 2, l2[1] || ' and ' || l2[2] FROM label_answers),
 cut AS (SELECT batch_id, question_no, [x FOR x IN regexp_split_to_array(regexp_replace(s, '[()]', '', 'g'),
  '\\s*[,;]\\s*|\\s+and\\s+') IF regexp_matches(x, '^\\d+\\.\\d+\\.\\d+\\s+.+') AND length(x) > 5] AS l FROM lines)
 SELECT batch_id, question_no, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS label FROM cut""")
def _(spark, sf):
    parsed = lb.parse_topic_labels(t.label_answers(spark, sf), parity=True)
    return parsed.select("batch_id", "question_no", F.posexplode("labels").alias("pos", "label"))


def _clean_label_sql(marks):
    expr = f"regexp_replace(trim(label), '{marks}', '', 'g')"
    for lead in lb.LABEL_LEAD_INS:
        expr = f"regexp_replace({expr}, '{lead}', '', 'g')"
    return expr


_MARKS_ALL, _MARKS_QUOTES = "[\"''.-]", "[\"'']"
_OVERLAP_SQL = f""", lab AS (SELECT DISTINCT label, {_clean_label_sql(_MARKS_ALL)} AS c, trim({_clean_label_sql(_MARKS_QUOTES)}) AS k FROM labels),
 tw AS (SELECT topic, ord, [w FOR w IN regexp_split_to_array(lower(topic), '\\s+') IF length(w) > 3] AS w FROM topics),
 overlap AS (SELECT label, topic, ord, 2 AS step FROM lab JOIN tw ON
  len([x FOR x IN w IF list_contains(regexp_split_to_array(lower(c), '\\s+'), x)]) / CAST(len(w) AS DOUBLE) >= 0.5)"""
_NORMAL_SQL = _OVERLAP_SQL + """, found AS (SELECT * FROM overlap
  UNION ALL SELECT label, topic, ord, 0 FROM lab JOIN topics ON lower(k) = lower(topic)
  UNION ALL SELECT label, topic, ord, 1 FROM lab JOIN topics ON split_part(topic, ' ', 1) = regexp_extract(k, '^\\d+\\.\\d+\\.\\d+', 0)
   AND length(k) > length(split_part(topic, ' ', 1)))"""


@query("normalize_topic_label", f"""WITH {t.LABELS_SQL} {_NORMAL_SQL} SELECT label, arg_min(topic, step * 1000 + ord) AS topic
 FROM found GROUP BY label""")
def _(spark, sf):
    return lb.normalize_topic_label(t.labels(spark, sf), tax.taxonomy(spark))


@query("normalize_topic_label_parity", f"""WITH {t.LABELS_SQL} {_OVERLAP_SQL} SELECT label, arg_min(topic, ord) AS topic
 FROM overlap GROUP BY label""")
def _(spark, sf):
    return lb.normalize_topic_label(t.labels(spark, sf), tax.taxonomy(spark), parity=True)


def _asked(spark, sf):
    """Three candidate topics for each exam text."""
    rows = t.exam_texts(spark, sf).withColumn("names", F.expr(t._topic_array()))
    spots = ["l_suppkey % 87", "l_partkey % 87", "(l_partkey + l_suppkey) % 87"]
    candidates = F.array(*[F.expr(f"names[cast({s} as int)]") for s in spots])
    return rows.select("id", "text", F.array_distinct(candidates).alias("candidates"))


def _pairs(spark, sf):
    text = F.col("text")
    return _asked(spark, sf).select("id", "text", ft.is_computational(text).alias("computational"), ft.estimate_marks(text).alias("est_marks"),
                                    F.posexplode("candidates").alias("pos", "topic"))


_PAIRS_SQL = t.EXAM_TEXTS_SQL + _TITLES_SQL + f""", spots AS (
  SELECT *, 0 AS pos, l_suppkey % 87 AS o FROM exam_texts UNION ALL SELECT *, 1, l_partkey % 87 FROM exam_texts
  UNION ALL SELECT *, 2, (l_partkey + l_suppkey) % 87 FROM exam_texts),
 pairs AS (SELECT id, text, lower(text) AS low, {any_sql('lower(text)', ft.COMPUTATIONAL)} AS computational,
  {estimate_sql('text')} AS est_marks, topic, min(pos) AS pos FROM spots JOIN topics ON ord = o GROUP BY ALL)"""
_RELEVANT = " OR ".join(
    [f"(contains(low, '{w}') AND contains(topic, '{p}'))" for w, p in lb.CALCULATION_MATCHES]
    + [f"({any_sql('low', ['supply', 'demand'])} AND {any_sql('topic', ['Supply', 'Demand'])})"])
_QUALITY_SQL = f"""(topic <> '{lb.ECONOMIC_PROBLEM}' OR {any_sql('low', ft.SCARCITY)}) AND (NOT computational OR {_RELEVANT})
  AND (NOT contains(topic, 'Government intervention') OR {any_sql('low', lb.INTERVENTION_WORDS)})
  AND (NOT contains(topic, 'market failure') OR {any_sql('low', lb.FAILURE_WORDS)})"""


@query("quality_filter", f"WITH {_PAIRS_SQL} SELECT id, topic FROM pairs WHERE {_QUALITY_SQL}")
def _(spark, sf):
    return lb.quality_filter(_pairs(spark, sf)).select("id", "topic")


_MENTION = " OR ".join(["contains(low, ' ' || k || ' ')", "starts_with(low, k || ' ')", "ends_with(low, ' ' || k)",
                        "contains(low, ' ' || k || ',')", "contains(low, ' ' || k || '.')", "contains(low, '(' || k || ')')",
                        "(length(k) > 5 AND contains(low, k))"])
_RELEVANCE_TAIL = f""", profiles AS (SELECT topic, [w FOR w IN regexp_split_to_array(regexp_replace(b, '[(),]', '', 'g'), '\\s+')
   IF length(w) > 3] AS words, (SELECT list(keyword) FROM keywords k WHERE k.topic = bare.topic) AS kws FROM bare),
 hits AS (SELECT p.*, CASE WHEN contains(low, lower(topic)) THEN 10 ELSE 0 END AS title,
   len([w FOR w IN words IF contains(low, w)]) AS h, least(len([k FOR k IN kws IF {_MENTION}]), 5) AS l
  FROM pairs p JOIN profiles USING (topic)),
 rated AS (SELECT *, 1 + title + h * 2 + CASE WHEN h > 1 THEN 3 ELSE 0 END + l AS base FROM hits),
 relevance AS (SELECT *, CASE WHEN topic IN ({', '.join(repr(x) for x in lb.OVERUSED)}) AND base < 8 THEN base * 0.7::DOUBLE
   ELSE base END + CASE WHEN est_marks >= 10 AND {any_sql('topic', lb.COMPLEX)} THEN 1.5::DOUBLE ELSE 0 END AS score FROM rated)"""
_RELEVANCE_SQL = _PAIRS_SQL + _RELEVANCE_TAIL


@query("score_relevance", f"WITH {_RELEVANCE_SQL} SELECT id, topic, CAST(round(score, 6) AS DOUBLE) AS score FROM relevance")
def _(spark, sf):
    topics, words, _ = _exam_dictionary(spark)
    scored = lb.score_relevance(lb.gather_pairs(_asked(spark, sf)), topics, words)
    scored = scored.by_pair() if isinstance(scored, lb.Asked) else scored
    return scored.select("id", "topic", F.round("score", 6).alias("score"))


_FUNDAMENTAL = any_sql("x", lb.FUNDAMENTAL)
_SELECT_TAIL = f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS rn,
   CASE WHEN est_marks <= 2 THEN 2 WHEN est_marks <= 5 THEN 3 ELSE 4 END AS lim, CASE WHEN computational THEN 3 ELSE 2 END AS floor
  FROM relevance WHERE {_QUALITY_SQL}),
 chosen AS (SELECT id, coalesce(list(topic ORDER BY rn) FILTER (rn <= lim AND score > floor), [arg_min(topic, pos)]) AS t
  FROM ranked GROUP BY id),
 consistent AS (SELECT id, [x FOR x IN list_concat([x FOR x IN t IF {_FUNDAMENTAL}], [x FOR x IN t IF NOT {_FUNDAMENTAL}])
   IF NOT (x = '{lb.GENERAL_DEMAND}' AND len([y FOR y IN t IF {any_sql('y', lb.SPECIFIC_DEMAND)}]) > 0)
   AND NOT (x = '{lb.GENERAL_SUPPLY}' AND len(t) > 2 AND len([y FOR y IN t IF {any_sql('y', lb.SPECIFIC_SUPPLY)}]) > 0)] AS topics
  FROM chosen)"""
_SELECT_SQL = _RELEVANCE_SQL + _SELECT_TAIL


@query("select_topics", f"WITH {_SELECT_SQL} SELECT id, array_to_string(topics, '|') AS topics FROM consistent")
def _(spark, sf):
    topics, words, _ = _exam_dictionary(spark)
    scored = lb.score_relevance(lb.quality_filter(lb.gather_pairs(_asked(spark, sf))), topics, words)
    return lb.select_topics(scored).select("id", F.array_join("topics", "|").alias("topics"))


def _masked_exam(spark, sf):
    texts = t.exam_texts(spark, sf)
    questions = texts.select(F.col("id").alias("question_id"), F.col("text").alias("question_text"),
                             F.lit(None).cast("array<string>").alias("topics"))
    names = F.expr(t._topic_array())
    offered = texts.filter("l_partkey % 3 <> 0").withColumn("names", names).selectExpr(
        "id as question_id", "array(names[cast(l_suppkey % 87 as int)], names[cast(l_partkey % 87 as int)], "
                             "concat('Topic: ', l_partkey)) as labels")
    return questions, offered


def _assign_sql(parity, suggested="l_partkey % 3 <> 0"):
    """The cascade: suggested labels, then keywords, then the fallback rules, each for what is still open."""
    flag = any_sql("lower(text)" if parity else "lower(raw)", ft.COMPUTATIONAL)
    labels = (", labels AS (SELECT topic AS label FROM topics)" + _OVERLAP_SQL + """, meant AS (SELECT label, arg_min(topic, ord) AS topic
  FROM overlap GROUP BY label)""" if parity else ", meant AS (SELECT topic AS label, topic FROM topics)")
    offered = " UNION ALL ".join(f"SELECT *, {pos} AS pos, {key} % 87 AS o FROM masked WHERE {suggested}"
                                 for pos, key in enumerate(("l_suppkey", "l_partkey")))
    return f"""WITH {t.EXAM_TEXTS_SQL}{_TITLES_SQL}, masked AS MATERIALIZED (SELECT id, l_partkey, l_suppkey, text, {flag} AS computational
  FROM (SELECT id, l_partkey, l_suppkey, text AS raw, {mask_sql('text')} AS text FROM exam_texts)),
 docs AS (SELECT id, lower(text) AS text, computational FROM masked){labels},
 pairs AS (SELECT id, text, lower(text) AS low, computational, {estimate_sql('text', parity)} AS est_marks, meant.topic, min(pos) AS pos
  FROM ({offered}) JOIN topics ON ord = o JOIN meant ON meant.label = topics.topic GROUP BY ALL)
 {_RELEVANCE_TAIL}{_SELECT_TAIL}{SCORE_SQL}{MENTION_SQL}{TOP_SQL},
 by_words AS (SELECT id, list(topic ORDER BY rank) AS topics FROM top WHERE rank <= CASE WHEN computational THEN 2 ELSE 3 END
  {"AND id IN (SELECT id FROM pairs)" if parity else ""} GROUP BY id)
 SELECT m.id AS question_id, array_to_string(coalesce(c.topics, w.topics, [{_fallback_sql('lower(m.text)')}]), '|') AS topics,
  CASE WHEN c.id IS NOT NULL THEN 'suggested' WHEN w.id IS NOT NULL THEN 'keywords' ELSE 'fallback' END AS method
 FROM masked m LEFT JOIN consistent c ON c.id = m.id LEFT JOIN by_words w ON w.id = m.id"""


@query("assign_topics", _assign_sql(False))
def _(spark, sf):
    topics, words, concepts = _exam_dictionary(spark)
    questions, offered = _masked_exam(spark, sf)
    assigned = lb.assign_topics(questions, topics, words, concepts, offered)
    return assigned.select("question_id", F.array_join("topics", "|").alias("topics"), "method")


@query("assign_topics_parity", _assign_sql(True))
def _(spark, sf):
    topics, words, concepts = _exam_dictionary(spark)
    questions, offered = _masked_exam(spark, sf)
    assigned = lb.assign_topics(questions, topics, words, concepts, offered, parity=True)
    return assigned.select("question_id", F.array_join("topics", "|").alias("topics"), "method")


@query("tags_of_replayed_bank", _assign_sql(False, "false").replace("m.id AS question_id", "m.id AS question_file"))
def _(spark, sf):
    """A bank that comes in two runs, two thirds of its questions in both; each question is tagged once."""
    topics, words, concepts = _exam_dictionary(spark)
    folder = scratch_folder(spark)
    bank = t.exam_texts(spark, sf).select(
        F.lit("1").alias("questionNumber"), F.lit("2020").alias("year"), F.lit("EDEXCEL").alias("board"), F.col("text").alias("questionText"),
        F.lit("alevel").alias("qualification"), F.col("id").alias("questionFile"), "l_partkey")
    offered = spark.createDataFrame([], "question_id string, labels array<string>")
    for part in (bank.filter("l_partkey % 3 <> 0"), bank):
        part.drop("l_partkey").write.mode("append").option("compression", "gzip").json(f"{folder}/bank")
        tag_each_question_once(spark, f"{folder}/bank", f"{folder}/tags", f"{folder}/seen", topics, words, concepts, offered).awaitTermination()
    tags = spark.read.schema("question_file string, topics array<string>, method string").parquet(f"{folder}/tags/epoch=*")
    return tags.select("question_file", F.array_join("topics", "|").alias("topics"), "method")
