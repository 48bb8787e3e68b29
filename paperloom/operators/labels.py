"""Suggested topic labels: parsing answers, normalising, filtering, scoring and the tagging cascade."""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.features import (allows_economic_problem, contains_any, estimate_marks,
                                          is_computational, max_topics)
from paperloom.functions.text import mask_phrases
from paperloom.operators import wordplaces
from paperloom.operators.classify import (best_topics, fallback_topic, find_words, fits_broadcast, hits_of_copies, matched, spoken_words, tagging_words,
                                          top_topics_by_keywords)
from paperloom.operators.taxonomy import CODED
from paperloom.plans.packed import gathered
from paperloom.plans.scale import cut_lineage, stored_table

# Answer shape, lead-ins and limits.
ANSWER_LINE = r"(?i)Question\s+(\d+)\s*:\s*([^\n\r]+)"
LABEL_SHAPE = r"^\d+\.\d+\.\d+\s+.+"
SINGLE_LEAD_IN = r"(?i)\b(topics?:?|the topics? (?:are?|is):?|relevant topics?:?)\s*"
LINE_LEAD_IN = r"(?i)\b(topics?:?|the topics? (?:are?|is):?)\s*"
LABEL_LEAD_INS = [r"(?i)Topic:?\s*", r"(?i)The topic is:?\s*", r"(?i)The main topic is:?\s*",
                  r"(?i)The primary topic is:?\s*"]
PARITY_LABELS = 100

# Relevance rules and scores.
CALCULATION_MATCHES = [("elasticity", "elasticities"), ("revenue", "Revenue"), ("cost", "Costs"),
                       ("profit", "profit"), ("tax", "taxes"), ("gdp", "Economic growth"),
                       ("unemployment", "unemployment"), ("inflation", "Inflation")]
INTERVENTION_WORDS = ["government", "policy", "regulation", "intervention"]
FAILURE_WORDS = ["market failure", "externality", "public good", "information gap"]
ECONOMIC_PROBLEM = "1.1.3 The economic problem"
OVERUSED = ["1.1.3 The economic problem", "1.2.6 Price determination", "1.2.2 Demand"]
COMPLEX = ["Oligopoly", "Monopoly", "game theory", "macroeconomic", "policies", "development", "globalisation"]
FUNDAMENTAL = ["Demand", "Supply", "Price determination", "Economics as a social science"]
SPECIFIC_DEMAND = ["elasticities of demand", "Consumer and producer surplus"]
SPECIFIC_SUPPLY = ["Elasticity of supply"]
GENERAL_DEMAND, GENERAL_SUPPLY = "1.2.2 Demand", "1.2.4 Supply"


def split_labels(text: Column, parity: bool = False, lead_in: str = LINE_LEAD_IN) -> Column:
    """Labels of an answer line, in order.

    A label starts at a topic code and runs to the next one, so commas and "and"
    inside topic names stay. With `parity` every comma, semicolon and "and" cuts.
    """
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(text, "[\"'()]", ""), lead_in, ""))
    if parity:
        raw = F.split(cleaned, r"\s*[,;]\s*|\s+and\s+")
    else:
        raw = F.transform(F.split(cleaned, r"(?=\b\d+\.\d+\.\d+\s)"),
                          lambda p: F.regexp_replace(p, r"(\s|[,;]|\band\s*$)+$", ""))
    return F.filter(F.transform(raw, lambda p: F.trim(p)), lambda p: (F.length(p) > 5) & p.rlike(LABEL_SHAPE))


def parse_topic_labels(answers: DataFrame, parity: bool = False) -> DataFrame:
    """(batch_id, question_no, labels) from answers with one "Question N: ..." line per question.

    `answers` has batch_id, answer and n_questions. Numbers beyond the batch are
    dropped, the last usable line of a number wins. With `parity` a line gives its
    first 100 labels.
    """
    lines = F.arrays_zip(F.regexp_extract_all("answer", F.lit(ANSWER_LINE), F.lit(1)).alias("n"),
                         F.regexp_extract_all("answer", F.lit(ANSWER_LINE), F.lit(2)).alias("body"))
    rows = answers.select("batch_id", "n_questions", F.posexplode(lines).alias("line", "l")).select(
        "batch_id", "n_questions", "line", F.col("l.n").try_cast("int").alias("question_no"),
        split_labels(F.col("l.body"), parity).alias("labels"))
    usable = rows.filter((F.col("question_no") > 0) & (F.col("question_no") <= F.col("n_questions"))
                         & (F.size("labels") > 0))
    labels = F.slice("labels", 1, PARITY_LABELS) if parity else F.col("labels")
    return usable.groupBy("batch_id", "question_no").agg(F.max_by(labels, "line").alias("labels"))


def parse_single_answer(answer: Column, parity: bool = False) -> Column:
    """Labels of an answer about one question."""
    return split_labels(F.coalesce(answer, F.lit("")), parity, SINGLE_LEAD_IN)


def _clean_label(label: Column, marks: str) -> Column:
    cleaned = F.regexp_replace(F.trim(label), marks, "")
    for lead_in in LABEL_LEAD_INS:
        cleaned = F.regexp_replace(cleaned, lead_in, "")
    return cleaned


def normalize_topic_label(labels: DataFrame, topics: DataFrame, parity: bool = False) -> DataFrame:
    """(label, topic): the taxonomy topic each distinct label stands for.

    The full title or the leading code decides; else the first topic in list
    order half of whose words of more than 3 characters are in the label. Labels
    that fit no topic are left out. With `parity` dots are dropped before the
    comparison, so only the word test can succeed.
    """
    distinct = labels.select("label").filter(F.trim("label") != "").distinct()
    words = topics.select("topic", "ord", F.filter(F.split(F.lower("topic"), r"\s+"), lambda w: F.length(w) > 3).alias("w"))
    wanted = words.select("topic", "ord", F.size("w").alias("n_words"), F.explode("w").alias("word"))
    counted = wanted.groupBy("topic", "ord", "n_words", "word").agg(F.count("*").alias("times"))
    said = distinct.select("label", F.explode(F.array_distinct(
        F.split(F.lower(_clean_label(F.col("label"), "[\"'.-]")), r"\s+"))).alias("word"))
    overlaps = (said.join(counted, "word").groupBy("label", "topic", "ord", "n_words")
                .agg(F.sum("times").alias("hits")).filter(F.col("hits") / F.col("n_words") >= 0.5)
                .select("label", F.lit(2).alias("step"), "ord", "topic"))
    found = overlaps
    if not parity:
        kept = distinct.withColumn("kept", F.trim(_clean_label(F.col("label"), "[\"']")))
        titles = topics.withColumn("kept", F.lower("topic"))
        exact = kept.withColumn("kept", F.lower("kept")).join(titles, "kept").select(
            "label", F.lit(0).alias("step"), "ord", "topic")
        codes = topics.withColumn("code", F.substring_index("topic", " ", 1))
        by_code = kept.withColumn("code", F.regexp_extract("kept", CODED, 0)).filter(
            (F.col("code") != "") & (F.length("kept") > F.length("code"))).join(codes, "code").select(
            "label", F.lit(1).alias("step"), "ord", "topic")
        found = overlaps.unionByName(exact).unionByName(by_code)
    return found.groupBy("label").agg(F.min(F.struct("step", "ord", "topic")).getField("topic").alias("topic"))


def validated_topics(suggestions: DataFrame, topics: DataFrame, parity: bool = False) -> DataFrame:
    """(id, candidates): distinct topics of each id's labels in label order, at most the taxonomy's.

    `suggestions` has id and labels, any number of them. Ids without any valid label are left out.
    """
    rows = suggestions.select("id", F.posexplode("labels").alias("pos", "label"))
    named = rows.join(normalize_topic_label(rows, topics, parity), "label")
    firsts = named.groupBy("id", "topic").agg(F.min("pos").alias("pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "topic"))), lambda s: s["topic"])
    return firsts.groupBy("id").agg(ordered.alias("candidates"))


def passes_quality(topic: Column, text: Column, computational: Column) -> Column:
    """False for topics a text does not ask about: see the fixed word lists."""
    low = F.lower(text)
    both = (low.contains("supply") | low.contains("demand")) & contains_any(topic, ["Supply", "Demand"])
    relevant = both
    for word, part in CALCULATION_MATCHES:
        relevant = relevant | (low.contains(word) & topic.contains(part))
    return (((topic != ECONOMIC_PROBLEM) | allows_economic_problem(text, F.lit(5)))
            & (~computational | relevant)
            & (~topic.contains("Government intervention") | contains_any(low, INTERVENTION_WORDS))
            & (~topic.contains("market failure") | contains_any(low, FAILURE_WORDS)))


class Asked(NamedTuple):
    """Candidate topics gathered by id: (id, texts, pairs), the texts of all copies and a struct for each text and candidate.

    A pair has text, computational, est_marks, pos and topic; once scored, a score and no text.
    """

    rows: DataFrame

    def by_pair(self) -> DataFrame:
        return self.rows.select("id", F.inline("pairs"))


def candidate_pairs(texts: Column, parity: bool = False) -> Column:
    """The pairs of a list of (text, computational, candidates)."""
    seen = F.transform(texts, lambda r: F.struct(r["text"], r["computational"], estimate_marks(r["text"], parity).alias("est_marks"), r["candidates"]))
    return F.flatten(F.transform(seen, lambda r: F.transform(r["candidates"], lambda topic, pos: F.struct(
        r["text"].alias("text"), r["computational"].alias("computational"), r["est_marks"].alias("est_marks"), pos.alias("pos"), topic.alias("topic")))))


def gather_pairs(asked: DataFrame) -> Asked:
    """The pairs of texts with lists of candidate topics; `asked` has id, text and candidates, and each row moves once."""
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = gathered(asked.select("id", "text", "candidates"), "id", tasks)
    seen = F.transform("rows", lambda r: F.struct(r["text"], is_computational(r["text"]).alias("computational"), r["candidates"]))
    return Asked(rows.select("id", F.col("rows.text").alias("texts"), candidate_pairs(seen).alias("pairs")))


def _of_quality(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: passes_quality(p["topic"], p["text"], p["computational"]))


def quality_filter(pairs: DataFrame | Asked) -> DataFrame | Asked:
    """Pairs (id, text, computational, topic, ...) whose topic the text is about."""
    if isinstance(pairs, Asked):
        return Asked(pairs.rows.withColumn("pairs", _of_quality(F.col("pairs"))))
    return pairs.filter(passes_quality(F.col("topic"), F.col("text"), F.col("computational")))


def topic_profiles(topics: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic, word, use, times): the title, its words of more than 3 characters and the keywords of each topic."""
    bare = F.lower(F.regexp_replace("topic", CODED + r"\s+", ""))
    words = F.filter(F.split(F.regexp_replace(bare, "[(),]", ""), r"\s+"), lambda w: F.length(w) > 3)
    listed = keywords.join(topics.select("topic"), "topic", "left_semi").select(
        "topic", F.lower("keyword").alias("word"), F.lit("keyword").alias("use"))
    rows = (topics.select("topic", F.lower("topic").alias("word"), F.lit("title").alias("use"))
            .unionByName(topics.select("topic", F.explode(words).alias("word"), F.lit("title word").alias("use")))
            .unionByName(listed))
    return rows.groupBy("topic", "word", "use").agg(F.count("*").alias("times"))


def _relevance(base: Column, topic: Column, est_marks: Column) -> Column:
    """The score of a topic by what the text has of its words, toned down if overused, with a bonus if complex."""
    toned = F.when(topic.isin(OVERUSED) & (base < 8.0), base * 0.7).otherwise(base)
    return toned + F.when((est_marks >= 10) & contains_any(topic, COMPLEX), 1.5).otherwise(0.0)


def _rated_pairs(pairs: Column, hits: Column, words: list[str], topics: DataFrame, profiles: DataFrame) -> Column:
    """The pairs of known topics with their scores, the text dropped, by the hits of all copies."""
    names = sorted(r["topic"] for r in topics.select("topic").distinct().dropna().collect())
    uses = {"title": 0, "title word": 1, "keyword": 2}
    listed = [(r["word"], r["topic"], uses[r["use"]], r["times"]) for r in profiles.dropna().collect()]
    # Not to be moved by the planner, which would else rate once more to leave out empty lists before they are told apart.
    rate = F.arrow_udf(wordplaces.rater(wordplaces.listing(words, listed, names), names), "array<double>").asNondeterministic()
    based = F.zip_with(pairs, rate(hits, F.transform(pairs, lambda p: p["topic"])), lambda p, base: F.struct(
        p["computational"].alias("computational"), p["est_marks"].alias("est_marks"), p["pos"].alias("pos"), p["topic"].alias("topic"), base.alias("base")))
    return F.transform(F.filter(based, lambda p: p["base"].isNotNull()), lambda p: F.struct(
        p["computational"].alias("computational"), p["est_marks"].alias("est_marks"), p["pos"].alias("pos"), p["topic"].alias("topic"),
        _relevance(p["base"], p["topic"], p["est_marks"]).alias("score")))


def score_relevance(pairs: DataFrame | Asked, topics: DataFrame, keywords: DataFrame, texts: DataFrame | None = None,
                    found: DataFrame | None = None) -> DataFrame | Asked:
    """pairs (id, text, topic, est_marks, ...) with `score`, the text dropped.

    `texts` (id, text) holds each text once, else the pairs' are folded; `found`
    is `find_words` over the words of `topic_profiles`. Hits are counted per
    text and topic on the found words, so no text meets a topic. Pairs gathered by
    id stay gathered and bring their texts along, unless the dictionary is beyond
    the broadcast limit.
    """
    profiles = topic_profiles(topics, keywords)
    if isinstance(pairs, Asked):
        spoken = spoken_words(profiles.select("word"), profiles)
        if spoken is not None:
            none = F.array().cast("array<string>")
            hits, words = hits_of_copies(F.when(F.col("id").isNull(), none).otherwise(F.col("texts")), spoken)
            rows = pairs.rows.withColumn("hits", hits)
            return Asked(rows.select("id", "texts", _rated_pairs(F.col("pairs"), F.col("hits"), words, topics, profiles).alias("pairs")))
        texts = pairs.rows.select("id", F.explode("texts").alias("text"))
        pairs = pairs.by_pair()
    if found is None:
        texts = pairs.select("id", "text").dropDuplicates(["id"]) if texts is None else texts
        found = find_words(texts, profiles)
    use, times = F.col("use"), F.col("times")
    counts = found.filter("present").join(profiles, "word").groupBy("id", "topic").agg(
        F.max(F.when(use == "title", 10.0)).alias("title"), F.sum(F.when(use == "title word", times)).alias("hits"),
        F.sum(F.when((use == "keyword") & F.col("mention"), times)).alias("listed"))
    zero = F.lit(0).cast("long")
    hits = F.coalesce("hits", zero)
    base = (F.lit(1.0) + F.coalesce("title", F.lit(0.0)) + hits * 2.0 + F.when(hits > 1, 3.0).otherwise(0.0)
            + F.least(F.coalesce("listed", zero), F.lit(5)))
    known = pairs.drop("text").join(topics.select("topic"), "topic", "left_semi")
    return (known.join(counts, ["id", "topic"], "left").withColumn("base", base)
            .withColumn("score", _relevance(F.col("base"), F.col("topic"), F.col("est_marks"))).drop("title", "hits", "listed", "base"))


def consistent_topics(topics: Column) -> Column:
    """Fundamental topics first; general demand and supply give way to specific topics."""
    ordered = F.concat(F.filter(topics, lambda t: contains_any(t, FUNDAMENTAL)),
                       F.filter(topics, lambda t: ~contains_any(t, FUNDAMENTAL)))
    has_demand = F.exists(topics, lambda t: contains_any(t, SPECIFIC_DEMAND))
    has_supply = F.exists(topics, lambda t: contains_any(t, SPECIFIC_SUPPLY)) & (F.size(topics) > 2)
    return F.filter(ordered, lambda t: ~((t == GENERAL_DEMAND) & has_demand) & ~((t == GENERAL_SUPPLY) & has_supply))


def _chosen(ranked: Column, first: Column, est_marks: Column, computational: Column) -> Column:
    """The topics of a list (neg, topic), the best first, or the first candidate."""
    floor = F.when(computational, 3.0).otherwise(2.0)
    best = F.transform(F.filter(F.slice(ranked, F.lit(1), max_topics(est_marks)),
                                lambda s: -s["neg"] > floor), lambda s: s["topic"])
    return consistent_topics(F.when(F.size(best) > 0, best).otherwise(F.array(first)))


def _chosen_of_pairs(pairs: Column) -> Column:
    """The topics chosen among scored pairs; NULL if there are none."""
    ranked = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["score"]).alias("neg"), p["topic"].alias("topic"))))
    first = F.array_min(F.transform(pairs, lambda p: F.struct(p["pos"].alias("pos"), p["topic"].alias("topic"))))["topic"]
    one = F.get(pairs, 0)
    return F.when(F.size(pairs) > 0, _chosen(ranked, first, one["est_marks"], one["computational"]))


def select_topics(scored: DataFrame | Asked) -> DataFrame:
    """(id, topics) from (id, topic, pos, score, est_marks, computational).

    Best scores up to the limit for the marks, above 2 (3 for calculations); the
    first candidate when none is above. Ties go to the lower topic string. An id
    has no more candidates than there are topics, so its list is bounded.
    """
    if isinstance(scored, Asked):
        return scored.rows.filter(F.size("pairs") > 0).select("id", _chosen_of_pairs(F.col("pairs")).alias("topics"))
    lists = scored.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "topic"))).alias("ranked"),
        F.min_by("topic", "pos").alias("first"), F.first("est_marks").alias("est_marks"),
        F.first("computational").alias("computational"))
    return lists.select("id", _chosen(F.col("ranked"), F.col("first"), F.col("est_marks"), F.col("computational")).alias("topics"))


def validate_suggestions(texts: DataFrame, suggestions: DataFrame, topics: DataFrame, keywords: DataFrame,
                         parity: bool = False, found: DataFrame | None = None) -> DataFrame:
    """(id, valid, topics): topics chosen among each id's suggested labels.

    `texts` has id, text and computational. `valid` tells whether any label was
    valid; `topics` is NULL when none was left by the quality filter.
    """
    candidates = validated_topics(suggestions, topics, parity)
    asked = texts.join(suggestions.select("id"), "id", "left_semi").join(candidates, "id", "left")
    pairs = asked.filter(F.col("candidates").isNotNull()).select(
        "id", "text", "computational", estimate_marks(F.col("text"), parity).alias("est_marks"),
        F.posexplode("candidates").alias("pos", "topic"))
    chosen = select_topics(score_relevance(quality_filter(pairs), topics, keywords, texts, found))
    return asked.select("id", F.col("candidates").isNotNull().alias("valid")).join(chosen, "id", "left")


def assign_topics(questions: DataFrame, topics: DataFrame, keywords: DataFrame, concepts: DataFrame,
                  suggestions: DataFrame, parity: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """(question_id, topics, method, carried) of questions with a text and no topics yet.

    `suggestions` has question_id and labels. Suggested labels come first, then
    keywords, then the fallback rules for what is still open. With `parity`, a
    question without any valid label goes straight to the fallback, and
    calculations are recognised after masking. Each text is searched for the
    words of all steps once, and moves once, with the topics that its labels
    stand for, unless dictionary or labels are beyond the broadcast limit.
    `carried` names columns of the questions that come along; where copies of an id
    share a row, they are those of one of them.
    """
    untagged = questions.filter((F.coalesce(F.size("topics"), F.lit(-1)) <= 0)
                                & (F.coalesce("question_text", F.lit("")) != ""))
    offered = suggestions.select(F.col("question_id").alias("id"), "labels")
    profiles = topic_profiles(topics, keywords)
    words = tagging_words(keywords.select("topic").distinct(), keywords, concepts).unionByName(profiles.select("word"))
    spoken, meant = spoken_words(words, keywords, concepts, profiles), meant_labels(offered, topics, parity)
    if spoken is None or meant is None:
        done = _assigned_by_joins(untagged, topics, keywords, concepts, offered, words, parity)
        return done.join(untagged.select("question_id", *carried).dropDuplicates(["question_id"]), "question_id", "left") if carried else done
    said = F.arrow_udf(wordplaces.named_labels(meant), "array<string>")("labels")
    valid = F.filter(F.transform(said, lambda topic, pos: F.struct(pos.alias("pos"), topic.alias("topic"))), lambda s: s["topic"].isNotNull())
    asked = offered.filter("id is not null").select("id", F.lit(None).cast("string").alias("text"), valid.alias("said")).filter(F.size("said") > 0)
    kind = asked.schema["said"].dataType
    texts = untagged.select(F.col("question_id").alias("id"), F.col("question_text").alias("text"), F.lit(None).cast(kind).alias("said"), *carried)
    # Masking costs far more than the bytes of a text tell, so the tasks are given; what it leads to is stored.
    tasks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = gathered(texts.unionByName(asked, allowMissingColumns=True), "id", tasks).filter(F.exists("rows", lambda r: r["text"].isNotNull()))
    return stored_table(_assigned(rows, spoken, topics, keywords, concepts, profiles, parity, carried))


def meant_labels(offered: DataFrame, topics: DataFrame, parity: bool = False) -> dict[str, str] | None:
    """The topic of every label that stands for one, or None if they are beyond the broadcast limit."""
    named = cut_lineage(normalize_topic_label(offered.select(F.explode("labels").alias("label")), topics, parity))
    if not fits_broadcast(named.select(F.concat("label", "topic").alias("word"))):
        return None
    return {r["label"]: r["topic"] for r in named.collect()}


def _assigned(rows: DataFrame, spoken: list[str], topics: DataFrame, keywords: DataFrame, concepts: DataFrame, profiles: DataFrame,
              parity: bool, carried: tuple[str, ...]) -> DataFrame:
    """(question_id, topics, method, carried) by the steps of the cascade, of texts and suggested topics gathered by id."""
    def along(row: Column) -> list[Column]:
        return [row[c].alias(c) for c in carried]

    def tagged(found: Column, method: str, row: Column) -> Column:
        return F.struct(found.alias("topics"), F.lit(method).alias("method"), *along(row))

    own = F.transform(F.filter("rows", lambda r: r["text"].isNotNull()),
                      lambda r: F.struct(mask_phrases(r["text"]).alias("text"), r["text"].alias("raw"), *along(r)))
    flagged = F.transform(own, lambda r: F.struct(r["text"], is_computational(r["text"] if parity else r["raw"]).alias("computational"), *along(r)))
    # An id's distinct topics in the order of their first labels.
    in_order = F.array_sort(F.flatten(F.filter(F.transform("rows", lambda r: r["said"]), lambda s: s.isNotNull())))
    masked = rows.select("id", flagged.alias("texts"), F.array_distinct(F.transform(in_order, lambda s: s["topic"])).alias("candidates"))
    hits, words = hits_of_copies(F.col("texts.text"), spoken)
    seen = masked.select("id", "texts", "candidates", hits.alias("hits"))
    with_candidates = F.transform("texts", lambda r: F.struct(r["text"], r["computational"], F.col("candidates")))
    asked = seen.withColumn("pairs", _of_quality(candidate_pairs(with_candidates, parity)))
    rated = asked.withColumn("pairs", _rated_pairs(F.col("pairs"), F.col("hits"), words, topics, profiles))
    best = best_topics(matched(F.col("hits"), words, keywords), F.col("hits"), F.col("texts.computational"), words, keywords, concepts)
    judged = rated.select("id", "texts", "candidates", _chosen_of_pairs(F.col("pairs")).alias("suggested"), best.alias("best"))
    # Texts without an id are found in no table, so they are left to the fallback.
    open_to_words = F.col("suggested").isNull() & F.col("id").isNotNull() & (F.size("best") > 0)
    if parity:
        open_to_words = open_to_words & (F.size("candidates") > 0)
    by_copy = (F.when(F.size("suggested") > 0, F.transform("texts", lambda r: tagged(F.col("suggested"), "suggested", r)))
               .when(open_to_words, F.array(tagged(F.col("best.topic"), "keywords", F.get("texts", 0))))
               .otherwise(F.transform("texts", lambda r: tagged(F.array(fallback_topic(r["text"])), "fallback", r))))
    # Outer, though no list is empty, so that the planner does not make the lists once more to leave out empty ones.
    return judged.select(F.col("id").alias("question_id"), F.explode_outer(by_copy).alias("of")).select("question_id", "of.*")


def _assigned_by_joins(untagged: DataFrame, topics: DataFrame, keywords: DataFrame, concepts: DataFrame, offered: DataFrame, words: DataFrame,
                       parity: bool) -> DataFrame:
    """(question_id, topics, method) by the steps of the cascade, joined by id, for dictionaries and labels of any size."""
    # Masking costs far more than the bytes of a text tell, so the tasks are given, and its rows are stored for the steps below.
    tasks = int(untagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = untagged.select(F.col("question_id").alias("id"), "question_text").repartition(tasks, "id")
    masked = dealt.withColumn("text", mask_phrases(F.col("question_text")))
    texts = stored_table(masked.select("id", "text", is_computational(F.col("text" if parity else "question_text")).alias("computational")))
    found = find_words(texts, words)
    # Read by every later step, so it is stored once; it holds ids and topics only.
    judged = cut_lineage(validate_suggestions(texts, offered, topics, keywords, parity, found))
    settled = judged.filter(F.col("topics").isNotNull()).select("id", "topics")
    open_words = found.join(settled, "id", "left_anti")
    if parity:
        open_words = open_words.join(judged.filter("valid").select("id"), "id", "left_semi")
    ranked = top_topics_by_keywords(texts, keywords, concepts, open_words)
    by_words = ranked.groupBy("id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda s: s["topic"]).alias("topics"))
    steps = [(settled, "suggested"), (by_words, "keywords")]
    done = cut_lineage(reduce(DataFrame.unionByName, [
        df.filter(F.size("topics") > 0).select("id", "topics", F.lit(name).alias("method")) for df, name in steps]))
    fallback = texts.join(done, "id", "left_anti").select(
        "id", F.array(fallback_topic(F.col("text"))).alias("topics"), F.lit("fallback").alias("method"))
    return done.unionByName(fallback).select(F.col("id").alias("question_id"), "topics", "method")
