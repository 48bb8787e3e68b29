"""Keyword tagging: matches, scores, bonuses and the best topics per text.

Words of the dictionary are found by seeds, not by trying every word on every
text: every place of a text shows its seed candidates, and a look at that place
decides: is the word there, does it stand alone, has it an ending, does it count
as a mention. So no word is ever searched for in a text. All steps from matching
to relevance read one table of found words.

A dictionary within the session's broadcast limit, by its bytes, goes to the
texts, and all places of a batch of texts are looked at as arrays (`wordplaces`).
There the words found are gathered by id as lists of numbers (`gather_words`), and
what they say of topics is counted in arrays too; a text moves once, packed.
Beyond it, places are rows: a word's seed is that of its 5-character pieces (all
of it, if shorter) that the texts hold least often; texts are cut into small
pieces with a margin as long as the longest word, places and seeds are shuffled
and meet in an equi-join, and the few places that meet a word fetch their piece
by (text, piece).

Word boundaries are ASCII: a word character is a letter a-z, a digit or '_'.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.features import contains_any, is_computational
from paperloom.functions.names import first_case
from paperloom.operators import wordplaces
from paperloom.operators.taxonomy import title_phrases
from paperloom.plans.packed import gathered
from paperloom.plans.scale import cut_lineage, stored_table, top_per_group

SEED = 5
PIECES = (1 << 20, 1 << 12, 1 << 6)  # characters of what texts are cut into, step by step
PARTIAL_LENGTH = 5

# Clear synonyms; every inner list needs one hit.
RELATED = {
    "demand": [["consumer", "buyer", "purchase"]],
    "supply": [["producer", "seller", "provision"]],
    "price": [["cost"], ["pricing"]],
    "market": [["industry"], ["competition"]],
    "government": [["state", "public sector"]],
    "profit": [["earnings"], ["revenue"]],
    "unemployment": [["jobless", "employment rate"]],
    "inflation": [["price level", "cost of living"]],
}
# Topics that calculations are about.
CALCULATION_TOPICS = ["elasticities", "Revenue", "Costs", "profits", "Economic growth", "Inflation",
                      "unemployment", "Supply", "Demand", "taxes", "multiplier"]
# Scores.
EXACT_SCORE, PARTIAL_SCORE, RELATED_SCORE = 3.0, 1.5, 0.5
CONCEPT_BONUS, MENTION_BONUS = 2.0, 5.0
KEYWORD_THRESHOLD = 2.0
WORTH = {"exact": EXACT_SCORE, "partial": PARTIAL_SCORE, "related": RELATED_SCORE, "long": 6, "concept": CONCEPT_BONUS,
         "mention": MENTION_BONUS, "least": KEYWORD_THRESHOLD}
HITS = "array<array<int>>"
TALLY = "array<struct<topic:string,{}:double>>"


ENDINGS = ["s ", "ing", "ed", "'s"]
FLAGS = ["present", "exact", "bare", "partial", "mention", "related"]  # in the order of the bits in `wordplaces`


def _pieces(texts: DataFrame, margin: int) -> DataFrame:
    """(id, at, size, own, lead, piece): each text as pieces of `size` places from `at` on.

    `own` is the piece with the rest of a seed that begins in it, `piece` has a margin of `lead` characters before it and
    `margin` behind it. Reaching a place takes as long as what stands before it, so a text is cut in steps.
    """
    rows = texts.filter(F.length("text") > 0).select(
        "id", F.lit(0).alias("at"), F.length("text").alias("size"), F.lit(0).alias("lead"), F.col("text").alias("piece"))
    for size in PIECES:
        parts = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(size))).alias("in"))
        start = F.col("lead") + F.col("in")
        lead = F.least(F.lit(margin), start)
        rows = parts.select("id", (F.col("at") + F.col("in")).alias("at"), F.least(F.lit(size), F.col("size") - F.col("in")).alias("size"),
                            lead.alias("lead"), F.substr("piece", start - lead + 1, F.lit(size + margin) + lead).alias("piece"))
    return rows.withColumn("own", F.substr("piece", F.col("lead") + 1, F.lit(PIECES[-1] + SEED - 1)))


def _places(pieces: DataFrame, lengths: list[int], *carried: str) -> DataFrame:
    """(carried, i, gram): what stands at each place of a piece, in each of the lengths."""
    rows = pieces.select("own", *carried, F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    if len(lengths) == 1:
        return rows.select(*carried, "i", F.substr("own", F.col("i") + 1, F.lit(lengths[0])).alias("gram"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("len"))
    return rows.select(*carried, "i", F.substr("own", F.col("i") + 1, F.col("len")).alias("gram"))


def _seeds(pieces: DataFrame, words: DataFrame) -> tuple[DataFrame, list[int]]:
    """(gram, word, offset): each word's rarest piece; words with a piece that no text has are left out."""
    size = F.least(F.length("word"), F.lit(SEED))
    grams = words.select("word", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.length("word") - size), lambda o: F.substr(F.col("word"), o + 1, size))).alias("offset", "gram"))
    grams = stored_table(grams)
    lengths = sorted(r[0] for r in grams.select(F.length("gram")).distinct().collect())  # at most SEED numbers
    if not lengths:
        return grams.select("gram", "word", "offset"), [SEED]
    counts = _places(pieces, lengths).select("gram").join(grams.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    known = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.groupBy("word").agg(F.min(F.struct("n", "offset", "gram")).alias("s")).filter("s.n > 0")
    return stored_table(rarest.select("s.gram", "word", "s.offset")), lengths


def fits_broadcast(words: DataFrame) -> bool:
    """Whether the words, counted by their strings, are within the session's broadcast limit."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", words.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()).groups()
    limit = int(number) * 1024 ** " kmgtp".index(unit or " ")
    return (words.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0) <= limit


def _occurrences(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, word, before, after): every place of a word, with the character before it and the three after it."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    pieces = _pieces(texts, longest + 4)
    seeds, lengths = _seeds(pieces, words)
    met = _places(pieces, lengths, "id", "at").join(seeds, "gram").join(pieces.select("id", "at", "lead", "piece"), ["id", "at"])
    start, size = F.col("lead") + F.col("i") - F.col("offset"), F.length("word")
    # One look for the word and its neighbours; the first place of a text has nothing before it.
    near = F.when(start > 0, F.substr("piece", start, size + 4)).otherwise(F.substr("piece", F.lit(1), size + 3))
    there = met.filter(start >= 0).select("id", "word", F.when(start > 0, 1).otherwise(0).alias("skip"), near.alias("near"))
    there = there.filter(F.substr("near", F.col("skip") + 1, size) == F.col("word"))
    return there.select("id", "word", F.substr("near", F.lit(1), F.col("skip")).alias("before"),
                        F.substr("near", F.col("skip") + 1 + size, F.lit(3)).alias("after"))


def _delimited(in_brackets: bool) -> Column:
    """Listed delimiters around an occurrence, or a blank on one side and the text's edge on the other."""
    before, after = F.col("before"), F.col("after")
    around = ((before == " ") & ((after == "") | F.substr(after, F.lit(1), F.lit(1)).isin(" ", ",", "."))) | ((before == "") & after.startswith(" "))
    return around | ((before == "(") & after.startswith(")")) if in_brackets else around


def _related_words(text: Column) -> Column:
    """Dictionary words whose synonyms the text has."""
    hits = [F.when(_all(text, groups), F.lit(word)) for word, groups in RELATED.items()]
    return F.filter(F.array(*hits), lambda w: w.isNotNull())


def _all(text: Column, groups: list[list[str]]) -> Column:
    condition = contains_any(text, groups[0])
    for group in groups[1:]:
        condition = condition & contains_any(text, group)
    return condition


def find_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, computational, word, present, exact, bare, partial, mention, related), stored.

    `texts` has unique ids, text and maybe computational; `words` has word, in
    lower case. A row says that the word is in the text (present) or is related
    to it by a synonym, and which tests it passes: `exact` words stand between
    non-word characters, or, if their own edges are others, between the listed
    delimiters; `bare` is exact without brackets as delimiters; `partial` ones have
    a plural, tense or genitive ending; a `mention` is longer than 5 characters or
    delimited. Empty words are in no text.
    """
    text = F.col("text")
    flag = F.col("computational") if "computational" in texts.columns else is_computational(text)
    # Dealt by id once: looking and what follows stay in that partitioning. Its number of
    # partitions is given, as the work on a text is large beside its bytes, by which partitions would be merged.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lowered = texts.filter(text.isNotNull()).select("id", flag.alias("computational"), F.lower(text).alias("text")).repartition(tasks, "id")
    listed = stored_table(words.filter(F.length("word") > 0).select("word").distinct())
    found = _looked_up(lowered, listed) if fits_broadcast(listed) else _joined(lowered, listed)
    return cut_lineage(found.select("id", "computational", "word", *FLAGS))


def _related_mask(text: Column) -> Column:
    """The related words of a text, a bit for each."""
    mask = F.lit(0)
    for bit, groups in enumerate(RELATED.values()):
        mask = mask + F.when(_all(text, groups), 1 << bit).otherwise(0)
    return mask


def _looked_up(lowered: DataFrame, listed: DataFrame) -> DataFrame:
    """The found words by one look at every place of a batch of texts, where the texts lie."""
    spoken = [r["word"] for r in listed.collect()]
    number = {w: i for i, w in enumerate([*spoken, *sorted(set(RELATED) - set(spoken))])}
    look = F.arrow_udf(wordplaces.finder(spoken, [number[w] for w in RELATED]), "array<int>")
    seen = lowered.filter("id is not null").select("id", "computational", look("text", _related_mask(F.col("text"))).alias("hits"))
    hits = seen.select("id", "computational", F.explode("hits").alias("hit"))
    names = lowered.sparkSession.createDataFrame([(i, w) for w, i in number.items()], "at int, word string")
    rows = hits.withColumn("at", F.shiftright("hit", wordplaces.BITS)).join(F.broadcast(names), "at")
    return rows.withColumns({n: F.col("hit").bitwiseAND(1 << bit) != 0 for bit, n in enumerate(FLAGS)})


def _joined(lowered: DataFrame, listed: DataFrame) -> DataFrame:
    """The found words by joins of places and seeds, for a dictionary of any size."""
    word = F.col("word")
    open_left, open_right = ~F.col("before").rlike("[a-z0-9_]"), ~F.col("after").rlike("^[a-z0-9_]")
    plain = word.rlike("(?s)^[a-z0-9_](.*[a-z0-9_])?$")
    followed = F.col("after").startswith(ENDINGS[0])
    for ending in ENDINGS[1:]:
        followed = followed | F.col("after").startswith(ending)
    tests = {"exact": F.when(plain, open_left & open_right).otherwise(_delimited(True)),
             "bare": F.when(plain, open_left & open_right).otherwise(_delimited(False)),
             "partial": (F.length(word) >= PARTIAL_LENGTH) & followed, "mention": (F.length(word) > 5) | _delimited(True)}
    seen = _occurrences(lowered.select("id", "text"), listed).select("id", "word", *[t.alias(n) for n, t in tests.items()])
    folded = seen.groupBy("id", "word").agg(F.lit(True).alias("present"), *[F.bool_or(n).alias(n) for n in tests])
    no = [F.lit(False).alias(n) for n in ("present", *tests)]
    synonyms = lowered.select("id", F.explode(_related_words(F.col("text"))).alias("word")).select("id", "word", *no, F.lit(True).alias("related"))
    both = folded.withColumn("related", F.lit(False)).unionByName(synonyms)
    return both.groupBy("id", "word").agg(*[F.bool_or(n).alias(n) for n in FLAGS]).join(lowered.select("id", "computational"), "id")


class Found(NamedTuple):
    """Found words gathered by id: (id, computational, hits, ...), an entry of both lists for each copy of the id's text.

    A hit is the number of its word in `words` and flags in the lowest bits, in the order of `FLAGS`.
    """

    rows: DataFrame
    words: list[str]


def spoken_words(words: DataFrame, *listings: DataFrame) -> list[str] | None:
    """The distinct words to look for, or None if they or a listing by topic are beyond the broadcast limit."""
    listed = cut_lineage(words.filter(F.length("word") > 0).select("word").distinct())
    if not all(fits_broadcast(d.select(F.concat_ws(" ", *d.columns).alias("word"))) for d in (listed, *listings)):
        return None
    return [r["word"] for r in listed.collect()]


def hits_of_copies(texts: Column, spoken: list[str]) -> tuple[Column, list[str]]:
    """The hits of every copy in a list of texts, and the words by their numbers: those spoken and those related to a text."""
    words = [*spoken, *sorted(set(RELATED) - set(spoken))]
    look = F.arrow_udf(wordplaces.finder_of_copies(spoken, [words.index(w) for w in RELATED]), HITS)
    low = F.transform(texts, lambda t: F.coalesce(F.lower(t), F.lit("")))
    return look(low, F.transform(low, _related_mask)), words


def gather_words(texts: DataFrame, words: DataFrame, *listings: DataFrame) -> Found | None:
    """The words found in the texts, all copies of an id together; None if the dictionary is beyond the broadcast limit.

    `texts` has id, text and maybe computational; `words` has word, in lower case. Each text moves once, and no word is a row.
    """
    spoken = spoken_words(words, *listings)
    if spoken is None:
        return None
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flag = [F.col("computational")] if "computational" in texts.columns else []
    rows = gathered(texts.filter("id is not null").select("id", "text", *flag), "id", tasks)
    hits, numbered = hits_of_copies(F.col("rows.text"), spoken)
    flags = F.col("rows.computational") if flag else F.transform(F.col("rows.text"), is_computational)
    return Found(rows.select("id", flags.alias("computational"), hits.alias("hits")), numbered)


def _listing(found_words: list[str], listed: DataFrame) -> tuple[dict, list[str]]:
    """A table (topic, word) for the array functions, every row counting, and the names of its topics in order."""
    rows = [(r["word"], r["topic"], 0, 1) for r in listed.select("word", "topic").dropna().collect()]
    topics = sorted({t for _, t, _, _ in rows})
    return wordplaces.listing(found_words, rows, topics), topics


def _listed_keywords(keywords: DataFrame) -> DataFrame:
    return keywords.select("topic", F.trim(F.lower("keyword")).alias("keyword"))


def keyword_words(keywords: DataFrame) -> DataFrame:
    """Keywords as they are matched: trimmed, lower case, 3 characters or more."""
    return keywords.select(F.trim(F.lower("keyword")).alias("word")).filter(F.length("word") >= 3).distinct()


def matched(hits: Column, words: list[str], keywords: DataFrame) -> Column:
    """The hits of keywords that match, the kind of match as their only flag."""
    wanted = {r["word"] for r in keyword_words(keywords).collect()}
    return F.arrow_udf(wordplaces.kinds([w in wanted for w in words]), HITS)(hits)


def match_keywords(texts: DataFrame, keywords: DataFrame, found: DataFrame | Found | None = None) -> DataFrame | Found:
    """(id, keyword, match): EXACT, PARTIAL or RELATED, the first that holds, of each distinct keyword.

    `texts` has id and text; `keywords` has topic and keyword. Keywords under 3
    characters are skipped. `found` is `find_words` over these keywords, if it is at hand;
    of words gathered by id, matches stay gathered, the kind being their only flag.
    """
    words = keyword_words(keywords)
    if isinstance(found, Found):
        return found._replace(rows=found.rows.withColumn("matches", matched(F.col("hits"), found.words, keywords)))
    found = find_words(texts, words) if found is None else found
    kind = F.when(F.col("exact"), "EXACT").when(F.col("partial"), "PARTIAL").when(F.col("related"), "RELATED")
    return (found.withColumn("match", kind).filter(F.col("match").isNotNull()).join(words, "word", "left_semi")
            .select("id", F.col("word").alias("keyword"), "match"))


def score_keywords(matches: DataFrame | Found, keywords: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, topic, computational, score): keyword score of each topic with a match.

    `flags` has id and computational; matches gathered by id bring them along, one
    for each copy. A topic may list one keyword several times; each listing counts.
    """
    if isinstance(matches, Found):
        score = F.arrow_udf(wordplaces.scorer(*_listing(matches.words, _listed_keywords(keywords).withColumnRenamed("keyword", "word")), WORTH),
                            TALLY.format("score"))
        rows = matches.rows.select("id", "computational", F.explode(score("matches")).alias("of"))
        return rows.select("id", "of.topic", F.explode("computational").alias("computational"), F.col("of.score").alias("base")).select(
            "id", "topic", "computational", _for_calculations(F.col("base")).alias("score"))
    listed = _listed_keywords(keywords)
    pairs = matches.join(listed, "keyword")
    exact, partial = F.col("match") == "EXACT", F.col("match") == "PARTIAL"
    sums = pairs.groupBy("id", "topic").agg(
        F.count_if(exact).alias("exact"), F.count_if(partial).alias("partial"),
        F.count_if(F.col("match") == "RELATED").alias("related"),
        F.count_if(exact & (F.length("keyword") > 6)).alias("long_exact"))
    base = (F.col("exact") * EXACT_SCORE + F.col("partial") * PARTIAL_SCORE + F.col("related") * RELATED_SCORE
            + F.when(F.col("exact") > 1, 2.0).otherwise(0.0)
            + F.when(F.col("long_exact") > 0, 1.0).otherwise(0.0))
    weak = (F.col("exact") == 0) & (F.col("partial") < 2)
    weighed = F.when(weak, base * 0.3).otherwise(base)
    return sums.withColumn("base", weighed).join(flags, "id").select(
        "id", "topic", "computational", _for_calculations(F.col("base")).alias("score"))


def _for_calculations(base: Column) -> Column:
    """The score of a topic, more or less of its base where the text is a calculation."""
    return (F.when(~F.col("computational"), base)
            .when(is_calculation_topic(F.col("topic")), base + 1.0).otherwise(base * 0.5))


def is_calculation_topic(topic: Column) -> Column:
    return contains_any(topic, CALCULATION_TOPICS)


def concept_words(concepts: DataFrame) -> DataFrame:
    return concepts.select(F.lower("concept").alias("word"), "topic").distinct()


def concept_bonus(texts: DataFrame, concepts: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(id, topic, bonus): 2 for each concept of the topic found in the text."""
    listed = concept_words(concepts)
    found = find_words(texts, listed) if found is None else found
    return found.filter("bare").join(listed, "word").groupBy("id", "topic").agg((F.count("*") * CONCEPT_BONUS).alias("bonus"))


def direct_mention_bonus(texts: DataFrame, topics: DataFrame, found: DataFrame | Found | None = None) -> DataFrame:
    """(id, topic, bonus): 5 when the title or one of its parts stands anywhere in the text."""
    phrases = title_phrases(topics).withColumnRenamed("phrase", "word")
    found = gather_words(texts, phrases, phrases) if found is None else found
    if isinstance(found, Found):
        mention = F.arrow_udf(wordplaces.mentioner(*_listing(found.words, phrases), MENTION_BONUS), TALLY.format("bonus"))
        return found.rows.select("id", F.inline(mention("hits")))
    found = find_words(texts, phrases) if found is None else found
    return found.filter("present").join(phrases, "word").select("id", "topic").distinct().withColumn("bonus", F.lit(MENTION_BONUS))


def tagging_words(topics: DataFrame, keywords: DataFrame, concepts: DataFrame) -> DataFrame:
    """All words that keyword tagging looks for."""
    return (keyword_words(keywords).unionByName(concept_words(concepts).select("word"))
            .unionByName(title_phrases(topics).select(F.col("phrase").alias("word"))).distinct())


def best_topics(matches: Column, hits: Column, computational: Column, words: list[str], keywords: DataFrame, concepts: DataFrame) -> Column:
    """The topics of `top_topics_by_keywords` for words gathered by id, as a list of (topic, score), the best first."""
    titles = keywords.select("topic").distinct()
    listed = _listed_keywords(keywords).withColumnRenamed("keyword", "word"), concept_words(concepts), title_phrases(titles).withColumnRenamed("phrase", "word")
    topics = sorted(r["topic"] for r in titles.dropna().collect())
    known = set(topics)
    tables = [wordplaces.listing(words, [(r["word"], r["topic"], 0, 1) for r in d.select("word", "topic").dropna().collect() if r["topic"] in known], topics)
              for d in listed]
    about = [any(part in t for part in CALCULATION_TOPICS) for t in topics]
    choose = F.arrow_udf(wordplaces.chooser(*tables, topics, about, WORTH), TALLY.format("score"))
    return choose(matches, hits, computational)


def top_topics_by_keywords(texts: DataFrame, keywords: DataFrame, concepts: DataFrame,
                           found: DataFrame | Found | None = None) -> DataFrame:
    """(id, rank, topic, score): up to 3 topics scoring 2 or more (2 scoring 3 for calculations).

    Topics are those of the keyword table; ties go to the lower topic string.
    `found` is `find_words` or `gather_words` over `tagging_words`, if it is at hand.
    """
    topics = keywords.select("topic").distinct()
    found = gather_words(texts, tagging_words(topics, keywords, concepts), keywords, concepts) if found is None else found
    if isinstance(found, Found):
        matched = match_keywords(texts, keywords, found).rows
        best = best_topics(F.col("matches"), F.col("hits"), F.col("computational"), found.words, keywords, concepts)
        return matched.select("id", F.posexplode(best).alias("at", "best")).select("id", (F.col("at") + 1).alias("rank"), "best.topic", "best.score")
    found = find_words(texts, tagging_words(topics, keywords, concepts)) if found is None else found
    flags = found.groupBy("id").agg(F.bool_or("computational").alias("computational"))
    scored = score_keywords(match_keywords(texts, keywords, found), keywords, flags).select("id", "topic", "score")
    # A calculation topic gets its point without any keyword hit, so it can pass with a bonus alone.
    extras = (concept_bonus(texts, concepts, found).join(topics, "topic", "left_semi")
              .unionByName(direct_mention_bonus(texts, topics, found))
              .select("id", "topic", F.col("bonus").alias("score")))
    summed = (scored.withColumn("hit", F.lit(True)).unionByName(extras.withColumn("hit", F.lit(False)))
              .groupBy("id", "topic").agg(F.sum("score").alias("score"), F.bool_or("hit").alias("hit"))
              .join(flags, "id"))
    lone = F.col("computational") & ~F.col("hit") & is_calculation_topic(F.col("topic"))
    score = F.col("score") + F.when(lone, 1.0).otherwise(0.0)
    passed = summed.select("id", "topic", score.alias("score"), "computational").filter(
        F.col("score") >= F.when(F.col("computational"), KEYWORD_THRESHOLD + 1).otherwise(KEYWORD_THRESHOLD))
    ranked = top_per_group(passed, ["id"], [-F.col("score"), F.col("topic")], 3)
    return ranked.filter(~F.col("computational") | (F.col("rank") <= 2)).select("id", "rank", "topic", "score")


# Fallback rules in order; a text must have every word of a rule.
FALLBACK_CALCULATION = [
    (["elasticity"], "1.2.3 Price, income and cross elasticities of demand"),
    (["revenue"], "3.3.1 Revenue"),
    (["profit"], "3.3.1 Revenue"),
    (["cost"], "3.3.2 Costs"),
    (["gdp"], "2.1.1 Economic growth"),
    (["unemployment"], "2.1.3 Employment and unemployment"),
]
FALLBACK_DRAWING = [
    (["supply", "demand"], "1.2.6 Price determination"),
    (["market"], "1.2.6 Price determination"),
]
FALLBACK_TERMS = [
    (["price", "determine"], "1.2.6 Price determination"),
    (["elasticity"], "1.2.3 Price, income and cross elasticities of demand"),
    (["government", "intervention"], "1.4.1 Government intervention in markets"),
    (["market failure"], "1.3.1 Types of market failure"),
    (["externality"], "1.3.2 Externalities"),
    (["monopoly"], "3.4.5 Monopoly"),
    (["competition"], "3.4.2 Perfect competition"),
    (["unemployment"], "2.1.3 Employment and unemployment"),
    (["inflation"], "2.1.2 Inflation"),
    (["growth"], "2.1.1 Economic growth"),
]
FALLBACK_SUPPLY = "1.2.4 Supply"
FALLBACK_DEFAULT = "1.2.2 Demand"


def fallback_topic(text: Column) -> Column:
    """Topic by ordered word rules; demand when nothing fits or the text is NULL."""
    low = F.lower(text)

    def rules(table, condition):
        return [(condition & _all(low, [[w] for w in words]), F.lit(topic)) for words, topic in table]

    calculation = low.contains("calculate") | low.contains("work out")
    drawing = low.contains("draw") | low.contains("diagram")
    supply = [(low.contains("supply") & ~low.contains("demand"), F.lit(FALLBACK_SUPPLY))]
    return first_case(
        rules(FALLBACK_CALCULATION, calculation) + rules(FALLBACK_DRAWING, drawing) + supply
        + rules(FALLBACK_TERMS, F.lit(True)), F.lit(FALLBACK_DEFAULT))
