"""Question bundles, mark-scheme indexes and mock tests.

Random choices order rows by md5(id | ... | seed), so results do not depend on
partitioning. Selections first keep the only rows that a group's budget could
ever take, with the proof beside each limit; what is folded afterwards is small
whatever the group's size. Marks are at least 1, as the marks rule yields; rows
with fewer, which no budget could bound, go to the table of `unpriced`. Unknown marks (NULL) count as larger
than any limit, as questions of unknown length.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.features import (estimated_minutes, is_context_based, is_essay, is_paper3_q1or2,
                                          known_or_max)
from paperloom.functions.text import exam_month, original_question_number, seeded_order, trim_topic
from paperloom.operators.dedupe import dedupe_by_content, dedupe_questions, with_question_key
from paperloom.operators.stats import by_topic
from paperloom.plans.scale import (SALTS, first_per_key, null_safe_join, running_total, running_total_in_place, stored_table,
                                   top_per_group)

# Sections of each theme, papers each theme may use, limits.
THEME_SECTIONS = {1: ["1.1", "1.2", "1.3", "1.4"],
                  2: ["2.1", "2.2", "2.3", "2.4", "2.5", "2.6"],
                  3: ["3.1", "3.2", "3.3", "3.4", "3.5", "3.6"],
                  4: ["4.1", "4.2", "4.3", "4.4", "4.5"]}
THEME_PAPERS = {1: ["1"], 2: ["2"], 3: ["1", "3"], 4: ["2", "3"]}
ESSAY_MARKS = 10
UNIT_MINUTES = 75
SINGLE_TARGETS = (60, 90)
INDEX_ROWS = 25
# Rows drawn beyond those that a random order needs: so many standard deviations, and some more.
SPREAD, SPARE = 8.0, 16


def _in_question_order(df: DataFrame, scope: list[str], md5: str, value: Column, out: str) -> DataFrame:
    """Running total in (year, question number, md5, value) order; blocks split on the md5's first digits."""
    block = [F.coalesce("year", F.lit("")), F.coalesce("question_number", F.lit("")), F.substring(md5, 1, 2)]
    return running_total(df, scope, block, [F.col("year"), F.col("question_number"), F.col(md5), value], value, out)


def _dealt(questions: DataFrame, scope: list[str], md5: str, columns: list[str]) -> DataFrame:
    """`columns` of the questions that have the file `md5`, each moved once to the task of its md5's first digits, `_block`.

    A question still goes as one row, whatever the number of its topics. Copies of a file meet in the task of its block, where
    they are sorted and not held, and so do the neighbours in the order of a running total.
    """
    given = [c for c in scope if c in questions.columns]
    topics = ["topics"] if len(given) < len(scope) else []
    return questions.select(*given, *topics, md5, *columns).filter(F.col(md5).isNotNull()).withColumn(
        "_block", F.substring(md5, 1, 2)).repartition("_block")


def _by_scope(dealt: DataFrame, scope: list[str]) -> DataFrame:
    return dealt if set(scope) <= set(dealt.columns) else by_topic(dealt)


def _in_place(df: DataFrame, scope: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """`_in_question_order` for rows that lie where `_dealt` put them."""
    block = [F.coalesce("year", F.lit("")), F.coalesce("question_number", F.lit(""))]
    return running_total_in_place(df, scope, block, "_block", order, value, out)


def bundle_manifest(questions: DataFrame, scope: list[str]) -> DataFrame:
    """Numbered entries per scope: separator, question, separator, mark scheme.

    Each question file once per scope, in year and number order; the mark-scheme
    pair is there only when the question has one. With `topic` in the scope,
    `questions` has a row per topic or, which moves less, the array `topics`.
    """
    paired = questions.withColumn("has_markscheme", F.col("markscheme_md5").isNotNull())
    rows = _dealt(paired, scope, "content_md5", ["year", "question_number", "question_id", "has_markscheme"])
    unique = dedupe_by_content(_by_scope(rows, scope), "content_md5",
                               [F.col("year"), F.col("question_number"), F.col("question_id")], [*scope, "_block"])
    size = F.when(F.col("has_markscheme"), 4).otherwise(2)
    order = [F.col("year"), F.col("question_number"), F.col("content_md5")]
    placed = _in_place(unique, scope, order, size, "before")
    kinds = ["question_separator", "question", "markscheme_separator", "markscheme"]
    entries = F.slice(F.array(*[F.lit(k) for k in kinds]), F.lit(1), size)
    return placed.select(*scope, "question_id", "before", F.posexplode(entries).alias("i", "kind")).select(
        *scope, (F.col("before") + F.col("i") + 1).alias("seq"), "kind", "question_id")


def _with_pages(dealt: DataFrame, page_counts: DataFrame) -> DataFrame:
    """The dealt rows with `pages`, the array of their scheme's valid pages (NULL without any); the rows stay where they are.

    The counts are dealt out like them, and a scheme's counts are read before its rows.
    """
    counts = page_counts.filter("markscheme_md5 is not null").select(
        "markscheme_md5", F.coalesce("valid_pages", F.lit(0)).cast("long").alias("n"),
        F.substring("markscheme_md5", 1, 2).alias("_block")).repartition("_block").groupBy("_block", "markscheme_md5").agg(
        F.collect_list("n").alias("pages")).withColumn("_own", F.lit(False))
    first = Window.partitionBy("_block", "markscheme_md5").orderBy("_own").rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.withColumn("_own", F.lit(True)).unionByName(counts, allowMissingColumns=True)
    return both.withColumn("pages", F.first("pages").over(first)).filter("_own").drop("_own")


def markscheme_index(questions: DataFrame, page_counts: DataFrame, scope: list[str],
                     max_rows: int | None = None) -> DataFrame:
    """Start page of each distinct mark scheme: 2 plus valid pages and header of those before it.

    `page_counts` has markscheme_md5 and valid_pages. `max_rows` (25 in the
    one-page index) keeps the first rows. With `topic` in the scope, `questions`
    has a row per topic or, which moves less, the array `topics`.
    """
    columns = ["year", "question_number", "question_id", "board", "marks"]
    order = [F.col("year"), F.col("question_number"), F.col("markscheme_md5")]
    by_first = [F.col("year"), F.col("question_number"), F.col("question_id")]
    pages = F.coalesce("valid_pages", F.lit(0)) + 1
    if max_rows:
        unique = dedupe_by_content(_by_scope(questions, scope).select(*scope, "markscheme_md5", *columns), "markscheme_md5", by_first, scope)
        # Every scheme keeps a row or more in the join, so the first rows after it are of these schemes.
        unique = stored_table(top_per_group(unique, scope, order, max_rows).drop("rank"))
        sized = unique.join(page_counts, "markscheme_md5", "left")
        sized = top_per_group(sized, scope, [*order, pages], max_rows).drop("rank")
        placed = _in_question_order(sized, scope, "markscheme_md5", pages, "before")
    else:
        rows = _by_scope(_with_pages(_dealt(questions, scope, "markscheme_md5", columns), page_counts), scope)
        unique = dedupe_by_content(rows, "markscheme_md5", by_first, [*scope, "_block"])
        sized = unique.withColumn("valid_pages", F.explode(F.coalesce("pages", F.array(F.lit(0).cast("long"))))).drop("pages")
        placed = _in_place(sized, scope, [*order, pages], pages, "before")
    return placed.select(*scope, "question_id", "question_number", "year", "board", "marks",
                         (F.col("before") + 2).cast("long").alias("start_page"))


def unpriced(questions: DataFrame, cost: str = "marks") -> DataFrame:
    """The rows that selections by marks (or minutes) leave out because they cost less than 1."""
    return questions.filter(F.col(cost) < 1)


def _pools(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Essay-like questions (essays or 10 marks and more) and short ones."""
    essay = is_essay(F.col("question_number")) | (known_or_max(F.col("marks")) >= ESSAY_MARKS)
    usable = questions.filter(known_or_max(F.col("marks")) >= 1)
    return usable.filter(essay), usable.filter(~essay)


def select_balanced(questions: DataFrame, group: list[str], target: int, seed: int, tol: int = 10,
                    second_essay: bool = False) -> DataFrame:
    """(group, question_id, marks, kind, seq): one random essay, then random shorts up to the target.

    Shorts are taken while the marks so far are under target - tol. Each has a
    mark or more, so only the first target - tol shorts of a group can be taken.
    With `second_essay`, one more essay follows when the total is under target - 15.
    """
    rows = questions.select(*group, "question_id", "question_number", "marks",
                            seeded_order(seed, F.col("question_id")).alias("ord"))
    essays, shorts = _pools(rows)
    order = [F.col("ord"), F.col("question_id")]
    chosen = top_per_group(essays, group, order, 2 if second_essay else 1)
    first = chosen.filter("rank = 1").withColumn("m", known_or_max(F.col("marks")).cast("long"))
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = top_per_group(shorts, group, order, target - tol).withColumn(
        "before", F.coalesce(F.sum("marks").over(before), F.lit(0)))
    taken = null_safe_join(near, first.select(*group, "m"), group, "left").filter(
        F.coalesce("m", F.lit(0)) + F.col("before") < target - tol)
    cols = [*group, "question_id", "marks"]
    picked = first.select(*cols, F.lit("essay").alias("kind"), F.lit(0).alias("seq")).unionByName(
        taken.select(*cols, F.lit("short").alias("kind"), F.col("rank").alias("seq")))
    if not second_essay:
        return picked
    totals = picked.groupBy(*group).agg(F.sum(known_or_max(F.col("marks")).cast("long")).alias("total"))
    extra = null_safe_join(chosen.filter("rank = 2"), totals.filter(F.col("total") < target - 15), group)
    return picked.unionByName(extra.select(*cols, F.lit("second essay").alias("kind"), F.lit(target).alias("seq")))


def select_ascending_to_target(questions: DataFrame, group: list[str], target: int, seed: int,
                               tol: int = 10) -> DataFrame:
    """(group, question_id, marks, seq): lowest marks first while the total fits target + tol.

    Stops at target - tol. Marks ascend, so the first question that does not fit
    ends the selection, and at most target + tol questions can fit.
    """
    rows = questions.filter(F.col("marks") >= 1).select(
        *group, "question_id", "marks", seeded_order(seed, F.col("question_id")).alias("ord"))
    order = [F.col("marks"), F.col("ord"), F.col("question_id")]
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = top_per_group(rows, group, order, target + tol, "seq").withColumn("total", F.sum("marks").over(upto))
    return near.filter((F.col("total") <= target + tol) & (F.col("total") - F.col("marks") < target - tol)).select(
        *group, "question_id", "marks", "seq")


def _drawn(tries: DataFrame, group: list[str], seed: int, most: int) -> DataFrame:
    """Each restart's rows that its budget can take, ranked by the random order within their class."""
    ordered = tries.withColumn("ord", seeded_order(seed, F.col("question_id"), F.col("restart")))
    if "limit" in tries.columns:
        ordered = ordered.filter(F.col("ord") < F.col("limit"))
    ranked = top_per_group(ordered.select(*group, "_target", "kind", "length", "restart", "question_id", "marks", "minutes", "take", "ord"),
                           ["restart", "kind", "length", *group], [F.col("ord"), F.col("question_id")], most)
    return ranked.filter(F.col("rank") <= F.col("take")).drop("rank")


def _near(rows: DataFrame, group: list[str], seed: int, restarts: int, most: int) -> DataFrame:
    """The first `take` rows of each class (group, kind, length) in every restart's order, stored.

    A class of n rows needs its `take` least random numbers, so only rows whose number is below a share of all numbers a
    little over take / n are ordered. Classes and restarts for which too few were below it are counted and drawn again from
    all their rows: the share saves work, it decides nothing.
    """
    keys = [*group, "kind", "length"]
    classes = stored_table(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first("take").alias("take")))
    share = (F.col("take") + SPREAD * F.sqrt(F.col("take").cast("double")) + SPARE) / F.col("n")
    # A bound on the hexadecimal digits of the random number; "g" is above all of them.
    limit = F.when(share >= 1, "g").otherwise(F.lpad(F.lower(F.hex(F.floor(F.greatest(share, F.lit(0.0)) * (1 << 52)).cast("bigint"))), 13, "0"))
    each = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart")
    limited = null_safe_join(rows, classes.select(*keys, limit.alias("limit")), keys)
    near = stored_table(_drawn(limited.select("*", each), group, seed, most))
    counts = near.groupBy(*keys, "restart").agg(F.count("*").alias("found"))
    due = classes.select(*keys, F.least("n", "take").alias("due"), each)
    short = stored_table(null_safe_join(due, counts, [*keys, "restart"], "left").filter(F.coalesce("found", F.lit(0)) < F.col("due")).select(*keys, "restart"))
    if not short.limit(1).count():
        return near
    again = _drawn(null_safe_join(rows, short, keys), group, seed, most)
    return null_safe_join(near, short, [*keys, "restart"], "left_anti").unionByName(again)


def select_time_budget(questions: DataFrame, group: list[str], target: Column, seed: int,
                       tol: int = 15, restarts: int = 50) -> DataFrame:
    """(group, restart, question_id, marks, minutes, seq): the best of `restarts` random greedy fills.

    `questions` has question_id, marks, minutes and is_short; `target` is a
    column over it, constant within a group. A restart orders shorts, then longs,
    at random, takes what fits target + tol and stops at target - tol. The
    restart nearest the target wins, the earliest on ties. Rows under a minute are
    in `unpriced`; the largest target is read first, as it bounds the limits below.

    Only rows that can be taken are folded. A question of up to 2 * tol minutes
    always fits while the time is under target - tol, so the ones taken are the
    first of their kind, at most target - tol. Time used only grows, so once a
    longer question of t minutes does not fit, no later one of t minutes does:
    the ones taken are the first of their kind and length, at most
    (target + tol) / t. Of each kind and length only the rows that can be among
    those first ones are ordered.
    """
    rows = _priced(questions, target, tol).filter("fits").select(*group, *PRICED)
    return _filled(stored_table(rows), group, seed, tol, restarts)


PRICED = ["_target", "kind", "question_id", "marks", "minutes", "length", "take"]


def _priced(questions: DataFrame, target: Column, tol: int) -> DataFrame:
    """The questions with what a fill reads of them (PRICED); `fits` where an empty mock can take them."""
    cap = F.col("_target") + tol
    length = F.when(F.col("minutes") > 2 * tol, F.col("minutes")).otherwise(0)
    return questions.withColumns({"_target": target, "kind": F.when(F.col("is_short"), 0).otherwise(1), "length": length}).withColumns({
        "fits": F.coalesce((F.col("minutes") >= 1) & (F.col("minutes") <= cap), F.lit(False)),
        "take": F.when(F.col("length") == 0, F.greatest(F.col("_target") - tol, F.lit(0))).otherwise(
            F.floor(cap / F.greatest("length", F.lit(1)))).cast("int")})


def _filled(rows: DataFrame, group: list[str], seed: int, tol: int, restarts: int) -> DataFrame:
    """The best fill of each group; `rows` (PRICED) are stored, as they are read to count classes, to draw and, if need be, to draw again."""
    largest = rows.agg(F.max("_target")).first()[0] or 0
    near = _near(rows, group, seed, restarts, max(largest - tol, (largest + tol) // (2 * tol + 1), 1))
    lists = near.groupBy(*group, "restart").agg(
        F.first("_target").alias("_target"),
        F.array_sort(F.collect_list(F.struct("kind", "ord", "question_id", "minutes", "marks"))).alias("items"))
    empty = F.expr("cast(struct(0 as used, array() as picked) as struct<used:int, "
                   "picked:array<struct<question_id:string, minutes:int, marks:int>>>)")

    def take(done, item):
        used = done["used"] + item["minutes"]
        fits = (done["used"] < F.col("_target") - tol) & (used <= F.col("_target") + tol)
        one = F.struct(item["question_id"].alias("question_id"), item["minutes"].cast("int").alias("minutes"),
                       item["marks"].cast("int").alias("marks"))
        return F.when(fits, F.struct(used.cast("int").alias("used"),
                                     F.array_append(done["picked"], one).alias("picked"))).otherwise(done)

    filled = lists.withColumn("fill", F.aggregate("items", empty, take))
    off = F.abs(F.col("fill.used") - F.col("_target"))
    best = filled.groupBy(*group).agg(F.min_by(
        F.struct("restart", "fill.picked"), F.struct(off.alias("off"), "restart")).alias("best"))
    return best.select(*group, F.col("best.restart").alias("restart"), F.posexplode("best.picked").alias("i", "q")).select(
        *group, "restart", F.col("q.question_id").alias("question_id"), F.col("q.marks").alias("marks"),
        F.col("q.minutes").alias("minutes"), (F.col("i") + 1).alias("seq"))


def with_context(questions: DataFrame, extracts: DataFrame) -> DataFrame:
    """`has_extract` and `reads_context` added; `extracts` has one row per extract of a paper."""
    keys = ["board", "qualification", "year", "paper"]
    # Stored, so that the planner knows how few papers there are before it moves any question.
    papers = stored_table(extracts.select(*keys).distinct()).withColumn("has_extract", F.lit(True))
    joined = null_safe_join(questions, papers, keys, "left").withColumn(
        "has_extract", F.coalesce("has_extract", F.lit(False)))
    return joined.withColumn("reads_context", is_context_based(
        F.col("question_number"), F.col("has_extract"), F.col("marks")))


def _firsts_in_place(questions: DataFrame, scope: list[str], most: int) -> DataFrame:
    """(scope, question_key, _salt, question_id, question_number, marks, reads_context): the first question of each key in a scope.

    Keys that no question of up to `most` marks has are left out before their questions are repeated for the topics.

    Each question moves once, before it is repeated for its topics, to the task of its content's digest, where copies are
    sorted. Other keys, as those of unknown content, which any number may share, are spread by `_salt` over
    SALTS tasks (NULL for digests): their firsts are to be folded once more.
    """
    salt = F.when(~F.col("question_key").rlike("^[0-9A-Fa-f]{32,128}$"), F.pmod(F.xxhash64("question_id"), F.lit(SALTS)))
    rows = questions.select("question_id", "question_number", "marks", "reads_context", "qualification", "question_key",
                            salt.alias("_salt"), "topics").repartition("question_key", "_salt")
    least = F.min("marks").over(Window.partitionBy("question_key", "_salt"))
    rows = rows.withColumn("_least", least).filter(F.col("_salt").isNotNull() | (F.col("_least") <= most)).drop("_least")
    # The id is the first column, and so the order. A sort tells most rows apart by the first bytes of its first key.
    return first_per_key(by_topic(rows), ["question_key", *scope, "_salt"], [])


def single_topic_mock(questions: DataFrame, extracts: DataFrame, seed: int, restarts: int = 50,
                      tol: int = 15) -> DataFrame:
    """One mock per qualification and topic, labelled 60 or 90 minutes at random.

    Distinct questions of up to 10 marks; those that read no context are short.
    Where none can be selected, all are used, in the order of a hash of their
    ids, with no restart.
    """
    scope = ["qualification", "topic"]
    coin = F.substring(seeded_order(seed, F.col("qualification"), F.col("topic")), 1, 1) < "8"
    target = F.when(coin, SINGLE_TARGETS[0]).otherwise(SINGLE_TARGETS[1])
    firsts = _firsts_in_place(with_context(with_question_key(questions), extracts), scope, 10).withColumns({
        "minutes": estimated_minutes(F.col("marks"), F.col("reads_context"), "single"), "is_short": ~F.col("reads_context")})
    short = F.col("marks") <= 10
    timed = stored_table(_priced(firsts, target, tol).filter(F.col("_salt").isNotNull() | short))
    spread = timed.filter("_salt is not null").drop("_salt")
    if not spread.isEmpty():
        once = first_per_key(spread, [*scope, "question_key"], [F.col("question_id"), F.col("question_number")]).filter(short)
        timed = stored_table(timed.filter("_salt is null").drop("_salt").unionByName(once))
    picked = _filled(timed.filter("fits").select(*scope, *PRICED), scope, seed, tol, restarts)
    left = null_safe_join(timed.select(*scope, "question_id", "marks", "minutes"), picked.select(*scope).distinct(), scope, "left_anti").withColumn(
        "_h", F.md5("question_id"))
    numbered = running_total(left, scope, [F.substring("_h", 1, 2)], [F.col("_h"), F.col("question_id")], F.lit(1), "before")
    everything = numbered.select(*scope, F.lit(None).cast("int").alias("restart"), "question_id", F.col("marks").cast("int").alias("marks"),
                                 F.col("minutes").cast("int").alias("minutes"), (F.col("before") + 1).cast("int").alias("seq"))
    return picked.unionByName(everything).withColumn("label_minutes", target)


def topic_mocks(questions: DataFrame, group: list[str], target: int, max_mocks: int, seed: int,
                tol: int = 10) -> DataFrame:
    """(group, mock, kind, question_id, marks, minutes): balanced mocks drawn without replacement.

    A group gets one mock per `target` marks it holds, at least one and at most
    `max_mocks`. One random order serves all mocks: mock i takes the i-th essay,
    then the next unused shorts. At most max_mocks * (target - tol) shorts can be
    taken, each having a mark or more.
    """
    # Only what is read below takes part in finding the copies, which moves every row.
    keyed = (questions if "question_key" in questions.columns else with_question_key(questions)).select(
        *group, "question_key", "question_id", "question_number", "marks")
    unique = dedupe_questions(keyed, group).select(
        *group, "question_id", "question_number", "marks", seeded_order(seed, F.col("question_id")).alias("ord"))
    totals = unique.groupBy(*group).agg(
        F.least(F.greatest(F.floor(F.coalesce(F.sum("marks"), F.lit(0)) / target), F.lit(1)), F.lit(max_mocks))
        .cast("int").alias("n_mocks"))
    essays, shorts = _pools(unique)
    order = [F.col("ord"), F.col("question_id")]
    near = top_per_group(essays, group, order, max_mocks).withColumn("kind", F.lit(0)).unionByName(
        top_per_group(shorts, group, order, max_mocks * (target - tol)).withColumn("kind", F.lit(1)))
    item = F.struct("rank", "question_id", "marks")
    lists = near.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == 0, item))).alias("essays"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == 1, item))).alias("shorts"))
    sized = null_safe_join(lists, totals, group)
    needs = F.transform(F.sequence(F.lit(0), F.col("n_mocks") - 1), lambda i: F.greatest(
        F.lit(target - tol).cast("long") - F.coalesce(
            F.when(i < F.size("essays"), known_or_max(F.get("essays", i)["marks"])), F.lit(0)).cast("long"),
        F.lit(0).cast("long")))
    start = F.expr("cast(struct(0 as mock, 0 as used, array() as picked) as struct<mock:int, used:bigint, "
                   "picked:array<struct<mock:int, question_id:string, marks:int>>>)")

    def deal(done, short):
        """The short goes to the first mock from the current one on that still needs marks."""
        is_open = F.coalesce(done["used"] < F.get("needs", done["mock"]), F.lit(False))
        later = F.get(F.filter(F.sequence(F.lit(0), F.lit(max_mocks)), lambda j: (j > done["mock"]) & (
            F.coalesce(F.get("needs", j), F.lit(0).cast("long")) > 0)), 0)
        mock = F.when(is_open, done["mock"]).otherwise(F.coalesce(later, F.col("n_mocks")))
        used = F.when(is_open, done["used"]).otherwise(F.lit(0).cast("long")) + short["marks"]
        one = F.struct(mock.cast("int").alias("mock"), short["question_id"].alias("question_id"),
                       short["marks"].cast("int").alias("marks"))
        dealt = F.struct(mock.cast("int").alias("mock"), used.alias("used"),
                         F.array_append(done["picked"], one).alias("picked"))
        return F.when(mock < F.col("n_mocks"), dealt).otherwise(
            F.struct(F.col("n_mocks").alias("mock"), F.lit(0).cast("long").alias("used"), done["picked"].alias("picked")))

    dealt = sized.withColumn("needs", needs).withColumn("deal", F.aggregate("shorts", start, deal))
    from_essays = F.transform(F.slice("essays", F.lit(1), F.col("n_mocks")), lambda e: F.struct(
        (e["rank"] - 1).cast("int").alias("mock"), F.lit("essay").alias("kind"), e["question_id"].alias("question_id"),
        e["marks"].cast("int").alias("marks")))
    from_shorts = F.transform("deal.picked", lambda s: F.struct(
        s["mock"].alias("mock"), F.lit("short").alias("kind"), s["question_id"].alias("question_id"),
        s["marks"].alias("marks")))
    return dealt.select(*group, F.explode(F.concat(from_essays, from_shorts)).alias("q")).select(
        *group, (F.col("q.mock") + 1).alias("mock"), "q.kind", "q.question_id", "q.marks",
        estimated_minutes(F.col("q.marks"), F.lit(False), "marks").alias("minutes"))


def unit_mock_topics(topics: DataFrame, n_mocks: int, seed: int) -> DataFrame:
    """(theme, mock, section, topic): one topic at random per section of each theme and mock."""
    section = F.regexp_extract("topic", r"^([1-4]\.\d+)\.\d+\s+.+", 1)
    known = [s for sections in THEME_SECTIONS.values() for s in sections]
    listed = topics.select("topic").distinct().withColumn("section", section).filter(F.col("section").isin(known))
    drawn = listed.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_mocks))).alias("mock")).withColumn(
        "ord", seeded_order(seed, F.col("mock"), F.col("topic")))
    return drawn.groupBy("section", "mock").agg(F.min_by("topic", F.struct("ord", "topic")).alias("topic")).select(
        F.substring("section", 1, 1).cast("int").alias("theme"), "mock", "section", "topic")


def unit_mock(questions: DataFrame, n_mocks: int = 3, per_section: int = 2, seed: int = 1) -> DataFrame:
    """(theme, mock, question_id, topic, marks, ...): mocks of each theme, two questions per section.

    The section's topic is drawn before its questions are filtered to under 10
    marks and the papers of the theme. A question drawn in two sections counts once.
    """
    rows = by_topic(with_question_key(questions).select(
        "question_id", "question_key", "question_number", "year", "paper", "marks", "reads_context", "topics"))
    drawn = unit_mock_topics(rows, n_mocks, seed)
    allowed = F.lit(False)
    for theme, papers in THEME_PAPERS.items():
        allowed = allowed | ((F.col("theme") == theme) & F.coalesce("paper", F.lit("")).isin(papers))
    # A section and a mock have one topic, so `drawn` has at most 21 * n_mocks rows.
    fitting = rows.filter(F.col("marks") < ESSAY_MARKS).join(F.broadcast(drawn), "topic").filter(allowed)
    unique = first_per_key(fitting, ["theme", "mock", "section", "question_key"], [F.col("question_id")]).withColumn(
        "ord", seeded_order(seed, F.col("theme"), F.col("mock"), F.col("question_key")))
    two = top_per_group(unique, ["theme", "mock", "section"], [F.col("ord"), F.col("question_key")], per_section)
    once = first_per_key(two.drop("ord", "rank"), ["theme", "mock", "question_key"], [F.col("section")])
    minutes = estimated_minutes(F.col("marks"), F.col("reads_context"), "unit")
    return once.withColumn("minutes", minutes).withColumn("label_minutes", F.lit(UNIT_MINUTES))


def mock_summary(mocks: DataFrame, scope: list[str]) -> DataFrame:
    """Questions, marks, minutes and essays per mock."""
    return mocks.groupBy(*scope).agg(
        F.count("*").alias("questions"), F.sum("marks").alias("total_marks"), F.sum("minutes").alias("total_minutes"),
        F.count_if(is_essay(F.col("question_number"))).alias("essays"))


def extract_name(number: Column) -> Column:
    """Name of the extract an essay question reads."""
    return F.when(is_paper3_q1or2(number), F.when(number.startswith("question1"), "extract1")
                  .when(number.startswith("question2"), "extract2")).otherwise("extract")


def required_extracts(mocks: DataFrame, extracts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, question_id, extract, extract_file): the extract of the first essay that has one.

    `mocks` has seq and the paper's columns, `extracts` those columns, extract and extract_file.
    """
    keys = ["board", "qualification", "year", "paper", "extract"]
    essays = mocks.filter(is_essay(F.col("question_number"))).withColumn("extract", extract_name(F.col("question_number")))
    found = null_safe_join(essays, extracts.select(*keys, "extract_file"), keys)
    return first_per_key(found.select(*scope, "seq", "question_id", "extract", "extract_file"), scope,
                         [F.col("seq"), F.col("question_id")]).drop("seq")


def header_text(k: Column, paper: Column, month: Column, year: Column, number: Column) -> Column:
    return F.format_string("Question %d ( paper %s %s %s Q%s )", k, paper, F.lower(month), year,
                           original_question_number(number))


def cover_row(paper: Column, month: Column, year: Column, number: Column, topic: Column | None = None) -> Column:
    """Line of the cover page, with the topic in brackets on unit mocks."""
    line = F.format_string("paper %s %s %s Q%s", F.regexp_replace(paper, "[^0-9]", ""), month, year,
                           original_question_number(number))
    return line if topic is None else F.concat(line, F.lit(" ["), trim_topic(topic), F.lit("]"))


def mock_manifest(mocks: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """Questions numbered in `order` within each mock, with page header and cover line.

    Mocks are bounded by their time or section budget, so a mock is one small window.
    """
    month = exam_month(F.col("question_file"))
    seq = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    parts = [F.coalesce("paper", F.lit("")), month, F.col("year"), F.col("question_number")]
    return mocks.withColumn("seq", seq).select(
        *scope, "seq", "question_id", header_text(F.col("seq"), *parts).alias("header"),
        cover_row(*parts, F.col("topic")).alias("cover"), "marks", "minutes")


def first_topic(topics: Column) -> Column:
    return F.coalesce(F.get(topics, 0), F.lit(""))


def order_by_first_topic(questions: DataFrame, tie: str = "question_id") -> DataFrame:
    return questions.orderBy(first_topic(F.col("topics")), F.col(tie))
