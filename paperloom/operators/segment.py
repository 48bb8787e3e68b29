"""Cutting page text into sections, questions and mark-scheme parts.

Input is `pages_text(doc_id, page_no, text)` with pages numbered from 1. Group
picks are aggregates joined back on doc_id, and look-aheads run in page blocks,
so a document holding a large share of all pages is not read by one task. Page
sets are rows, never collected arrays.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.scale import first_per_key, next_position, null_safe_join, stored_table

# Phrases of the page tests.
PAPER3_QUESTIONS = ["paper 3", "paper three"]
PAPER3_MARKSCHEMES = ["paper 3", "paper 03", "paper three"]
GUIDANCE = ["general marking guidance", "marking guidance", "edexcel and btec qualifications",
            "pearson education", "publications code"]
PUBLISHER = "pearson"
MARKSCHEME_WORDS = ["knowledge", "application", "analysis", "evaluation", "level", "mark",
                    "descriptor", "indicative content", "continued"]
MARKSCHEME_SIGNS = ["•", "marks", "(1)", "(2)"]
BLANK_PHRASE = "blank page"

# Text marks.
TOTAL = r"Total for Question (\d+) = \d+ marks"
SUBQUESTION = r"([12])\s*\(([a-e])\)"
TABLE_KEY = r"(\d+)\s*\(([a-z])\)"
OPENER = r"\(([a-z])\)"
OPENING = r"^\s*(\d+)(\s|$)"
#: A line that opens with a number and a blank once control characters and blanks are cut from its ends.
HEAD = r"^[\x00-\x20]*(\d+)\s[\x00-\x20]*[^\x00-\x20]"
#: What ends question 6, which has no single next number.
AFTER_SIX = r"^([7-9]|[1-9][0-9])$"


def trimmed(text: Column) -> Column:
    """Control characters and blanks cut from both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def flag_paper3(pages: DataFrame, files: DataFrame, phrases: list[str] = PAPER3_QUESTIONS) -> DataFrame:
    """(doc_id, is_paper3): a phrase on pages 1-3, or paper 3 in the catalogue (`files`: doc_id, paper)."""
    said = (pages.filter(F.col("page_no") <= 3).groupBy("doc_id")
            .agg(F.bool_or(_any(F.lower("text"), phrases)).alias("said")))
    paper = files.groupBy("doc_id").agg(F.bool_or(F.col("paper") == 3).alias("listed"))
    return said.join(paper, "doc_id", "left").select(
        "doc_id", (F.col("said") | F.coalesce("listed", F.lit(False))).alias("is_paper3"))


def split_sections(pages: DataFrame, marker: str = "SECTION B") -> DataFrame:
    """(doc_id, page_no, section): A from page 2 up to the first marker page, B from there on."""
    starts = (pages.filter(F.col("text").contains(marker)).groupBy("doc_id")
              .agg(F.min("page_no").alias("start")))
    placed = pages.select("doc_id", "page_no").join(starts, "doc_id", "left")
    section = F.when(F.col("page_no") >= F.col("start"), "B").when(F.col("page_no") >= 2, "A")
    return placed.select("doc_id", "page_no", section.alias("section")).filter(F.col("section").isNotNull())


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line)."""
    return pages.select("doc_id", "page_no", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def page_marks(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, idx, kind, value), stored: all marks that questions are cut by, from one scan of the pages.

    Kinds: `opening` and `head` (a number that a line opens with, at its edge or before a blank), `total` (the number of a
    "Total for Question" mark) and, once a page, `letter`: that of its first "(a)", empty if it has none. Nothing later
    reads a text.
    """
    def mark(kind: str, number: Column, idx: Column) -> Column:
        return F.struct(idx.alias("idx"), F.lit(kind).alias("kind"), number.alias("value"))

    def of_line(line: Column, at: Column) -> Column:
        opening, head = F.regexp_extract(line, OPENING, 1), F.regexp_extract(line, HEAD, 1)
        numbers = F.filter(F.array(mark("opening", opening, F.lit(0)), mark("head", head, F.lit(0))), lambda m: m["value"] != "")
        totals = F.transform(F.regexp_extract_all(line, F.lit(TOTAL), F.lit(1)), lambda n, i: mark("total", n, i + 1))
        return F.transform(F.concat(numbers, totals), lambda m: F.struct(at.alias("line_no"), m["idx"].alias("idx"), m["kind"].alias("kind"), m["value"].alias("value")))

    letter = F.struct(F.lit(-1).alias("line_no"), F.lit(0).alias("idx"), F.lit("letter").alias("kind"), F.regexp_extract("text", OPENER, 1).alias("value"))
    marks = F.concat(F.array(letter), F.flatten(F.transform(F.split("text", r"\r?\n"), of_line)))
    return stored_table(pages.filter(F.col("text").isNotNull()).select("doc_id", "page_no", F.explode(marks).alias("m")).select("doc_id", "page_no", "m.*"))


def questions_by_totals(marks: DataFrame) -> DataFrame:
    """(doc_id, number, start_page, end_page) of questions closed by a "Total for Question N" mark.

    A question starts at the first line opening with its number after the mark
    before it: every numbered line is tied to the nearest mark that follows and
    kept when the numbers agree.
    """
    rows = marks.filter(F.col("kind").isin("opening", "total"))
    stream = next_position(
        rows, ["doc_id"], "page_no", ["page_no", "line_no", "idx"], F.col("kind") == "total", "end",
        F.struct("page_no", "line_no", "idx", F.col("value").alias("number")))
    hits = stream.filter((F.col("kind") == "opening") & (F.col("value") == F.col("end.number")))
    return hits.groupBy("doc_id", "end").agg(F.min("page_no").alias("start_page")).select(
        "doc_id", F.col("end.number").try_cast("int").alias("number"), "start_page",
        F.col("end.page_no").alias("end_page"))


def find_questions_by_totals(pages: DataFrame) -> DataFrame:
    """`questions_by_totals` of pages."""
    return questions_by_totals(page_marks(pages))


def question_starts(marks: DataFrame) -> DataFrame:
    """(doc_id, number, start_page): the first page that every number heads a line of."""
    return (marks.filter("kind = 'head'").groupBy("doc_id", F.col("value").alias("number"))
            .agg(F.min("page_no").alias("start_page")))


def context_ranges(starts: DataFrame) -> DataFrame:
    """(doc_id, number, extract, first_page, last_page): the pages before each question, as ranges."""
    name = F.when(F.col("number").isin("1", "2"), F.concat(F.lit("extract"), F.col("number"))).otherwise("extract")
    return starts.filter("start_page > 1").select(
        "doc_id", "number", name.alias("extract"), F.lit(1).alias("first_page"), (F.col("start_page") - 1).alias("last_page"))


def question_stops(marks: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, number, start_page, stop): the page at which the next main question heads a line, else one past the last page.

    Question 2 has no next one; 6 ends at any number from 7 to 99. Each head is looked for by the one number before it, so
    the join is linear in the heads.
    """
    heads = marks.filter("kind = 'head'").select("doc_id", F.col("value").alias("key"), "page_no")
    ends = heads.unionByName(heads.filter(F.col("key").rlike(AFTER_SIX)).withColumn("key", F.lit("after 6")))
    following = F.when(F.col("number") == "6", "after 6").otherwise((F.col("number").try_cast("decimal(38,0)") + 1).cast("string"))
    wanted = starts.filter("number <> '2'").withColumn("key", following)
    met = wanted.join(ends, ["doc_id", "key"]).filter("page_no > start_page").groupBy("doc_id", "number").agg(F.min("page_no").alias("next"))
    last = marks.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    return starts.join(met, ["doc_id", "number"], "left").join(last, "doc_id").select(
        "doc_id", "number", "start_page", F.coalesce("next", F.col("last_page") + 1).alias("stop"))


def question_parts(marks: DataFrame) -> DataFrame:
    """(doc_id, number, letter, start_page, end_page): the lettered parts of every main question at once.

    After a question's start page, a page with "(a)".."(z)" opens a part that runs to the page before the next opener; the
    first page of the next main question ends the search. The first part of each letter is kept, so a question needs, for
    each letter of its document, the nearest opener after its start: starts are dealt to the at most 26 letters and look
    ahead in page blocks. No page ever meets all questions around it.
    """
    limits = question_stops(marks, question_starts(marks))
    openers = marks.filter("kind = 'letter' and value <> ''").select("doc_id", F.col("value").alias("letter"), "page_no")
    asked = limits.join(openers.select("doc_id", "letter").distinct(), "doc_id").select(
        "doc_id", "letter", F.col("start_page").alias("page_no"), "number", "stop", F.lit(1).alias("asks"))
    nobody = openers.select("doc_id", "letter", "page_no", F.lit(None).cast("string").alias("number"), F.lit(None).cast("int").alias("stop"), F.lit(0).alias("asks"))
    ahead = next_position(asked.unionByName(nobody), ["doc_id", "letter"], "page_no", ["page_no", "asks"], F.col("asks") == 0, "opens", F.col("page_no"))
    firsts = ahead.filter("asks = 1 and opens < stop").select("doc_id", "number", "letter", F.col("opens").alias("start_page"), "stop")
    nexts = next_position(openers.select("doc_id", "page_no"), ["doc_id"], "page_no", ["page_no"], F.lit(True), "closes", F.col("page_no"))
    return firsts.join(nexts.withColumnRenamed("page_no", "start_page"), ["doc_id", "start_page"]).select(
        "doc_id", "number", "letter", "start_page", (F.least("closes", "stop") - 1).alias("end_page"))


def find_question_start(pages: DataFrame, number: str) -> DataFrame:
    """(doc_id, start_page): first page with a trimmed line opening with the number and a blank."""
    opens = F.exists(F.split("text", r"\r?\n"), lambda line: trimmed(line).rlike(rf"^{number}\s"))
    return pages.filter(opens).groupBy("doc_id").agg(F.min("page_no").alias("start_page"))


def context_pages(pages: DataFrame, starts: DataFrame, number: str) -> DataFrame:
    """(doc_id, page_no, extract): the pages before the question start."""
    file_name = {"1": "extract1", "2": "extract2"}.get(number, "extract")
    return pages.select("doc_id", "page_no").join(starts, "doc_id").filter(
        F.col("page_no") < F.col("start_page")).select("doc_id", "page_no", F.lit(file_name).alias("extract"))


def next_question_pattern(number: str) -> str | None:
    if number == "2":
        return None
    if number == "6":
        return r"^([7-9]|[1-9][0-9])\s"
    main = re.match(r"\d+", number)
    return rf"^{int(main[0]) + 1}\s" if main else r"^[2-9]\s"


def split_subquestions(pages: DataFrame, number: str) -> DataFrame:
    """(doc_id, letter, start_page, end_page): lettered parts of one main question.

    After the question's start page, a page with "(a)".."(z)" opens a part that
    runs to the page before the next opener; the first page of the next main
    question ends the search. The first part of each letter is kept.
    """
    starts = find_question_start(pages, number)
    after = pages.join(starts, "doc_id").filter(F.col("page_no") > F.col("start_page"))
    pattern = next_question_pattern(number)
    is_next = (F.exists(F.split("text", r"\r?\n"), lambda line: trimmed(line).rlike(pattern))
               if pattern else F.lit(False))
    flagged = after.select("doc_id", "page_no", is_next.alias("is_next"),
                           F.regexp_extract("text", OPENER, 1).alias("letter"))
    stops = flagged.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(F.col("is_next"), F.col("page_no"))), F.max("page_no") + 1).alias("stop"))
    openers = flagged.filter(F.col("letter") != "").join(stops, "doc_id").filter(
        F.col("page_no") < F.col("stop")).select("doc_id", "page_no", "letter", "stop")
    parts = next_position(openers, ["doc_id"], "page_no", ["page_no"], F.lit(True), "next_page", F.col("page_no"))
    ended = parts.select("doc_id", "letter", F.col("page_no").alias("start_page"),
                         (F.coalesce("next_page", "stop") - 1).alias("end_page"))
    return first_per_key(ended, ["doc_id", "letter"], [F.col("start_page")])


def is_guidance(text: Column) -> Column:
    low = F.lower(text)
    return ((F.length(trimmed(text)) < 50) | _any(low, GUIDANCE)
            | (low.contains(PUBLISHER) & ~low.contains("question")))


def drop_guidance_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~is_guidance(F.col("text")))


def is_markscheme_content(text: Column) -> Column:
    return (F.length(trimmed(text)) >= 30) & (_any(F.lower(text), MARKSCHEME_WORDS) | _any(text, MARKSCHEME_SIGNS))


def page_flags(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, content, short, keys), stored: what mark-scheme sections are cut by, from one scan of the pages.

    `keys` are the "1 (a)"-like marks in order, none on guidance pages.
    """
    text = F.col("text")
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(SUBQUESTION), F.lit(1)).alias("n"),
                          F.regexp_extract_all("text", F.lit(SUBQUESTION), F.lit(2)).alias("l"))
    keys = F.when(~is_guidance(text), F.transform(zipped, lambda z: F.concat(z["n"], z["l"])))
    return stored_table(pages.select("doc_id", "page_no", is_markscheme_content(text).alias("content"),
                                     (F.length(trimmed(text)) < 50).alias("short"), keys.alias("keys")))


def flagged_sections(flags: DataFrame) -> DataFrame:
    """(doc_id, key, start_page, max_end): the last "1 (a)"-like mark of each key and how far it may run.

    Marks are ordered by page and by place in the page; guidance pages have
    none. A section may run to the page before the next mark, or stays on its
    page when the next mark is there too.
    """
    marks = flags.select("doc_id", "page_no", F.posexplode("keys").alias("idx", "key"))
    last_page = flags.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    ahead = next_position(marks, ["doc_id"], "page_no", ["page_no", "idx"], F.lit(True), "next_page", F.col("page_no"))
    last = first_per_key(ahead, ["doc_id", "key"], [-F.col("page_no"), -F.col("idx")])
    return last.join(last_page, "doc_id").select(
        "doc_id", "key", F.col("page_no").alias("start_page"),
        F.when(F.col("next_page").isNull(), F.col("last_page"))
        .otherwise(F.greatest(F.col("page_no"), F.col("next_page") - 1)).alias("max_end"))


def subquestion_sections(pages: DataFrame) -> DataFrame:
    """`flagged_sections` of pages."""
    return flagged_sections(page_flags(pages))


def grown_sections(sections: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, key, start_page, end_page): sections grown over their mark-scheme pages.

    Growth passes over long pages without mark-scheme words and stops at a short
    one. A document has at most ten section keys, so each page meets at most ten.
    """
    inside = sections.join(flags.select("doc_id", "page_no", "content", "short"), "doc_id").filter(
        (F.col("page_no") > F.col("start_page")) & (F.col("page_no") <= F.col("max_end")))
    stops = F.min(F.when(~F.col("content") & F.col("short"), F.col("page_no")))
    seen = inside.groupBy("doc_id", "key").agg(stops.alias("stop"))
    ends = (inside.filter("content").join(seen, ["doc_id", "key"])
            .filter(F.col("stop").isNull() | (F.col("page_no") < F.col("stop")))
            .groupBy("doc_id", "key").agg(F.max("page_no").alias("grown")))
    return sections.join(ends, ["doc_id", "key"], "left").select(
        "doc_id", "key", "start_page", F.coalesce("grown", "start_page").alias("end_page"))


def extend_section_end(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """`grown_sections` of pages."""
    return grown_sections(sections, page_flags(pages))


def markscheme_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, key, start_page, end_page): sections found and grown on one scan of the pages."""
    flags = page_flags(pages)
    return grown_sections(flagged_sections(flags), flags)


def group_sections_by_main(sections: DataFrame) -> DataFrame:
    """(doc_id, main, page_no): union of the pages of each main question's sections."""
    return sections.select(
        "doc_id", F.substring("key", 1, 1).alias("main"),
        F.explode(F.sequence("start_page", "end_page")).alias("page_no")).distinct()


def question_table_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, key, page_no): "N (a)" keys found on each page of at least 10 characters."""
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(TABLE_KEY), F.lit(1)).alias("n"),
                          F.regexp_extract_all("text", F.lit(TABLE_KEY), F.lit(2)).alias("l"))
    keys = F.array_distinct(F.transform(
        zipped, lambda z: F.concat(z["n"], F.lit("("), z["l"], F.lit(")"))))
    return pages.filter(F.length(trimmed(F.col("text"))) >= 10).select("doc_id", F.explode(keys).alias("key"), "page_no")


def group_question_pages(table_pages: DataFrame, max_group: int = 5) -> DataFrame:
    """(doc_id, question, page_no): parts of questions up to `max_group` merged, later parts kept apart."""
    main = F.regexp_extract("key", r"^(\d+)\(", 1)
    number = main.try_cast("long")
    question = F.when(number <= max_group, number.cast("string")).otherwise(F.translate("key", "()", ""))
    return table_pages.filter((number > 0) | number.isNull()).select(
        "doc_id", question.alias("question"), "page_no").distinct()


def valid_pages(pages: DataFrame, min_len: int = 10, blank_phrase: str | None = None) -> DataFrame:
    """First of each distinct page text of a document, short and blank pages left out.

    Use (20, "blank page") for mock mark schemes.
    """
    body = trimmed(F.col("text"))
    keep = F.length(body) >= min_len
    if blank_phrase:
        keep = keep & ~F.lower("text").contains(blank_phrase)
    hashed = pages.filter(keep).select("doc_id", "page_no", F.md5(body).alias("text_md5"))
    return hashed.groupBy("doc_id", "text_md5").agg(F.min("page_no").alias("page_no"))


def pair_questions_with_markschemes(question_files: DataFrame, markscheme_files: DataFrame) -> DataFrame:
    """Questions with a mark scheme of the same number in the same paper folder.

    A folder has one file of a number; of several the first by name counts, on either side.
    """
    keys = ["topic", "board", "qualification", "year", "paper", "question_number"]
    questions = question_files.select(*keys, "question_file", "content_md5")
    schemes = markscheme_files.select(*keys, "markscheme_file", F.col("content_md5").alias("markscheme_md5"))
    return null_safe_join(first_per_key(questions, keys, [F.col("question_file"), F.col("content_md5")]),
                          first_per_key(schemes, keys, [F.col("markscheme_file"), F.col("markscheme_md5")]), keys)
