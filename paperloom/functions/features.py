"""Derived question columns: marks, style flags, minutes and keys."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.names import first_case

# Marks looked for in this order, and the text-estimate list.
MARK_VALUES = [2, 4, 5, 6, 8, 10, 12, 15, 20, 25]
ESTIMATE_VALUES = [1, 2, 3, 4, 5, 8, 10, 12, 15, 20, 25]
SHORT_QUESTIONS = ["question1", "question2", "question3", "question4", "question5"]
# Stands for unknown marks in tests of the form marks > n.
UNKNOWN_MARKS = 2147483647

# Phrase lists of the text tests.
COMPUTATIONAL = ["calculate", "work out", "find the", "what is the value", "determine the", "compute"]
DIAGRAM = ["draw", "diagram", "graph", "illustrate", "show on"]
SCARCITY = ["scarcity", "opportunity cost", "choice", "resource allocation", "limited resources"]
ESSAY_VERBS = ["discuss", "evaluate", "assess"]


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def marks(number: Column, qualification: Column, paper: Column, text: Column) -> Column:
    """Marks by rule for questions 1-5 outside paper 3, else by the first listed '(n)' in the text."""
    in_text = F.get(F.filter(F.array(*[F.lit(m) for m in MARK_VALUES]),
                             lambda m: text.contains(F.concat(F.lit("("), m.cast("string"), F.lit(")")))), 0)
    by_rule = F.when(qualification == "alevel", 5).otherwise(4)
    return F.when(~F.coalesce(paper, F.lit("")).contains("3") & number.isin(SHORT_QUESTIONS),
                  by_rule).otherwise(in_text)


def known_or_max(marks: Column) -> Column:
    return F.coalesce(marks, F.lit(UNKNOWN_MARKS))


def is_question6(number: Column) -> Column:
    return F.coalesce(F.lower(number).startswith("question6"), F.lit(False))


def is_paper3_q1or2(number: Column) -> Column:
    low = F.lower(number)
    return F.coalesce(low.startswith("question1") | low.startswith("question2"), F.lit(False))


def is_essay(number: Column, paper: Column | None = None) -> Column:
    """Question 6, 1 or 2 by prefix; with `paper` given, 1 and 2 count in paper 3 only."""
    one_or_two = is_paper3_q1or2(number)
    if paper is not None:
        one_or_two = one_or_two & F.coalesce(paper.contains("3"), F.lit(False))
    return is_question6(number) | one_or_two


def is_context_based(number: Column, has_extract: Column, marks: Column) -> Column:
    return is_essay(number) | F.coalesce(has_extract, F.lit(False)) | (known_or_max(marks) >= 10)


def is_computational(text: Column) -> Column:
    return contains_any(F.lower(text), COMPUTATIONAL)


def requires_diagram(text: Column) -> Column:
    return contains_any(F.lower(text), DIAGRAM)


def estimate_marks(text: Column, parity: bool = False) -> Column:
    """Marks guessed from the text. With `parity`, '11 marks' also counts as '1 mark'."""
    rules = []
    for n in ESTIMATE_VALUES:
        unit = "mark" if n == 1 else "marks"
        said = text.contains(f"{n} {unit}")
        if not parity:  # the pattern is tried where the words are
            said = said & text.rlike(rf"(^|[^0-9]){n} {unit}" + ("([^s]|$)" if n == 1 else ""))
        rules.append((text.contains(f"({n})") | said, F.lit(n)))
    low = F.lower(text)
    rules += [(is_computational(text), F.lit(3)), (low.contains("explain one"), F.lit(3)),
              (contains_any(low, ESSAY_VERBS), F.lit(12))]
    return first_case(rules, F.lit(5))


def max_topics(marks: Column) -> Column:
    return F.when(marks <= 2, 2).when(marks <= 5, 3).otherwise(4)


def allows_economic_problem(text: Column, marks: Column) -> Column:
    return (marks >= 5) & contains_any(F.lower(text), SCARCITY)


def estimated_minutes(marks: Column, reads_context: Column, policy: str) -> Column:
    """Minutes for a question: long ones take 2.5 a mark, the others 1 or 2.

    Policies: 'marks' (long from 15 marks, else 2 a mark), 'single' (context
    questions long, else 1), 'unit' (context questions long, else 2).
    """
    long = (marks >= 15) if policy == "marks" else reads_context
    rate = 1 if policy == "single" else 2
    return F.when(long, F.round(marks * F.lit(2.5)).cast("int")).otherwise(marks * rate)


def marks_range(marks: Column) -> Column:
    m = known_or_max(marks)
    return (F.when(m <= 2, "1-2").when(m <= 4, "3-4").when(m <= 6, "5-6")
            .when(m <= 10, "7-10").otherwise("11+"))


def question_key(content_md5: Column, year: Column, board: Column, number: Column) -> Column:
    return F.coalesce(content_md5, F.concat_ws("_", year, board, number))
