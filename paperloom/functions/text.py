"""Scalar text functions: cleaning, masking, counting and formatting."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.names import first_case

# Exam-paper noise, removed in this order (pattern, replacement).
NOISE = [
    (r"\*P\d+A\d+\*", ""),
    (r"D\s*O\s*N\s*O\s*T\s*W\s*R\s*I\s*T\s*E\s*I\s*N\s*T\s*H\s*I\s*S\s*A\s*R\s*E\s*A", ""),
    (r"\.{2,}", " "),
    (r"\. \.", " "),
    (r"  \.", " "),
    (r"\bPMT\b", ""),
    (r"\?+", ""),
    (r"(?m)^\d+$", ""),
    (r"(?i)\bP\d+\b", ""),
    (r"(?i)turn over", ""),
    (r"(?i)page \d+ of \d+", ""),
    (r"(?i)continue on the next page", ""),
    (r"\(Total for Question \d+:? \d+ marks?\)", ""),
    (r"\(Total for Question \d+ = \d+ marks?\)", ""),
    (r"TOTAL FOR SECTION [A-Z] = \d+ MARKS", ""),
    (r"\(\d+ marks?\)", ""),
    (r"\s+", " "),
]

# Phrases that say nothing about the topic, masked in this order.
IGNORE_PHRASES = [
    "using the data from the extract",
    "using information from the extract",
    "refer to the extract",
    "based on the extract",
    "from the information provided",
    "using the information",
    "using figure",
    "using table",
    "using diagram",
    "using the graph",
    "according to the data",
    "from the data shown",
    "with reference to extract",
    "calculate",
    "show your working",
    "you are advised to show",
    "marks available",
    "section a",
    "section b",
    "section c",
]
MASK = "for this question"

# Months by path word.
MONTH_WORDS = [("June", ["june", "summer", "may"]), ("October", ["october", "autumn", "fall"]),
               ("January", ["january", "winter"]), ("March", ["march", "spring"])]
# Qualification labels.
QUALIFICATION_LABELS = {"a_level": "A Level", "alevel": "A Level", "as": "AS Level",
                        "gcse": "GCSE", "igcse": "IGCSE", "ib": "IB"}
PREVIEW_EXTENSIONS = ["txt", "csv", "md", "json", "xml", "html"]


def clean_text(text: Column) -> Column:
    cleaned = reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), NOISE,
                     F.coalesce(text, F.lit("")))
    return F.trim(cleaned)


def mask_phrases(text: Column, phrases: list[str] = IGNORE_PHRASES, mask: str = MASK) -> Column:
    """Each phrase, in list order and in any case, becomes `mask`."""
    return reduce(lambda t, p: F.regexp_replace(t, rf"(?i)\Q{p}\E", mask), phrases,
                  F.coalesce(text, F.lit("")))


def count_occurrences(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences of a non-empty keyword."""
    left = F.length(text) - F.length(F.replace(text, keyword, F.lit("")))
    return F.when(F.length(keyword) > 0, (left / F.length(keyword)).cast("int"))


def capitalize_words(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(
        words, lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def format_qualification(code: Column) -> Column:
    low = F.lower(code)
    rules = [(code.isNull(), F.lit("Unknown"))]
    rules += [(low == c, F.lit(label)) for c, label in QUALIFICATION_LABELS.items()]
    return first_case(rules, capitalize_words(F.replace(code, F.lit("_"), F.lit(" "))))


def qualification_label(code: Column) -> Column:
    """Lower-case label used as the report key."""
    low = F.lower(code)
    return first_case([(low.isin("a_level", "alevel"), F.lit("a level")),
                       (low == "as", F.lit("as level")),
                       (code.isNull(), F.lit("unknown"))], low)


def format_topic(topic: Column) -> Column:
    return F.when(topic.isNull(), "Unknown Topic").otherwise(
        capitalize_words(F.translate(topic, "_-", "  ")))


def format_question_number(number: Column) -> Column:
    return (F.when(number.isNull(), "Unknown")
            .when(F.lower(number).startswith("question"),
                  F.concat(F.lit("Question "), F.upper(number.substr(F.lit(9), F.length(number)))))
            .otherwise(number))


def original_question_number(number: Column) -> Column:
    return F.trim(F.replace(F.lower(F.coalesce(number, F.lit(""))), F.lit("question"), F.lit("")))


def sanitize_file_name(name: Column) -> Column:
    coded = F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', ""))
    plain = F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9_\s\.]", "_"))
    return F.when(name.rlike(r"^\d+\.\d+"), coded).otherwise(plain)


def exam_month(path: Column) -> Column:
    low = F.lower(path)
    rules = [(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(month))
             for month, words in MONTH_WORDS]
    return first_case(rules, F.lit("June"))


def paper_identifier(year: Column, board: Column, paper: Column) -> Column:
    return F.concat_ws("_", year, board, paper)


def truncate_label(label: Column, keep: int) -> Column:
    """First `keep` characters and '...' when the label is longer (chart labels use 8)."""
    return F.when(F.length(label) > keep, F.concat(label.substr(1, keep), F.lit("..."))).otherwise(label)


def trim_topic(topic: Column, max_len: int = 50) -> Column:
    """At most `max_len` characters, dots included."""
    return F.when(F.length(topic) > max_len,
                  F.concat(topic.substr(1, max_len - 3), F.lit("..."))).otherwise(
        F.coalesce(topic, F.lit("")))


def preview_text(text: Column, extension: Column, n: int = 1000) -> Column:
    """First n characters of a text file; a notice for other types."""
    ext = F.lower(F.regexp_replace(extension, r"^\.", ""))
    return F.when(
        ext.isin(PREVIEW_EXTENSIONS),
        F.when(F.length(text) > n, F.concat(text.substr(1, n), F.lit("..."))).otherwise(text)
    ).otherwise(F.concat(F.lit("File type "), ext, F.lit(" - content extraction not implemented")))


def extract_json_object(text: Column) -> Column:
    """From the first '{' to the last '}' (the whole text when there is no such pair)."""
    cut = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(cut == "", text).otherwise(cut)


def extract_json_array(text: Column) -> Column:
    cut = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(cut != "", cut)


def json_array_items(text: Column) -> Column:
    """Strings of the array cut out of an answer; NULL when it does not parse."""
    return F.from_json(extract_json_array(text), "array<string>")


def seeded_order(seed: int, *parts: Column) -> Column:
    """Reproducible random order: md5 of the parts and the seed."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))
