"""File-name parsing: one name column in, typed columns out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name shape and the three name patterns.
CANONICAL = (r"(?i)^[a-z0-9]+_[a-z0-9]+_[a-z0-9]+_\d{4}(_paper\d+)?"
             r"_(?:questionpaper|markscheme|examinerreport)\.[a-z0-9]+$")
PAPER = r"(?i)(?:paper|p)[\s_-]*(\d+)|paper[\s_-]*([a-z0-9]+)"
YEAR = r"(?:19|20)\d{2}"
LOOSE_MARKSCHEME = r"(?i)(?:mark|scheme|ms|solution|answers)"
LOOSE_QUESTION = r"(?i)(?:question|paper|qp|questions|\bq\b)"
LOOSE_EXAMINER = r"(?i)(?:examiner|report|er|examreport)"

# Codes, short codes and aliases.
DOCUMENT_TYPES = [("questionpaper", "qp"), ("markscheme", "ms"), ("examinerreport", "er")]
DOCUMENT_TYPE_HINTS = [("mark", "markscheme"), ("question", "questionpaper"),
                       ("report", "examinerreport")]
BOARDS = ["aqa", "edexcel", "ocr", "wjec", "cambridge", "ib", "pearson", "eduqas", "unknown"]
BOARD_ALIASES = {"pearson edexcel": "edexcel", "pearsonedexcel": "edexcel",
                 "caie": "cambridge", "cie": "cambridge"}
QUALIFICATIONS = ["gcse", "alevel", "as", "igcse", "diploma", "btec", "ib", "unknown"]
QUALIFICATION_ALIASES = {"a-level": "alevel", "a level": "alevel", "gce": "alevel",
                         "a_level": "alevel", "as-level": "as", "as level": "as"}

# Subject words, then subject fragments in order.
SUBJECTS = ["businessgrowth", "finance", "marketing", "operations", "hrm", "economics",
            "management", "accounting", "strategy", "entrepreneurship", "mathematics",
            "physics", "chemistry", "biology", "business"]
SUBJECT_FRAGMENTS = [("econ", "economics"), ("business", "business"), ("math", "mathematics"),
                     ("physics", "physics"), ("chemistry", "chemistry"), ("biology", "biology")]


def first_case(rules: list[tuple[Column, object]], default: Column | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs in order."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def is_canonical_name(name: Column) -> Column:
    return name.rlike(CANONICAL)


def extension(name: Column) -> Column:
    """From the last dot on, when something stands before it; else ''."""
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.when(extension(name) == "", name).otherwise(
        F.regexp_extract(name, r"^(.+)\.[^.]*$", 1))


def paper_token(name: Column) -> Column:
    """Text after the first 'paper'/'p' mark, NULL when there is none."""
    number, word = F.regexp_extract(name, PAPER, 1), F.regexp_extract(name, PAPER, 2)
    return F.when(number != "", number).when(word != "", word)


def paper_number(name: Column) -> Column:
    return paper_token(name).try_cast("int")


def paper_is_invalid(name: Column) -> Column:
    """The paper mark is there but is not a number: the file cannot be catalogued."""
    return paper_token(name).isNotNull() & paper_number(name).isNull()


def document_type(name: Column) -> Column:
    low = F.lower(name)
    return first_case([
        (low.contains(" ms ") | low.contains("markscheme") | low.contains("mark scheme"),
         F.lit("markscheme")),
        (low.contains(" qp ") | low.contains("questionpaper") | low.contains("question paper"),
         F.lit("questionpaper")),
        (name.rlike(LOOSE_MARKSCHEME), F.lit("markscheme")),
        (name.rlike(LOOSE_QUESTION), F.lit("questionpaper")),
        (name.rlike(LOOSE_EXAMINER), F.lit("examinerreport")),
    ])


def year(name: Column) -> Column:
    return F.regexp_extract(name, YEAR, 0).try_cast("int")


def name_tokens(name: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(stem(name)), "[^a-z0-9]", "_"), "_")


def exam_board(name: Column) -> Column:
    """First token of the name that names a board."""
    known = BOARDS + [a for a in BOARD_ALIASES if " " not in a]
    return normalize_enum(F.get(F.filter(name_tokens(name), lambda t: t.isin(known)), 0), "board")


def qualification(name: Column) -> Column:
    """First token naming a qualification; 'as level' / 'a level' anywhere overrides it."""
    low = F.lower(name)
    known = QUALIFICATIONS + ["gce"]
    token = F.get(F.filter(name_tokens(name), lambda t: t.isin(known)), 0)
    return first_case([
        (low.contains("as-level") | low.contains("as level"), F.lit("as")),
        (low.contains("a-level") | low.contains("a level"), F.lit("alevel")),
    ], normalize_enum(token, "qualification"))


def subject(name: Column, words: list[str] = SUBJECTS) -> Column:
    low = F.lower(name)
    listed = F.get(F.filter(name_tokens(name), lambda t: t.isin(words)), 0)
    return F.coalesce(listed, first_case([(low.contains(f), F.lit(s)) for f, s in SUBJECT_FRAGMENTS]))


def normalize_enum(text: Column, kind: str) -> Column:
    """Code of a document type, board or qualification given in any spelling; NULL if unknown."""
    low = F.lower(text)
    if kind == "document_type":
        rules = [((low == code) | (low == short) | low.contains(code), F.lit(code))
                 for code, short in DOCUMENT_TYPES]
        rules += [(low.contains(hint), F.lit(code)) for hint, code in DOCUMENT_TYPE_HINTS]
        return first_case(rules)
    codes, aliases = {"board": (BOARDS, BOARD_ALIASES),
                      "qualification": (QUALIFICATIONS, QUALIFICATION_ALIASES)}[kind]
    rules = [(low.isin(codes), low)]
    rules += [(low == alias, F.lit(code)) for alias, code in aliases.items()]
    return first_case(rules)


def is_complete(topic: Column, qualification: Column, board: Column, year: Column,
                doc_type: Column) -> Column:
    """Everything but the paper number is known."""
    return (topic.isNotNull() & qualification.isNotNull() & board.isNotNull()
            & (F.coalesce(year, F.lit(0)) > 0) & doc_type.isNotNull())


def canonical_name(topic: Column, qualification: Column, board: Column, year: Column,
                   paper: Column, doc_type: Column, extension: Column) -> Column:
    unknown = F.lit("unknown")
    paper_part = F.when(paper > 0, F.concat(F.lit("paper"), paper.cast("string")))
    return F.concat(
        F.concat_ws("_", F.coalesce(topic, unknown), F.coalesce(qualification, unknown),
                    F.coalesce(board, unknown), F.coalesce(year, F.lit(0)).cast("string"),
                    paper_part, F.coalesce(doc_type, unknown)),
        F.coalesce(extension, F.lit("")))
