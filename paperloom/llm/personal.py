"""Personal data by weak supervision: labelers vote on spans, EM weighs them, and a span classifier learns from the result.

Base spans follow fixed patterns and always stay. Wider patterns find spans that are spelled otherwise (an "at" in brackets,
phone numbers without a plus, cards with dots), if they pass the same arithmetic: digits, Luhn sum, parts of an address.
Five labelers vote yes, no or nothing on every base and wide span: the base pattern, the usual shapes, a gazetteer of
words before it and of top-level domains, the characters around it, and the make-up of its characters. Equal spans by
kind, votes and features are counted, so that training sees a table bounded by the numbers of votes and features.

Expectation-maximisation finds, for each kind, how often each labeler says yes, no or nothing of true and of false spans; a
logistic regression by gradient steps then learns the resulting chances from features of the span alone. It decides
which wide spans are added. Both are aggregates of that small table, the parameters being a few hundred numbers.

DataFrame functions only. Each text is read once, where it lies; spans are arrays of its row and never need a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: The base patterns, with possessive repeats and starts that change no match but keep long runs linear.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT = r"(?:[ \t]?[\[({<][ \t]?(?:at|At|AT|@)[ \t]?[\])}>][ \t]?|[ \t](?:at|AT|@)[ \t]|@[ \t]?|[ \t]@)"
_DOT = r"(?:[ \t]?[\[({<][ \t]?(?:dot|Dot|DOT|\.)[ \t]?[\])}>][ \t]?|[ \t](?:dot|DOT)[ \t]|\.)"
_IP_DOT = r"(?:[ \t]?[\[({<][ \t]?(?:dot|DOT|\.)[ \t]?[\])}>][ \t]?|[ \t](?:dot|DOT|\.)[ \t])"
WIDE = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    rf"(?<![0-9A-Za-z:.])(?:[0-9]{{1,3}}(?:{_IP_DOT}[0-9]{{1,3}}){{3}}|(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}})(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z+])(?:\(?[0-9]{1,4}\)?[ ./-]{1,2}){2,5}[0-9]{2,5}(?![0-9A-Za-z])",
)
#: What a text must hold, by a quick search, for a pattern to be tried.
NEEDS = (r"(?i)@|[ \t]at[ \t]|[\[({<][ \t]?[aA][tT]", r"[0-9]", r"[0-9]", r"[0-9]")
#: Words shortly before a span that speak for its kind, and against any.
TRIGGERS = (r"(?i)\b(e-?mail|mail|contact|write|reach|address|correo|courriel)\b", r"(?i)\b(ip|host|server|address|ping|login from|dns)\b",
            r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b", r"(?i)\b(phone|tel|call|fax|mobile|cell|whatsapp|sms|telefon|teléfono|téléphone)\b")
COUNTER = r"(?i)\b(version|release|token|sha|hash|commit|isbn|issn|doi|invoice|serial|build|section|page|figure|table|look|looked|be|was|is|are|met|stay|arrive[ds]?)\W*$"
DOMAINS = r"(?i)(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|de|fr|es|uk|us|ca|au|it|nl|ch|at|eu|pt|br|mx|jp|cn|in|ru|se|no|pl|example|test)$"
OPEN, CLOSE, STAND_IN = "\ue000", "\ue001", "\ue002"  # private-use characters
BEFORE, AFTER, BLOCK = 24, 4, 256
SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
LABELERS, FEATURES = 5, 12
ROUNDS, STEPS = 20, 20
SETTLED = 0.02  # largest change of a parameter at which training ends
PRIOR = 4.0  # spans that the first guess of a reliability counts for


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), of)[0]


def spans(text: Column, pattern: str) -> Column:
    """All matches, as structs of place (code points, end exclusive), value and what stands around; linear in the text.

    Matches are marked in a copy of the text, which is then cut at the marks; `text` must not hold the marks. Places are sums
    of the pieces' lengths, taken in blocks so that no long array grows by one element at a time.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)

    def one(piece: Column, last: Column) -> Column:
        rest = F.substring_index(piece, CLOSE, -1)
        return F.struct((F.length(piece) - 1).alias("len"), F.substring_index(piece, CLOSE, 1).alias("value"),
                        F.right(F.substring_index(last, CLOSE, -1), F.lit(BEFORE)).alias("before"), F.left(rest, F.lit(AFTER)).alias("after"))

    def placed(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def add(acc: Column, f: Column) -> Column:
            span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(f["value"])).alias("end"), f["value"].alias("value"), f["before"].alias("before"), f["after"].alias("after"))
            return F.struct((acc["at"] + f["len"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

        return F.aggregate(block, zero, add, lambda acc: acc["out"])

    def blocks_placed(blocks: Column, first: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, f: a + f["len"]))
        starts = F.aggregate(sums, F.array(first), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + s))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), placed))

    def of(ps: Column) -> Column:
        n = F.size(ps) - 1
        found = F.zip_with(F.slice(ps, F.lit(2), n), F.slice(ps, F.lit(1), n), one)
        cut = lambda fs: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(fs, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(n > 0, _let(_let(found, cut), lambda blocks: blocks_placed(blocks, F.length(ps[0]))))

    return F.coalesce(_let(pieces, of), F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _valid(kind: int, span: Column) -> Column:
    value = span["value"]
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(value))
    if kind == CARD:
        return F.when((n >= 13) & (n <= 19), _let(_digits(value), _luhn)).otherwise(False)
    return (n >= 9) & (n <= 15)


def _wide_valid(kind: int, span: Column) -> Column:
    value = span["value"]
    if kind == EMAIL:
        spelled = value.rlike(r"(?i)[\])}> \t]dot[\[({< \t]|[ \t]dot[ \t]|[\[({<][ \t]?(?:dot|\.)")
        return value.rlike(r"[A-Za-z]{2,24}$") & (spelled | value.rlike(DOMAINS)) & value.rlike("^[A-Za-z0-9]")
    if kind == IP:
        four = F.array_join(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), ".")
        return F.when(F.contains(value, F.lit(":")), value.rlike("[0-9]")).otherwise(four.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == CARD:
        return _valid(CARD, span)
    groups = F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)))
    return _valid(PHONE, span) & (groups <= 5)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, wide): the base spans and the wider ones that touch none of them, as structs with their kind."""
    clean = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, STAND_IN * 2)
    none = F.array().cast(f"array<{SPAN}>")

    def of_kind(patterns: tuple[str, ...], valid: Callable[[int, Column], Column], kind: int) -> Column:
        found = F.when(F.col("_t").rlike(NEEDS[kind]), F.filter(spans(F.col("_t"), patterns[kind]), lambda s: valid(kind, s))).otherwise(none)
        return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                     s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))

    rows = docs.select("doc_id", clean.alias("_t"))
    rows = rows.select("doc_id", *[of_kind(BASE, _valid, k).alias(f"b{k}") for k in range(4)], *[of_kind(WIDE, _wide_valid, k).alias(f"w{k}") for k in range(4)])
    rows = stored(rows.select("doc_id", F.concat(*[f"b{k}" for k in range(4)]).alias("base"), F.concat(*[f"w{k}" for k in range(4)]).alias("wide")))
    apart = F.filter("wide", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return rows.select("doc_id", "base", apart.alias("wide"))


def _judged(span: Column, base: bool) -> Column:
    """A span's kind, votes (0 no, 1 nothing, 2 yes) and features."""
    kind, value, before, after = (span[c] for c in ("kind", "value", "before", "after"))
    digits = _digits(value)

    def by_kind(*conditions: Column) -> Column:
        out = F.when(kind == 0, conditions[0])
        for k, c in enumerate(conditions[1:], 1):
            out = out.when(kind == k, c)
        return F.coalesce(out, F.lit(False))

    trigger = by_kind(*[before.rlike(t) for t in TRIGGERS])
    counter = F.concat(before, F.regexp_extract(value, r"^[A-Za-z]+(?=[ \t]at)", 0)).rlike(COUNTER)
    domain = (kind == EMAIL) & value.rlike(DOMAINS)
    shape = by_kind(value.rlike(r"^[A-Za-z0-9](?:.*[^.])?[\])}>@ \t]+[A-Za-z0-9]") & value.rlike("[A-Za-z]{2,24}$"),
                    value.rlike(r"^[1-9][0-9]{0,2}[^0-9]") & ~value.rlike(r"(?<![0-9])0[0-9]"),
                    value.rlike(r"^[2-6]") & value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([^0-9]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([^0-9]{1,2})[0-9]{6}\2[0-9]{4,5})$"),
                    value.rlike(r"^\+|^\(|[0-9]{3}[ .-][0-9]{4}$"))
    left, right = (before == "") | before.rlike(r"[\s(\[<{\"':;,|]$"), (after == "") | after.rlike(r"^(?:[\s)\]>}\"':;,|!?*#$]|\.(?:\s|$))")
    distinct = F.size(F.array_distinct(F.split(digits, "")))
    varied = (kind == EMAIL) | (distinct >= 4) | F.contains(value, F.lit(":"))
    literal = (kind == EMAIL) & F.contains(value, F.lit("@")) | (kind != EMAIL) & ~value.rlike(r"[A-Za-z\[({<]|\(\.")
    votes = [F.lit(2 if base else 1), F.when(shape, 2).otherwise(0), F.when(trigger | domain & ~counter, 2).when(counter, 0).otherwise(1),
             F.when(left & right, 2).when(~left & ~right, 0).otherwise(1), F.when(varied, 1).otherwise(0)]
    flags = [F.lit(True), shape, trigger, counter, domain, left, right, varied, literal, F.contains(value, F.lit("+")) | F.contains(value, F.lit("(")),
             value.rlike(r"[\[({<]"), F.size(F.array_distinct(F.split(F.regexp_replace(value, "[A-Za-z0-9]", ""), ""))) > 2]
    return F.struct(kind.alias("kind"), F.array(*votes).alias("votes"), F.array(*[f.cast("double") for f in flags]).alias("features"))


def _numbers(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _chance(weights: list[float], bias: list[float]) -> Column:
    """The chance that a span with these votes is true; weights by kind, labeler and vote."""
    total = F.get(_numbers(bias), F.col("kind"))
    for i in range(LABELERS):
        total = total + F.get(_numbers(weights), (F.col("kind") * LABELERS + i) * 3 + F.col("votes")[i])
    return _logistic(total)


def _place(kind: int, labeler: int, vote: int) -> int:
    return (kind * LABELERS + labeler) * 3 + vote


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[list[float], list[float]]:
    """EM over (kind, votes, n): the logarithms of how much likelier a vote is for a true span, and of the odds of a kind.

    Yes counts as evidence for and no as evidence against at the start and, weakly, ever after, so that the two classes
    cannot change places and a labeler that never votes keeps its first guess.
    """
    guess = {2: (0.6, 0.2), 1: (0.2, 0.2), 0: (0.2, 0.6)}
    weights = [math.log(guess[v][0] / guess[v][1]) for _ in range(4) for _ in range(LABELERS) for v in range(3)]
    bias = [0.0] * 4
    for _ in range(rounds):
        judged = patterns.select("kind", "n", "votes", (F.col("n") * _chance(weights, bias)).alias("true"))
        cells = judged.select("kind", "n", "true", F.posexplode("votes").alias("labeler", "vote")).groupBy("kind", "labeler", "vote").agg(
            F.sum("true").alias("true"), F.sum(F.col("n") - F.col("true")).alias("false"))
        found = {(r.kind, r.labeler, r.vote): (r.true, r.false) for r in cells.collect()}  # at most 4 * LABELERS * 3 rows
        before = [*weights, *bias]
        for k in {kind for kind, _, _ in found}:
            whole = [sum(found.get((k, 0, v), (0.0, 0.0))[side] for v in range(3)) for side in (0, 1)]
            bias[k] = math.log((whole[0] + 1) / (whole[1] + 1))
            for i in range(LABELERS):
                for v in range(3):
                    yes, no = ((found.get((k, i, v), (0.0, 0.0))[side] + PRIOR * guess[v][side]) / (whole[side] + PRIOR) for side in (0, 1))
                    weights[_place(k, i, v)] = math.log(yes / no)
        if max(abs(a - b) for a, b in zip(before, [*weights, *bias])) < SETTLED:
            break
    return weights, bias


def _score(weights: list[float], kind: Column, features: Column) -> Column:
    total = F.lit(0.0)
    for j in range(FEATURES):
        total = total + F.get(_numbers(weights[j::FEATURES]), kind) * features[j]
    return _logistic(total)


def classifier(chances: DataFrame, steps: int = STEPS) -> list[float]:
    """Logistic regression of `chance` on `features`, for each kind; rows count n times. Kinds without rows keep a plain prior."""
    #: Before any step: shape and surroundings speak for a span, a counter word against it.
    start = [-2.0, 1.5, 1.0, -2.0, 1.0, 0.5, 0.5, 1.0, 0.0, 0.5, 0.0, 0.0]
    weights = start * 4

    def by_feature(rows: DataFrame, value: Column) -> dict[int, float]:
        each = rows.select("kind", value.alias("v"), F.posexplode("features").alias("j", "x"))
        sums = each.groupBy("kind", "j").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
        return {r.kind * FEATURES + r.j: r.s for r in sums.collect()}  # at most 4 * FEATURES rows

    counts = by_feature(chances, F.col("n"))
    for _ in range(steps):
        misses = by_feature(chances, F.col("n") * (F.col("chance") - _score(weights, F.col("kind"), F.col("features"))))
        # The curvature has this bound, so each step can only gain.
        moves = {at: (miss + PRIOR * (start[at % FEATURES] - weights[at])) / (counts[at] * FEATURES / 4 + PRIOR) for at, miss in misses.items()}
        for at, move in moves.items():
            weights[at] += move
        if all(abs(move) < SETTLED for move in moves.values()):
            break
    return weights


def learn(found: DataFrame) -> list[float]:
    """The classifier's weights from all spans of `found`."""
    judged = F.concat(F.transform("base", lambda s: _judged(s, True)), F.transform("wide", lambda s: _judged(s, False)))
    patterns = stored(found.select(F.explode(judged).alias("j")).groupBy("j.kind", "j.votes", "j.features").agg(F.count(F.lit(1)).alias("n")))
    small = patterns.coalesce(1)
    weights, bias = reliabilities(small)
    return classifier(small.select("kind", "features", "n", _chance(weights, bias).alias("chance")))


def personal_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every row as (doc_id, base, added): its base spans and those that the classifier adds, with kind, place and value.

    NULL texts are empty and have no spans. Rows without an id and repeated rows are rows of their own; other columns are
    not read. An added span touches no base span and none of an earlier kind. An empty table gives no rows.
    """
    found = stored(find(docs))
    weights = learn(found)
    likely = F.filter("wide", lambda s: _let(_judged(s, False), lambda j: _score(weights, j["kind"], j["features"])) >= threshold)
    marked = found.select("doc_id", "base", likely.alias("likely"))
    alone = F.filter("likely", lambda s: ~F.exists("likely", lambda o: (o["kind"] < s["kind"]) & (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return marked.select("doc_id", "base", alone.alias("added"))


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, by kind and place, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans_, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans of `personal_spans`, and all its spans, as one row for each of its rows."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
