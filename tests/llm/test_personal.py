import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import personal
from paperloom.llm.common import read

SCHEMA = "kind string, doc_id bigint, text string, base string"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = [int(d) for d in re.findall("[0-9]", value)]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m.group())]


def expected(text):
    found = base_spans(text)
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
    return (*[sum(k == kind for k, _, _ in found) for kind in PATTERNS], digest)


def digests(df):
    return personal.span_digests(personal.personal_spans(df)).collect()


def check(rows, texts):
    base = {}
    for r in rows:
        base.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        order = list(PATTERNS)
        assert [(order.index(k), int(a)) for k, a, _ in spans] == sorted((order.index(k), int(a)) for k, a, _ in spans)
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(base_spans(texts[r.doc_id]))
    assert base == {i: [expected(t)] for i, t in texts.items()}


def test_base_spans_agree_with_plain_search(spark):
    rng = random.Random(4)
    texts = {0: None, 1: "", 2: "a@b.c.@d.e", 3: "+ 1 (2 3" * 30, 4: "1.2.3.4.5.6.7.8 256.1.1.1 00001.02.3.255 99999999999999999999.1.1.1",
             5: "é€😀 x@y.zz 😀 +1 (017) 555-5036, 4111-1111 1111 1111\n", 6: "7" * 70000, 7: "a" * 5000 + "@", 8: "a@b.c_d@e.f%g@h-i.j-@k",
             9: " a@b.cd  ", 10: "$1 \\1 a@b.cd $0", 11: " ".join(f"u{i}@h{i}.org" for i in range(700)), 12: "1 2-3" * 9000}
    alphabet = ["0", "1", "4", "5", "25", "255", "256", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "_", "😀", "\t", "4111111111111111"]
    for i in range(13, 600):
        texts[i] = "".join(rng.choices(alphabet, k=rng.randrange(1, 60)))
    df = spark.createDataFrame([("x", i, t, "clash") for i, t in texts.items()], SCHEMA).repartition(5)
    check(digests(df), texts)


HIDDEN = ["Write to jane.doe (at) example (dot) com please.", "mail: bob [at] mail3 [dot] example [dot] org", "Reach kim AT site DOT net now", "call (017) 555-7713 today",
          "phone 017-555-7713.", "tel. 001 017 555 7713", "card 4111.1111.1111.1111 ok", "visa 4111/1111/1111/1111", "host 10[.]20[.]30[.]40 is up",
          "server 192 dot 168 dot 7 dot 9", "Send to amy@ example.com"]
CLEAN = ["He was at home. Then at 10 we met.", "version 1.2.3 of 2024-01-15", "1 000 000 000 people", "token = 0b96a8c8d79c4a5085c919698889f59b72ab7bb6",
         "Look at the.Best of all", "ISBN 978-0-306-40615-7", "3.14159265358979", "rows 1, 2, 3, 4", "sha 1234 5678 9012 3456"]


def test_hidden_spans_are_added_and_clean_texts_left_alone(spark):
    plain = ["mail x.y7@mail7.example.com and", "from 97.51.17.173 to", "the +1 (017) 555-5036 on", "pay 4111 1111 1111 1111 now"]
    texts = {i: t for i, t in enumerate(HIDDEN + CLEAN + plain * 5)}
    rows = digests(spark.createDataFrame([("x", i, t, "clash") for i, t in texts.items()], SCHEMA))
    check(rows, texts)
    by_id = {r.doc_id: r.spans for r in rows}
    for i, t in texts.items():
        if i < len(HIDDEN):
            assert by_id[i].count(":") == 2, t
            kind, a, b = by_id[i].split(":")
            assert t[int(a):int(b)].count(" ") < 8 and re.search(r"\w", t[int(a)]) or t[int(a)] == "(", t
        elif i < len(HIDDEN) + len(CLEAN):
            assert by_id[i] == "", t


def test_empty_table_and_repeated_rows(spark):
    assert digests(spark.createDataFrame([], SCHEMA)) == []
    rows = digests(spark.createDataFrame([("x", None, "a@b.cd", None)] * 3, SCHEMA))
    assert [(r.doc_id, r.n_email, r.spans) for r in rows] == [(None, 1, "email:0:6")] * 3


def test_given_table(spark):
    df = read(spark, "/root/testdata/sf0.01", "documents")
    check(digests(df), {r.doc_id: r.text for r in df.collect()})


def test_reliabilities_find_the_planted_labelers(spark):
    rng = random.Random(9)
    right = [0.95, 0.9, 0.8, 0.7, 0.55]
    rows = []
    for _ in range(4000):
        true = rng.random() < 0.4
        rows.append((2, [(2 if true == (rng.random() < p) else 0) if rng.random() < 0.8 else 1 for p in right], 1, true))
    df = spark.createDataFrame(rows, "kind int, votes array<int>, n int, true boolean")
    weights, bias = personal.reliabilities(df.coalesce(1), 40)
    for i, p in enumerate(right):
        seen = weights[personal._place(2, i, 2)]
        assert abs(seen - __import__("math").log(p / (1 - p))) < 0.5, (i, seen)
    hits = df.select((personal._chance(weights, bias) >= 0.5).alias("is"), "true").filter(F.col("is") == F.col("true")).count()
    assert hits > 0.93 * len(rows)


@pytest.mark.parametrize("many", [0, 1, 255, 256, 257, 600])
def test_places_over_blocks(spark, many):
    text = "😀".join(f"<{i}>" for i in range(many))
    found = spark.range(1).select(personal.spans(F.lit(text), "[0-9]+").alias("s")).first().s
    assert [(s.start, s.end, s.value) for s in found] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]
