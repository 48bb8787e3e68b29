"""Steps that once moved, wrote or read their rows several times: same results, and the plan or the files that show it."""

import gzip
import json
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from paperloom.operators import assemble as am  # noqa: E402
from paperloom.operators.stats import by_topic  # noqa: E402

SCOPE = ["qualification", "topic"]
ROW = ("qualification string, topics array<string>, question_id string, question_number string, year string, board string, marks int, "
       "content_md5 string, markscheme_md5 string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df):
    """The keys of all exchanges."""
    return re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)\(?(.*?)\)?, \w+_\w+", plan(df))


@pytest.fixture(scope="module")
def copies(spark):
    rows = [(["as", "alevel", None][i % 3], ["a", "b", "c"][i % 2:i % 4 + 1], f"q{i:03}", f"question{i % 7}" if i % 11 else None, f"20{i % 9 + 10}" if i % 13 else None,
             "aqa", i % 5 + 1, f"{i * 37 % 83:02x}{i % 83}" if i % 17 else None, f"{i * 53 % 61:02x}{i % 61}" if i % 5 else None) for i in range(400)]
    return spark.createDataFrame(rows + rows[:40], ROW).repartition(3)


def first_rows(rows, md5):
    """Per scope: the first row of each file by year, number and id, in question order."""
    key = lambda v: (v is not None, v or "")
    groups = {}
    for r in rows:
        if r[md5] is not None:
            groups.setdefault((r["qualification"], r["topic"]), {}).setdefault(r[md5], []).append(r)
    return {g: sorted((min(rs, key=lambda r: (key(r["year"]), key(r["question_number"]), r["question_id"])) for rs in files.values()),
                      key=lambda r: (r["year"] or "", r["question_number"] or "", key(r["year"]), key(r["question_number"]), r[md5])) for g, files in groups.items()}


@pytest.mark.parametrize("exploded", [True, False])
def test_bundle_moves_each_question_once(copies, exploded):
    want = set()
    for (q, topic), rows in first_rows(by_topic(copies).collect(), "content_md5").items():
        kinds = [(k, r["question_id"]) for r in rows for k in ("question_separator", "question", "markscheme_separator", "markscheme")[:4 if r["markscheme_md5"] else 2]]
        want |= {(q, topic, i, k, qid) for i, (k, qid) in enumerate(kinds, 1)}
    got = am.bundle_manifest(by_topic(copies) if exploded else copies, SCOPE)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    keys = [k for k in moves(got) if "REPARTITION" not in k]
    assert not any("content_md5" in k for k in keys) and "SortMergeJoin" not in plan(got)


@pytest.mark.parametrize("exploded", [True, False])
def test_index_moves_each_question_once(spark, copies, exploded):
    """Some schemes have no count, one is counted twice, one count has no scheme and one no number."""
    files = sorted({r["markscheme_md5"] for r in copies.collect()} - {None})
    pages = {m: [i % 4 + 1] for i, m in enumerate(files) if i % 6} | {files[1]: [5, 2], "zz": [9], files[2]: [0]}
    counts = spark.createDataFrame([(m, None if m == files[2] else n) for m, ns in pages.items() for n in ns] + [(None, 7)], "markscheme_md5 string, valid_pages int")
    want = []
    for (q, topic), rows in first_rows(by_topic(copies).collect(), "markscheme_md5").items():
        at = 2
        for r in rows:
            for n in sorted(pages.get(r["markscheme_md5"], [0])):
                want.append((q, topic, r["question_id"], r["question_number"], r["year"], r["board"], r["marks"], at))
                at += n + 1
    got = am.markscheme_index(by_topic(copies) if exploded else copies, counts, SCOPE)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert not any("markscheme_md5" in k for k in moves(got)) and "SortMergeJoin" not in plan(got)


def test_names_are_parsed_once_for_all_claims(spark, monkeypatch):
    """The files are stored before their claims are told apart, so what made them runs once."""
    from paperloom.operators import catalogue
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = [(f"in/f{i:02}.pdf", f"f{i:02}.pdf", ["a_2019.pdf", None, f"t{i}.pdf", f"f{i:02}.pdf"][i % 4]) for i in range(80)]
    files = spark.createDataFrame(rows, "path string, name string, target string")
    got = {r.path: r.new_name for r in catalogue.resolve_name_collisions(files.mapInArrow(counted, files.schema)).collect()}
    assert runs.value == 80 and len(got) == 80
    assert got["in/f00.pdf"] == "a_2019.pdf" and got["in/f01.pdf"] is None and got["in/f02.pdf"] == "t2.pdf" and got["in/f03.pdf"] == "f03.pdf"
    assert got["in/f04.pdf"].startswith("a_2019_") and len(set(filter(None, got.values()))) == 60


def test_written_bank_is_compressed(spark, tmp_path):
    from paperloom.sources import bank
    questions = spark.range(500).selectExpr("concat('question', id % 7) as question_number", "cast(2015 + id % 2 as string) as year", "'aqa' as board", "'as' as qualification",
                                            "concat('text ', id) as question_text", "3 as marks", "array('x') as topics", "'/bank/aqa/1/f.pdf' as question_file",
                                            "cast(null as string) as markscheme_file")
    bank.write_question_bank(questions, str(tmp_path / "out"), max_records=100)
    files = [p for p in (tmp_path / "out").rglob("part-*")]
    assert all(p.name.endswith(".json.gz") and sum(1 for _ in gzip.open(p)) <= 100 for p in files)
    back = bank.read_written_bank(spark, str(tmp_path / "out"))
    assert sorted(r[0] for r in back.select("question_text").collect()) == sorted(f"text {i}" for i in range(500))


def test_array_files_are_written_without_a_move(spark, tmp_path):
    from paperloom.bindings import reports
    from paperloom.sources import bank
    texts = spark.range(0, 1050, 1, 3).selectExpr("""to_json(struct(concat('q', id) as questionNumber, '2019' as year, 'as' as qualification)) as value""")
    reports._write_arrays(texts, str(tmp_path / "in"), rows_a_file=100)
    files = list((tmp_path / "in").glob("part-*.txt.gz"))
    sizes = sorted(len(json.load(gzip.open(p))) for p in files)
    assert sizes == [50] * 3 + [100] * 9
    good, bad = bank.read_question_bank(spark, str(tmp_path / "in"), glob="*.txt.gz")
    assert bad.count() == 0 and {r[0] for r in good.select("question_number").collect()} == {f"q{i}" for i in range(1050)}


def test_halves_are_stored_once(spark, tmp_path):
    """The batches read by the cells come from one stored table, not from the lines and orders again."""
    from paperloom.bindings import reports
    for name, schema in [("lineitem", "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, "
                                      "l_returnflag string, l_linestatus string, l_shipdate date"), ("orders", "o_orderkey bigint, o_orderpriority string")]:
        rows = {"lineitem": [(i // 3, i % 3 + 1, i, i * 7, 5.0, 1.5, "A", "O", None) for i in range(60)], "orders": [(i, "1-URGENT") for i in range(20)]}[name]
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    halves = reports._halves(spark, str(tmp_path))
    assert sum(h.count() for h in halves) == 60 and all(h.count() for h in halves)
    assert not any("Join" in plan(h) or "l_orderkey" in plan(h) for h in halves)


@pytest.fixture(scope="module")
def mixed(spark):
    """Digests and other keys, NULL contents, ids and marks; copies on both sides of 10 marks; questions repeated whole."""
    topics = [["a"], ["a", "b"], ["b", "c"], [], ["c"]]
    content = lambda i: None if i % 7 == 0 else f"file{i % 29}" if i % 5 == 0 else f"{i * 37 % 211:032x}"
    rows = [(["as", "alevel", None][i % 3 % 2 if i % 31 else 2], topics[i % 5], f"q{i % 450:03}" if i % 97 else None, f"question{i % 3}" if i % 11 else None,
             f"20{i % 2 + 10}" if i % 13 else None, "aqa", i * 7 % 23 if i % 19 else None, content(i), i % 4 == 0) for i in range(900)]
    return spark.createDataFrame(rows + rows[:60], "qualification string, topics array<string>, question_id string, question_number string, year string, "
                                 "board string, marks int, content_md5 string, reads_context boolean").repartition(5)


def test_single_mock_moves_each_question_once_before_its_topics(spark, mixed):
    extracts = spark.createDataFrame([("aqa", "as", "2010", "1")], "board string, qualification string, year string, paper string")
    keyed = am.with_question_key(mixed)
    firsts = am._firsts_in_place(keyed, SCOPE, 10)
    got = am.first_per_key(firsts.drop("_salt"), [*SCOPE, "question_key"], [F.col("question_id"), F.col("question_number")]).filter("marks <= 10")
    columns = [*SCOPE, "question_id", "question_key", "question_number", "marks", "reads_context"]
    want = am.dedupe_questions(by_topic(keyed).select("qualification", "question_id", "question_key", "question_number", "marks", "reads_context", "topic"), SCOPE)
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(got) == rows(want.filter("marks <= 10")) and got.count() > 100
    # A digest's copies meet in its task: all but other keys are final.
    assert firsts.filter("_salt is null").groupBy(*SCOPE, "question_key").count().filter("count > 1").isEmpty()
    assert len(moves(firsts)) == 1 and "topic#" not in moves(firsts)[0]
    # The whole mock, also where the draw reads spread keys; each question of a mock is one of those.
    mock = am.single_topic_mock(mixed.withColumn("paper", F.lit("1")).drop("reads_context"), extracts, 7)
    taken = mock.select(*SCOPE, "question_id", "marks")
    assert taken.count() > 40 and taken.exceptAll(want.filter("marks <= 10").select(*taken.columns)).isEmpty()
