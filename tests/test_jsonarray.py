"""Large JSON arrays read in blocks, against json.loads."""

import json
import random

import pytest

from paperloom.schemas import BANK_JSON
from paperloom.sources import bank
from paperloom.sources.jsonarray import json_object_texts, read_json_arrays


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def awkward(seed, n):
    draw = random.Random(seed)
    words = ["}", "{", '"', "\\", "}, {", "[", "]", ",", "é", "\n", "a", "word", "\\\"", "}]", "{\"", " "]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words) for _ in range(draw.randrange(30)))
        nested = {"in": {"deep": text, "list": [{"x": text}, {}]}} if draw.random() < 0.3 else text
        rows.append({"questionNumber": str(i), "questionText": text, "more": nested, text: draw.choice([1, None, True, {}])})
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("indent", [None, 2])
def test_objects_equal_those_of_a_json_parser(small_blocks, tmp_path, seed, indent):
    files = [awkward(seed * 10 + k, n) for k, n in enumerate((0, 1, 3, 150))]
    for k, rows in enumerate(files):
        (tmp_path / f"{k}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=k % 2 == 0), "utf-8")
    (tmp_path / "empty.json").write_text("")
    got = json_object_texts(small_blocks, str(tmp_path))
    if not indent:
        assert small_blocks.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 4
    found = sorted(json.dumps(json.loads(r.text), sort_keys=True) for r in got.collect())
    assert found == sorted(json.dumps(r, sort_keys=True) for rows in files for r in rows)


def test_one_file_of_all_rows_is_read_by_many_tasks(small_blocks, tmp_path):
    rows = [{"questionNumber": f"{i}", "year": 2019, "qualification": "AS", "questionText": f"say {{{i}}}", "topics": ["1.1"]} for i in range(400)]
    (tmp_path / "bank.json").write_text(json.dumps(rows))
    good, bad = bank.read_question_bank(small_blocks, str(tmp_path), whole_up_to=2000)
    assert good.count() == 400 and bad.count() == 0
    assert {r.question_text for r in good.collect()} == {f"say {{{i}}}" for i in range(400)}
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "NestedLoop" not in plan


def test_broken_files_give_rejected_rows(spark, tmp_path):
    cases = {"cut": '[{"questionNumber": "1", "year": "2019", "qualification": "as"}, {"questionNumber": "2", "questionText": "no en',
             "junk": 'not json at all', "mixed": '[{"questionNumber": "3", "year": "2019", "qualification": "as"}, 7, "x"]',
             "single": '{"questionNumber": "4", "year": "2019", "qualification": "as"}', "blank": " \n", "none": "[]",
             "no_end": '[{"questionNumber": "5", "year": "2019", "qualification": "as"'}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = read_json_arrays(spark, str(tmp_path), BANK_JSON, whole_up_to=0)
    good, bad = bank.read_question_bank(spark, str(tmp_path), whole_up_to=0)
    assert sorted(r.question_number for r in good.collect()) == ["1", "3", "4", "5"]
    assert [r.reject for r in bad.collect()] == ["not JSON"] * 3
    assert sum(r["_corrupt_record"] is not None for r in rows.collect()) == 3


def test_an_object_without_end_is_named_not_gathered(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": "' + "}" * 500 + '"}, {"a": 1}]')
    texts = sorted(r.text for r in json_object_texts(spark, str(tmp_path), longest=100).collect())
    assert texts == ["object of 510 characters", '{"a": 1}']


def test_both_ways_give_the_same_rows(spark, tmp_path):
    for k, n in enumerate((3, 80)):
        (tmp_path / f"{k}.json").write_text(json.dumps(awkward(k, n)))
    ways = [sorted(map(tuple, read_json_arrays(spark, str(tmp_path), BANK_JSON, whole_up_to=w).collect()), key=repr) for w in (0, 2000, 1 << 27)]
    assert len(ways[0]) == 83 and ways[0] == ways[1] == ways[2]
