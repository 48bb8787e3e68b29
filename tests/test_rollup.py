"""Reports from cells of parts against the same reports of the whole."""

import random

import pytest

from paperloom.operators import rollup, stats

SCHEMA = "q string, year string, board string, question_number string, marks int, topics array<string>"


def rows(seed, n, topics):
    draw = random.Random(seed)
    return [(draw.choice(["as", "alevel", None]), draw.choice(["2018", "2019", None]), draw.choice(["aqa", "ocr", None]),
             draw.choice(["question1", "question6a", None]), draw.choice([None, 4, 15]), draw.choice([None, [], draw.sample(topics, 2)])) for _ in range(n)]


def listed(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("by", [["q"], ["q", "board"], []])
def test_parts_merge_to_the_whole(spark, by):
    parts = [rows(1, 60, ["a", "b", "c"]), rows(2, 60, ["b", "c", "d", "e", None]), [], rows(3, 40, ["a", "z"])]
    numbers, cells, detail = None, None, None
    for part in parts:
        df = spark.createDataFrame(part, SCHEMA)
        numbers = rollup.numbered_topics(df, numbers)
        one, other = rollup.overview_cells(df, numbers, by), rollup.detail_cells(df, by)
        cells, detail = (one, other) if cells is None else (cells.unionByName(one), detail.unionByName(other))
    whole = spark.createDataFrame(sum(parts, []), SCHEMA)
    got = [r.asDict() for r in rollup.overview_from_cells(cells, by).collect()]
    want = [r.asDict() for r in stats.overview_stats(whole, by).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert listed(rollup.detail_from_cells(detail, by, 2)) == listed(stats.topic_detail(whole, by, 2))
    assert sorted(r.number for r in numbers.collect()) == list(range(1, 8))


def test_topics_of_far_buckets(spark):
    """Numbers of several bitmaps; topics shared by parts count once."""
    numbers = spark.range(1, 100_001).selectExpr("concat('t', id) as topic", "id as number")
    part = spark.range(1, 100_001, 1000).selectExpr("'x' as q", "'2019' as year", "'aqa' as board", "'question1' as question_number", "4 as marks",
                                                  "array(concat('t', id)) as topics")
    cells = rollup.overview_cells(part, numbers, ["q"])
    (row,) = rollup.overview_from_cells(cells.unionByName(cells), ["q"]).collect()
    assert (row.topics, row.total_questions, row.years) == (100, 200, 1)
