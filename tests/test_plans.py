"""Plan shapes that must hold whatever the data's size."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
CHECKED = ["topic_overview", "topic_distribution", "topic_report", "top_topics", "match_keywords", "direct_mention_bonus", "normalize_topic_label",
           "file_actions", "subquestion_sections", "extend_section_end", "bundle_manifest", "select_balanced",
           "single_topic_mock", "unit_mock", "extract_links", "links_by_section"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_pairwise_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_group_limits_run_before_the_shuffle(spark):
    for name in ("top_topics", "select_balanced"):
        assert "WindowGroupLimit" in plan(entry.queries()[name](spark, SF))


def test_scans_are_pruned(spark):
    text = entry.queries()["year_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in text.split("FileScan")[1]


def test_claims_have_no_hot_key(spark):
    """A third of the files want one target and a third have none; joins go by path, so no key is shared."""
    from paperloom.operators import catalogue, links
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(f"in/f{i:03}.pdf", f"f{i:03}.pdf", "a_2019.pdf" if i % 3 == 0 else None if i % 3 == 1 else f"t{i}.pdf") for i in range(300)]
    files = spark.createDataFrame(rows, "path string, name string, target string")
    resolved = catalogue.resolve_name_collisions(files)
    urls = spark.createDataFrame([(f"http://x/{i}/same.pdf" if i % 3 else f"http://x/{i}.pdf",) for i in range(300)], "url string")
    named = links.unique_filenames(urls)
    joins = [line for df in (resolved, named) for line in plan(df).splitlines() if "SortMergeJoin" in line]
    got, names_ = {r.path: r.new_name for r in resolved.collect()}, [r.file_name for r in named.collect()]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(joins) == 2 and all("path#" in j or "url#" in j for j in joins)
    assert got["in/f000.pdf"] == "a_2019.pdf" and got["in/f001.pdf"] is None and len(set(filter(None, got.values()))) == 200
    assert len(set(names_)) == 300 and "same.pdf" in names_


def test_levels_of_reach_do_not_move_the_links(spark):
    """No exchange above the scan of the stored links, and a hub's links lie in several buckets."""
    from paperloom.operators import links
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [("hub", f"t{i}") for i in range(300)] + [(f"t{i}", f"u{i % 7}") for i in range(300)] * 2 + [("t1", ""), ("t2", None), (None, "x")]
    edges, shares = links.stored_edges(spark.createDataFrame(rows, "src string, dst string"), most=50)
    frontier = spark.createDataFrame([("hub",), ("t5",), ("none",)], "url string")
    lines = plan(links.linked_from(edges, shares, frontier)).splitlines()
    scan = next(i for i, line in enumerate(lines) if edges in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "SortMergeJoin" in line)
    between = [line for line in lines[join:scan]]
    got = {r.url for r in links.linked_from(edges, shares, frontier).collect()}
    spread = spark.table(edges).filter("src = 'hub'").select("share").distinct().count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql(f"DROP TABLE {edges}")
    assert not any("Exchange" in line for line in between) and "Bucketed: true" in lines[scan]
    assert [tuple(r) for r in shares.collect()] == [("hub", 6)] and spread == 6
    assert got == {f"t{i}" for i in range(300)} | {"u5"}


def test_reach_of_empty_and_looping_links(spark):
    from paperloom.operators import links
    none = spark.createDataFrame([], "src string, dst string")
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert [tuple(r) for r in links.reachable(none, seeds, 2).collect()] == [("a", 0)]
    assert sorted(tuple(r) for r in links.reachable(loop, seeds, 4).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("links_")]


def test_report_reads_its_table_once(spark):
    text = plan(entry.queries()["topic_report"](spark, SF))
    assert text.count("Expand") == 1 and "Union" not in text
    assert len([line for line in text.splitlines() if "FileScan" in line and "lineitem" in line]) <= 1


def test_map_only_operators(spark):
    for name in ("extract_links", "links_by_section", "clean_text", "parse_exam_board"):
        assert "Exchange" not in plan(entry.queries()[name](spark, SF))


def test_entry(spark):
    assert entry.entry(spark).count() == 174
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_first_rows_of_an_index_are_cut_before_the_page_counts(spark, monkeypatch):
    """The one-page index joins the page counts with the first schemes only, also where a scheme is counted twice."""
    from paperloom.operators import assemble
    cut = []
    real = assemble.stored_table
    monkeypatch.setattr(assemble, "stored_table", lambda df: cut.append(plan(df)) or real(df))
    rows = [("as", "t", f"q{i}", f"question{i % 7}", f"20{i % 9 + 10}", "aqa", i, f"m{i // 2:03}") for i in range(200)]
    questions = spark.createDataFrame(rows, "qualification string, topic string, question_id string, question_number string, year string, board string, marks int, markscheme_md5 string")
    counts = spark.createDataFrame([(f"m{i:03}", i % 5 + 1) for i in range(100)] + [("m000", 3), ("m009", 3)], "markscheme_md5 string, valid_pages int")
    scope = ["qualification", "topic"]
    few = [tuple(r) for r in assemble.markscheme_index(questions, counts, scope, 25).orderBy("start_page", "question_id").collect()]
    monkeypatch.setattr(assemble, "stored_table", real)
    whole = [tuple(r) for r in assemble.markscheme_index(questions, counts, scope).orderBy("start_page", "question_id").collect()]
    assert few == whole[:25] and len(cut) == 1 and "valid_pages" not in cut[0]


def test_mocks_move_only_what_they_read(spark):
    """Copies are found among narrow rows, and a few papers are broadcast though they come from a large table."""
    from paperloom.operators import assemble
    from paperloom.bindings import tables as t
    from paperloom.operators.stats import by_topic
    mocks = plan(assemble.topic_mocks(by_topic(t.questions(spark, SF)), ["qualification", "topic"], 60, 4, 7))
    assert "question_text" not in mocks and "markscheme_md5" not in mocks
    context = plan(assemble.with_context(t.questions(spark, SF), t.extracts(spark, SF)))
    assert "o_orderdate" not in context and "BroadcastHashJoin" in context
