from pyspark.sql import functions as F

from paperloom.operators import catalogue as cat
from paperloom.operators import links as lk


def test_file_actions(spark):
    rows = [("1", "economics_alevel_edexcel_2019_paper1_questionpaper.pdf"), ("2", "question paper unit 1.pdf"),
            ("3", "June 2018 MS - Edexcel Economics A-level.pdf"), ("4", "x.pdf"),
            ("5", "June 2018 MS - Edexcel Economics A-level .pdf")]
    answers = [("4", 'ok {"topic": "Eco-nomics", "qualification": "GCE", "examBoard": "CIE", "year": "2016", '
                     '"paper": "Paper 2", "documentType": "QP"}'),
               ("3", '{"topic": "other", "paper": 3}')]
    parsed = cat.parse_catalogue(spark.createDataFrame(rows, "path string, name string"))
    filled = cat.fill_missing(parsed, cat.parse_enrichment(spark.createDataFrame(answers, "path string, answer string")))
    actions = {r["path"]: r for r in cat.file_actions(filled).collect()}
    assert actions["1"]["status"] == "skipped"
    assert actions["2"]["status"] == "moved" and actions["2"]["new_name"] is None
    assert actions["3"]["new_name"] == "economics_alevel_edexcel_2018_paper3_markscheme.pdf"
    assert actions["4"]["new_name"] == "economics_alevel_cambridge_2016_paper2_questionpaper.pdf"
    assert actions["5"]["new_name"] == "economics_alevel_edexcel_2018_markscheme.pdf"
    summary = cat.catalogue_summary(cat.file_actions(filled)).first()
    assert tuple(summary) == (5, 1, 3, 1)


def test_collisions_keep_one_name(spark):
    files = spark.range(1000).select(
        F.col("id").cast("string").alias("path"), F.concat(F.lit("n"), "id").alias("name"), F.lit("t_a.pdf").alias("target"))
    for parts in (1, 37):
        out = cat.resolve_name_collisions(files.repartition(parts)).collect()
        assert len({r["new_name"] for r in out}) == 1000
        assert [r["path"] for r in out if r["new_name"] == "t_a.pdf"] == ["0"]


def test_links_by_section(spark):
    html = """<a href="/before.pdf">x</a><h4>Big <b>One</b></h4><p><a href='a.pdf'>A</a></p><h5>Sub &amp; two</h5>
      <ul><li><a class=z href=b.docx>B</a></li></ul><strong>!!!</strong><a href="lost.pdf">L</a>
      <H4>Next</H4><a href="c.pdf">C</a>"""
    pages = spark.createDataFrame([(1, "https://h.org/d/", html)], "page_id bigint, url string, html string")
    rows = {(r["section"], r["parent"], r["url"]) for r in lk.links_by_section(pages, parent_tag="h4").collect()}
    assert rows == {("Big-One", "Big-One", "https://h.org/d/a.pdf"), ("Sub--two", "Big-One", "https://h.org/d/b.docx"),
                    ("Next", "Next", "https://h.org/d/c.pdf")}
    flat = {(r["section"], r["parent"]) for r in lk.links_by_section(pages).collect()}
    assert flat == {("Big-One", None), ("Sub--two", None), ("Next", None)}
    kinds = lk.classify_links(lk.extract_links(pages)).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"document": 5}


def test_reachable(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = {r["url"]: r["depth"] for r in lk.reachable(links, seeds, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert lk.reachable(links, seeds, 0).count() == 1


def test_unique_filenames(spark):
    urls = spark.createDataFrame([("https://a.org/x.pdf",), ("https://b.org/x.pdf",), ("https://b.org/y.pdf",)], "url string")
    names = {r["url"]: r["file_name"] for r in lk.unique_filenames(urls, "p_").collect()}
    assert names["https://a.org/x.pdf"] == "p_x.pdf" and names["https://b.org/y.pdf"] == "p_y.pdf"
    assert names["https://b.org/x.pdf"].startswith("p_x_") and len(set(names.values())) == 3
