"""Links of crawled pages: extraction, classification, sections, names and reach."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.scale import cut_lineage, first_per_key, scratch_folder, stored_table

# Anchor pattern, document extensions and header tags.
ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*["']?([^"'\s>]*)["']?[^>]*>(.*?)</a>"""
DOCUMENT_EXTENSIONS = ["pdf", "docx", "pptx", "xlsx"]
HEADER_TAGS = ["h4", "h5", "strong"]

EDGES_A_SHARE = 1_000_000


def plain_text(html: Column) -> Column:
    """Tags dropped, entities of the basic set decoded, spaces collapsed."""
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    entities = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
    decoded = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), entities, bare)
    return F.trim(F.regexp_replace(decoded, r"\s+", " "))


def _without_dots(path: Column) -> Column:
    """'.' and '..' segments resolved."""
    empty = F.expr("cast(array() as array<string>)")

    def step(done, part):
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.array_append(done, part))

    ends_open = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    kept = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    resolved = F.when(kept == "", "/").otherwise(F.concat(kept, ends_open))
    return F.when(path.contains("/."), F.regexp_replace(resolved, "//+$", "/")).otherwise(path)


def absolute_url(href: Column, base: Column) -> Column:
    """href resolved against the page URL; '' when it has another scheme than http(s)."""
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(path, r"^(.*/)?", 1))
    bare_base = F.regexp_extract(base, r"^([^#]*)", 1)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (F.when(href == "", base)
            .when(href.rlike(r"(?i)^https?://"), href)
            .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "")
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("#"), F.concat(bare_base, href))
            .when(href.startswith("?"), F.concat(site, path, href))
            .when(href.startswith("/"), F.concat(site, _without_dots(href_path), tail))
            .otherwise(F.concat(site, _without_dots(F.concat(
                F.when(folder == "", "/").otherwise(folder), href_path)), tail)))


def _anchors(html: Column) -> Column:
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"),
                        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("inner"))


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, pos, href, url, text) for every anchor with an href; map-only."""
    rows = pages.select("page_id", F.col("url").alias("page_url"),
                        F.posexplode(_anchors(F.col("html"))).alias("pos", "a"))
    return rows.select("page_id", "page_url", "pos", F.col("a.href").alias("href"),
                       absolute_url(F.col("a.href"), F.col("page_url")).alias("url"),
                       plain_text(F.col("a.inner")).alias("text"))


def is_document(url: Column, extensions: list[str] = DOCUMENT_EXTENSIONS) -> Column:
    return url.rlike(rf"\.({'|'.join(extensions)})$")


def filter_document_links(links: DataFrame, extensions: list[str] = DOCUMENT_EXTENSIONS) -> DataFrame:
    return links.filter(is_document(F.col("url"), extensions))


def classify_links(links: DataFrame) -> DataFrame:
    """kind: document, shortcut (other https links) or ignored, with the file each would be saved as."""
    url = F.col("url")
    kind = F.when(is_document(url), "document").when(url.startswith("https://"), "shortcut").otherwise("ignored")
    last = F.regexp_extract(url, r"([^/]*)$", 1)
    return links.withColumn("kind", kind).withColumn(
        "file_name", F.when(F.col("kind") == "document", sanitize_file(last))
        .when(F.col("kind") == "shortcut", F.concat(sanitize_file(sanitize_name(F.col("text"))), F.lit(".url"))))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)


def same_site_links(links: DataFrame) -> DataFrame:
    """Links whose URL is non-empty and contains the host of their page."""
    return links.filter((F.col("url") != "") & F.col("url").contains(host(F.col("page_url"))))


def stored_edges(links: DataFrame, most: int = EDGES_A_SHARE) -> tuple[str, DataFrame]:
    """(table name, shares): the distinct links (src, dst) stored in buckets of (src, share), and the sources of more shares than one.

    A source with more than `most` links is spread over shares by its links' targets, so a hub is read by many tasks. The
    table lies in the session's shared folder; `shares` (src, shares) has at most a row for every `most` links.
    """
    spark = links.sparkSession
    edges = stored_table(links.select("src", "dst").filter((F.col("dst") != "") & F.col("dst").isNotNull()).distinct())
    shares = stored_table(edges.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > most)
                          .select("src", F.ceil(F.col("n") / most).cast("int").alias("shares")))
    share = F.pmod(F.xxhash64("dst"), F.coalesce("shares", F.lit(1))).cast("int")
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"links_{uuid.uuid4().hex}"
    dealt = edges.join(shares, "src", "left").select("src", "dst", share.alias("share"))
    (dealt.repartition(buckets, "src", "share").write.bucketBy(buckets, "src", "share").sortBy("src", "share")
     .option("path", scratch_folder(spark)).saveAsTable(name))
    return name, shares


def linked_from(edges: str, shares: DataFrame, frontier: DataFrame) -> DataFrame:
    """(url): the distinct targets of the frontier's links. Only the frontier moves; the stored links are read where they lie."""
    asked = frontier.select(F.col("url").alias("src")).join(shares, "src", "left").select(
        "src", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    return frontier.sparkSession.table(edges).join(asked, ["src", "share"]).select(F.col("dst").alias("url")).distinct()


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): fewest links from a seed, down to `max_depth` links.

    `links` has src and dst, `seeds` has url. The links are stored once, in buckets of their source, and each level joins
    only the newest frontier with them without moving them. Each level is checkpointed, so a lost executor costs one
    level and the plan stays flat.
    """
    edges, shares = stored_edges(links)
    frontier = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    visited = frontier
    try:
        for depth in range(1, max_depth + 1):
            fresh = linked_from(edges, shares, frontier).join(visited.select("url"), "url", "left_anti")
            frontier = cut_lineage(fresh.withColumn("depth", F.lit(depth)))
            visited = visited.unionByName(frontier)
    finally:
        # All levels are checkpointed by now; the name goes, the files stay in the shared folder.
        links.sparkSession.sql(f"DROP TABLE IF EXISTS {edges}")
    return visited


def normalize_url(url: Column) -> Column:
    return F.replace(F.trim(url), F.lit(" "), F.lit("%20"))


def distinct_urls(links: DataFrame) -> DataFrame:
    return links.select(normalize_url(F.col("url")).alias("url")).filter(F.col("url") != "").distinct()


def url_filename(url: Column, prefix: str = "") -> Column:
    """Last segment of the decoded path, else a name made from the URL's md5."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(F.try_url_decode(path), r"([^/]*)$", 1)
    made = F.concat(F.lit("download_"), F.md5(url), F.lit(".pdf"))
    return F.concat(F.lit(prefix), F.when(last != "", last).otherwise(made))


def unique_filenames(urls: DataFrame, prefix: str = "") -> DataFrame:
    """One file name per URL: the first URL keeps a contested name, the others add their md5.

    The keepers are folded map-side and joined back by name and URL, so a name that most URLs want is no hot key.
    """
    named = urls.select("url", url_filename(F.col("url"), prefix).alias("base"))
    keepers = named.groupBy("base").agg(F.min("url").alias("url")).withColumn("keeps", F.lit(True))
    stem = F.regexp_replace("base", r"\.[^.]*$", "")
    ext = F.regexp_extract("base", r"(\.[^.]*)$", 1)
    return named.join(keepers, ["base", "url"], "left").select(
        "url", "base", F.when(F.col("keeps"), F.col("base"))
        .otherwise(F.concat(stem, F.lit("_"), F.md5("url"), ext)).alias("file_name"))


def links_by_section(pages: DataFrame, header_tags: list[str] = HEADER_TAGS,
                     parent_tag: str | None = None, nested_tag: str = "h5") -> DataFrame:
    """(page_id, section, pos, url, text, parent): links under the header before them.

    Sections follow document order; links before the first header have none and
    are left out, as are sections whose header text is empty. With `parent_tag`,
    `parent` is the last header of that tag for sections under it and under a
    `nested_tag`; others have none. The page is cut at its header tags inside its
    own row, so nothing is shuffled.
    """
    tags = "|".join(header_tags)
    cut = F.split(F.col("html"), rf"(?i)(?=<(?:{parent_tag})\b)") if parent_tag else F.array("html")
    blocks = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(cut).alias("block", "part"))
    heads = blocks.select(
        "page_id", "page_url", "block",
        (sanitize_name(plain_text(F.regexp_extract("part", rf"(?is)^<(?:{parent_tag})\b[^>]*>(.*?)</", 1)))
         if parent_tag else F.lit(None).cast("string")).alias("parent"),
        F.posexplode(F.split("part", rf"(?i)(?=<(?:{tags})\b)")).alias("sec", "piece"))
    titled = heads.withColumn(
        "section", sanitize_name(plain_text(F.regexp_extract("piece", rf"(?is)^<({tags})\b[^>]*>(.*?)</\1>", 2))))
    if parent_tag:
        nests = F.col("piece").rlike(rf"(?i)^<(?:{parent_tag}|{nested_tag})\b")
        titled = titled.withColumn("parent", F.when(nests, F.col("parent")))
    rows = titled.filter(F.col("section") != "").select(
        "*", F.posexplode(_anchors(F.col("piece"))).alias("pos", "a"))
    return rows.select(
        "page_id", "block", "sec", "section", "parent", "pos",
        absolute_url(F.col("a.href"), F.col("page_url")).alias("url"),
        plain_text(F.col("a.inner")).alias("text"))


def theme_from_url(url: Column) -> Column:
    theme = F.regexp_extract(url, r"theme-(\d+)", 1)
    return F.when(theme != "", F.concat(F.lit("Theme-"), theme)).otherwise(
        F.regexp_replace(url, r"^.*/([^/]+)/?$", "$1"))


def theme_links(links: DataFrame, base_url: str, marker: str = "theme-") -> DataFrame:
    """Links below `base_url` whose URL has the marker, with their theme."""
    url = F.col("url")
    return links.filter(url.startswith(base_url) & url.contains(marker)).withColumn("theme", theme_from_url(url))


def drop_empty_sections(sections: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    return sections.join(files.select(*keys).distinct(), keys, "left_semi")


def human_bytes(size: Column) -> Column:
    """B, KB, MB or GB with up to two decimals."""
    def scaled(power):
        rounded = F.bround(size / F.lit(1024.0 ** power), 2)
        return F.regexp_replace(F.format_string("%.2f", rounded), r"\.?0+$", "")

    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1024 ** 2, F.concat(scaled(1), F.lit(" KB")))
            .when(size < 1024 ** 3, F.concat(scaled(2), F.lit(" MB")))
            .otherwise(F.concat(scaled(3), F.lit(" GB"))))


def download_totals(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """Files with content and their bytes, per `by`."""
    totals = files.filter(F.col("size") > 0).groupBy(*by).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return totals.withColumn("data_used", human_bytes(F.coalesce("bytes", F.lit(0))))


def sanitize_name(text: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(text, r"[^a-zA-Z0-9\- .]", "")), F.lit(" "), F.lit("-"))


def sanitize_file(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def sanitize_folder(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9\-]", "_")


def first_link_per_url(links: DataFrame) -> DataFrame:
    """Each URL once, with the page and position it was first seen at."""
    return first_per_key(links, ["url"], [F.col("page_id"), F.col("pos")])
