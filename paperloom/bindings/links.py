"""Link queries (C) over crawled pages."""

from pyspark.sql import functions as F

from paperloom.bindings import tables as t
from paperloom.operators import links as lk
from paperloom.operators.sections import links_by_sibling_section

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# The anchors of these pages are quoted and hold no nested anchors; hrefs are of the kinds named in the CASE.
_ANCHOR = lk.ANCHOR.replace("'", "''")
LINKS_SQL = t.SITE_PAGES_SQL + f""", raw AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '{_ANCHOR}', 1) AS h,
  regexp_extract_all(html, '{_ANCHOR}', 2) AS i FROM site_pages),
 anchors AS (SELECT page_id, page_url, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos, unnest(h) AS href, unnest(i) AS inner_html
  FROM raw),
 based AS (SELECT *, regexp_extract(page_url, '^([a-z]+:)', 1) AS scheme, regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) AS site,
  regexp_extract(page_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM anchors),
 links AS (SELECT page_id, page_url, pos, href, CASE WHEN starts_with(href, 'https://') THEN href
   WHEN starts_with(href, 'mailto:') THEN '' WHEN starts_with(href, '//') THEN scheme || href
   WHEN starts_with(href, '?') THEN site || path || href WHEN starts_with(href, '/') THEN site || href
   ELSE site || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END ||
    replace(href, 'files/../', '') END AS url,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(inner_html, '<[^>]*>', '', 'g'), '&lt;', '<'),
   '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM based)"""


def _links(spark, sf):
    return lk.extract_links(t.site_pages(spark, sf))


@query("extract_links", f"WITH {LINKS_SQL} SELECT * FROM links")
def _(spark, sf):
    return _links(spark, sf)


_DOCUMENT = "regexp_matches(url, '\\.(pdf|docx|pptx|xlsx)$')"


@query("filter_document_links", f"WITH {LINKS_SQL} SELECT page_id, pos, url FROM links WHERE regexp_matches(url, '\\.pdf$')")
def _(spark, sf):
    return lk.filter_document_links(_links(spark, sf), ["pdf"]).select("page_id", "pos", "url")


def _file_sql(expr):
    return f"regexp_replace({expr}, '[\\\\/:*?\"<>|]', '_', 'g')"


def _name_sql(expr):
    return f"replace(trim(regexp_replace({expr}, '[^a-zA-Z0-9\\- .]', '', 'g')), ' ', '-')"


@query("classify_links", f"""WITH {LINKS_SQL} SELECT page_id, pos, CASE WHEN {_DOCUMENT} THEN 'document'
  WHEN starts_with(url, 'https://') THEN 'shortcut' ELSE 'ignored' END AS kind,
 CASE WHEN {_DOCUMENT} THEN {_file_sql("regexp_extract(url, '([^/]*)$', 1)")}
  WHEN starts_with(url, 'https://') THEN {_file_sql(_name_sql('text'))} || '.url' END AS file_name FROM links""")
def _(spark, sf):
    return lk.classify_links(_links(spark, sf)).select("page_id", "pos", "kind", "file_name")


_HOST = "regexp_extract({0}, '^[a-z]+://([^:/?#]*)', 1)"


@query("same_site_links", f"WITH {LINKS_SQL} SELECT page_id, pos, url FROM links WHERE url <> '' AND contains(url, {_HOST.format('page_url')})")
def _(spark, sf):
    return lk.same_site_links(_links(spark, sf)).select("page_id", "pos", "url")


@query("distinct_urls", f"""WITH {LINKS_SQL} SELECT DISTINCT replace(trim(u), ' ', '%20') AS url FROM (
 SELECT ' ' || url || ' x' AS u FROM links WHERE url <> '' UNION ALL SELECT page_url FROM links)""")
def _(spark, sf):
    rows = _links(spark, sf)
    padded = rows.filter("url <> ''").select(F.concat(F.lit(" "), F.col("url"), F.lit(" x")).alias("url"))
    return lk.distinct_urls(padded.union(rows.select(F.col("page_url").alias("url"))))


# Users point at users: each event links its user to another.
_EDGES = "'u' || user_id AS src, 'u' || ((user_id * 3 + event_id % 5) % 997) AS dst"


@query("reachable", f"""WITH RECURSIVE e AS (SELECT DISTINCT {_EDGES} FROM events),
 r(url, depth) AS (SELECT DISTINCT 'u' || user_id, 0 FROM events WHERE event_type = 'purchase' AND user_id < 5
  UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 3)
 SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def _(spark, sf):
    events = t.table(spark, sf, "events")
    links = events.selectExpr("concat('u', user_id) as src", "concat('u', (user_id * 3 + event_id % 5) % 997) as dst")
    seeds = events.filter("event_type = 'purchase' and user_id < 5").selectExpr("concat('u', user_id) as url")
    return lk.reachable(links, seeds, 3)


@query("url_filename", f"""WITH {LINKS_SQL}, n AS (SELECT page_id, pos, url, regexp_extract(url_decode(regexp_extract(url,
  '^[a-z]+://[^/?#]*([^?#]*)', 1)), '([^/]*)$', 1) AS last FROM links WHERE url <> '')
 SELECT page_id, pos, 'notes_' || CASE WHEN last <> '' THEN last ELSE 'download_' || md5(url) || '.pdf' END AS file_name FROM n""")
def _(spark, sf):
    return _links(spark, sf).filter("url <> ''").select(
        "page_id", "pos", lk.url_filename(F.col("url"), "notes_").alias("file_name"))


@query("unique_filenames", f"""WITH {LINKS_SQL}, u AS (SELECT DISTINCT url FROM links WHERE url <> ''),
 n AS (SELECT url, regexp_extract(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '([^/]*)$', 1) AS last FROM u),
 b AS (SELECT url, CASE WHEN last <> '' THEN last ELSE 'download_' || md5(url) || '.pdf' END AS base FROM n)
 SELECT url, base, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY url) = 1 THEN base ELSE
  regexp_replace(base, '\\.[^.]*$', '') || '_' || md5(url) || regexp_extract(base, '(\\.[^.]*)$', 1) END AS file_name FROM b""")
def _(spark, sf):
    return lk.unique_filenames(_links(spark, sf).filter("url <> ''").select("url").distinct())


_SECTIONS = """SELECT page_id, 'Set-' || (page_id % 6) AS section, NULL AS parent, 'Extra' AS text FROM pages
 UNION ALL SELECT page_id, 'Theme-' || (page_id % 4) || '-notes' AS section, 'Theme-' || (page_id % 4) || '-notes' AS parent,
  'Notes & more' AS text FROM pages
 UNION ALL SELECT page_id, 'Theme-' || (page_id % 4) || '-notes', 'Theme-' || (page_id % 4) || '-notes', 'On site' FROM pages
 UNION ALL SELECT page_id, 'Past-papers', 'Theme-' || (page_id % 4) || '-notes', 'Paper' FROM pages
 UNION ALL SELECT page_id, 'Past-papers', 'Theme-' || (page_id % 4) || '-notes', 'Mail' FROM pages"""


@query("links_by_section", _SECTIONS)
def links_by_section(spark, sf):
    return lk.links_by_section(t.site_pages(spark, sf), parent_tag="h4").select("page_id", "section", "parent", "text")


# Block added to the pages' end: a header inside an element that is itself under a header.
_NESTED = """concat(html, '<div><h5>Inner ', page_id % 3, '</h5><p><a href="/in.pdf">In</a><p>x</div><a href="/after.pdf">After</a>')"""
_HEAD = "replace(regexp_extract(html, '<{0}>({1}[^<]*)</{0}>', 1), ' ', '-')"


@query("links_by_sibling_section", f"""WITH {t.SITE_PAGES_SQL}, nested AS (SELECT page_id, {_NESTED} AS html FROM site_pages),
 h AS (SELECT page_id, {_HEAD.format('h4', 'Theme ')} AS theme, {_HEAD.format('strong', 'Set ')} AS last, {_HEAD.format('h5', 'Inner ')} AS inner_head,
  replace(replace(regexp_extract(html, '<h5>(Past[^<]*)</h5>', 1), ':', ''), ' ', '-') AS past,
  regexp_extract_all(regexp_extract(html, '(?s)</h4>(.*?)<h5>Past', 1), 'href="([^"]*)"', 1) AS in_theme,
  regexp_extract_all(regexp_extract(html, '(?s)</h5><ul>(.*?)<strong> ', 1), 'href="([^"]*)"', 1) AS in_past,
  regexp_extract_all(regexp_extract(html, '(?s)<strong>Set [^<]*</strong>(.*)', 1), 'href="([^"]*)"', 1) AS in_last,
  regexp_extract_all(regexp_extract(html, '(?s)<h5>Inner [^<]*</h5>(.*?)</div>', 1), 'href="([^"]*)"', 1) AS in_inner FROM nested),
 s AS (SELECT page_id, theme AS section, theme AS parent, in_theme AS hrefs FROM h UNION ALL SELECT page_id, past, theme, in_past FROM h
  UNION ALL SELECT page_id, last, NULL, in_last FROM h UNION ALL SELECT page_id, inner_head, theme, in_inner FROM h),
 links AS (SELECT page_id, section, parent, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS pos, unnest(hrefs) AS href FROM s)
 SELECT page_id, section, parent, pos, CASE WHEN starts_with(href, 'mailto:') THEN '' ELSE regexp_extract(href, '([^/]*)$', 1) END AS file
 FROM links""")
def _(spark, sf):
    """Sections that end with their header's siblings, on pages whose sections are nested."""
    nested = t.site_pages(spark, sf).withColumn("html", F.expr(_NESTED))
    rows = links_by_sibling_section(nested, parent_tag="h4")
    return rows.select("page_id", "section", "parent", "pos", F.regexp_extract("url", "([^/]*)$", 1).alias("file"))


def _plain_sql(expr):
    expr = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        expr = f"replace({expr}, '{entity}', '{char}')"
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


@query("links_by_title", f"""WITH p AS (SELECT page_id, {_name_sql(_plain_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))} AS section,
  unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS href FROM pages) SELECT page_id, section, count(*) AS links FROM p
 WHERE section <> '' GROUP BY ALL""")
def _(spark, sf):
    """Links under the page title (all of them, as pages have no other header before their navigation)."""
    rows = lk.links_by_section(t.table(spark, sf, "pages"), ["title"])
    return rows.groupBy("page_id", "section").agg(F.count("*").alias("links"))


@query("theme_from_url", f"""WITH {LINKS_SQL} SELECT page_id, pos, CASE WHEN regexp_matches(url, 'theme-\\d+')
  THEN 'Theme-' || regexp_extract(url, 'theme-(\\d+)', 1) ELSE regexp_replace(url, '^.*/([^/]+)/?$', '\\1') END AS theme FROM links""")
def _(spark, sf):
    return _links(spark, sf).select("page_id", "pos", lk.theme_from_url(F.col("url")).alias("theme"))


@query("theme_links", f"""WITH {LINKS_SQL} SELECT page_id, pos, url, 'Theme-' || regexp_extract(url, 'theme-(\\d+)', 1) AS theme
 FROM links WHERE starts_with(url, 'https://docs.example.org/') AND contains(url, 'theme-')""")
def _(spark, sf):
    return lk.theme_links(_links(spark, sf), "https://docs.example.org/").select("page_id", "pos", "url", "theme")


@query("drop_empty_sections", f"""WITH s AS ({_SECTIONS}) SELECT DISTINCT page_id, section FROM s
 WHERE section = 'Past-papers' OR starts_with(section, 'Set-') OR page_id % 4 <> 1""")
def _(spark, sf):
    rows = lk.links_by_section(t.site_pages(spark, sf))
    sections = rows.select("page_id", "section").distinct()
    files = rows.filter(lk.is_document(F.col("url")) & ~((F.col("section") == "Theme-1-notes")))
    return lk.drop_empty_sections(sections, files, ["page_id", "section"])


_SIZE = "CAST(power(10, page_id % 11) AS BIGINT) + page_id * 37"


def _scaled(power, unit):
    return (f"regexp_replace(printf('%.2f', round_even(({_SIZE}) / {1024.0 ** power}::DOUBLE, 2)), '\\.?0+$', '') || ' {unit}'")


@query("human_bytes", f"""SELECT page_id, CASE WHEN {_SIZE} < 1024 THEN ({_SIZE}) || ' B' WHEN {_SIZE} < 1048576 THEN {_scaled(1, 'KB')}
 WHEN {_SIZE} < 1073741824 THEN {_scaled(2, 'MB')} ELSE {_scaled(3, 'GB')} END AS size FROM pages""")
def _(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", lk.human_bytes(F.expr(_SIZE)).alias("size"))


@query("download_totals", """WITH t AS (SELECT 'Theme ' || (page_id % 4) AS theme, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS bytes
  FROM pages GROUP BY 1)
 SELECT *, regexp_replace(printf('%.2f', round_even(bytes / CASE WHEN bytes < 1048576 THEN 1024.0::DOUBLE ELSE 1048576.0::DOUBLE END, 2)),
  '\\.?0+$', '') || CASE WHEN bytes < 1048576 THEN ' KB' ELSE ' MB' END AS data_used FROM t""")
def _(spark, sf):
    rows = t.table(spark, sf, "pages").select(
        F.concat(F.lit("Theme "), (F.col("page_id") % 4).cast("string")).alias("theme"), F.length("html").alias("size"))
    return lk.download_totals(rows, ["theme"])


@query("sanitize_names", f"""WITH {LINKS_SQL} SELECT page_id, pos, {_name_sql('text')} AS name, {_file_sql('url')} AS file,
 regexp_replace(url, '[^a-zA-Z0-9\\-]', '_', 'g') AS folder FROM links""")
def _(spark, sf):
    return _links(spark, sf).select("page_id", "pos", lk.sanitize_name(F.col("text")).alias("name"),
                                    lk.sanitize_file(F.col("url")).alias("file"), lk.sanitize_folder(F.col("url")).alias("folder"))


@query("first_link_per_url", f"""WITH {LINKS_SQL} SELECT page_id, pos, url FROM links
 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1""")
def _(spark, sf):
    return lk.first_link_per_url(_links(spark, sf).select("page_id", "pos", "url"))
