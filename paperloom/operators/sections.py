"""Links of crawled pages under the headers whose siblings hold them.

`links.links_by_section` follows document order and is map-only SQL. Here a section ends where its header's siblings end, so
elements must be nested: a page's tags are folded once, left to right, over a stack of its open elements. The fold is the
one step in Python; pages come to it in Arrow batches and each page is one call.
"""

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.links import HEADER_TAGS, absolute_url, sanitize_name

# Elements without an end tag, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                           "header hr main menu nav ol p pre section table ul".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}}
LIMITS = frozenset("ul ol dl table select div article section td th".split())
#: What a folder name cannot hold; a header of nothing else has no name.
NAMELESS = re.compile(r"[^a-zA-Z0-9\- .]")
TRANSPARENT = frozenset(["html", "head", "body"])

LINKS = "array<struct<section: string, parent: string, sec: int, pos: int, href: string, text: string>>"


class _Fold(HTMLParser):
    """One page's links under headers. Each open element keeps the header now in force among its children."""

    def __init__(self, header_tags: frozenset):
        super().__init__(convert_charrefs=True)
        self.header_tags, self.headers, self.found, self.reading = header_tags, [], [], []
        self.stack = [{"tag": "", "in_force": None, "own": None}]

    def handle_starttag(self, tag, attrs):
        if tag in TRANSPARENT:
            return
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, LIMITS)
        self._end(ENDED_BY.get(tag, ()), LIMITS - ENDED_BY.get(tag, set()))
        href, own = dict(attrs).get("href"), None
        if tag in self.header_tags:
            self.stack[-1]["in_force"] = None
            own = {"tag": tag, "sec": len(self.headers), "said": []}
            self.headers.append(own)
        elif tag == "a" and href is not None:
            own = {"tag": tag, "href": href.strip(), "said": []}
            self.found += [(level["in_force"], own) for level in self.stack if level["in_force"]]
        if tag not in VOID:
            self.stack.append({"tag": tag, "in_force": None, "own": own})
            if own:
                self.reading.append(own)

    def handle_endtag(self, tag):
        self._end({tag}, ())

    def handle_data(self, data):
        if self.stack[-1]["tag"] not in ("script", "style"):
            for own in self.reading:
                own["said"].append(data)

    def _end(self, tags, limits) -> None:
        """Closes the innermost open element of `tags` and all inside it, unless one of `limits` lies between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i]["tag"] in tags:
                return self._pop(i)
            if self.stack[i]["tag"] in limits:
                return None

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            own = self.stack.pop()["own"]
            if own:
                self.reading.remove(own)
                own["said"] = " ".join("".join(own["said"]).split())
                if own["tag"] in self.header_tags and NAMELESS.sub("", own["said"]).strip():
                    self.stack[-1]["in_force"] = own

    def links(self, html: str, parent_tag: str | None, nested_tag: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._pop(1)
        last = None
        for head in self.headers:
            if head["tag"] == parent_tag and NAMELESS.sub("", head["said"]).strip():
                last = head["said"]
            head["parent"] = last if head["tag"] in (parent_tag, nested_tag) else None
            head["n"] = 0
        rows = []
        for head, link in sorted(self.found, key=lambda pair: pair[0]["sec"]):
            rows.append({"section": head["said"], "parent": head["parent"], "sec": head["sec"], "pos": head["n"],
                         "href": link["href"], "text": link["said"]})
            head["n"] += 1
        return rows


def links_by_sibling_section(pages: DataFrame, header_tags: list[str] = HEADER_TAGS, parent_tag: str | None = None,
                             nested_tag: str = "h5") -> DataFrame:
    """(page_id, sec, section, parent, pos, url, text): links in or below the siblings after each header, up to the next header sibling.

    A header inside such a sibling has its own section, so a link can be in several. Headers are numbered in document
    order by `sec`, a section's links by `pos`. Headers whose text leaves an empty name end the section before and have
    none. With `parent_tag`, `parent` is the last non-empty header of that tag at or before a header of that tag or of
    `nested_tag`. Pages without text give no row; end tags that are left out are put where HTML's rules for paragraphs,
    list items and table cells put them. Map-only.
    """
    @F.pandas_udf(LINKS)
    def folded(htmls: pd.Series) -> pd.Series:
        tags = frozenset(header_tags)
        return htmls.map(lambda h: _Fold(tags).links(h or "", parent_tag, nested_tag))

    rows = pages.select("page_id", F.col("url").alias("page_url"), F.explode(folded("html")).alias("a"))
    name = {c: sanitize_name(F.col(f"a.{c}")).alias(c) for c in ("section", "parent")}
    return rows.select("page_id", "a.sec", name["section"], name["parent"], "a.pos",
                       absolute_url(F.col("a.href"), F.col("page_url")).alias("url"), "a.text")
