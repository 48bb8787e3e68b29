"""Sibling sections against a walk over trees that are known before they are written out."""

import random
import re

from paperloom.operators.sections import links_by_sibling_section

HEADERS = ("h4", "h5", "strong")
SCHEMA = "page_id bigint, url string, html string"


def tree(draw, depth=0):
    """A list of nodes (tag, children or text); links carry a running number."""
    nodes = []
    for _ in range(draw.randrange(1, 6)):
        kind = draw.choice(["a", "a", "div", "ul", "span", *HEADERS, "br"])
        if kind in HEADERS:
            nodes.append((kind, draw.choice(["One", "Two &amp; more", " ", "!!", "Three  x"])))
        elif kind in ("a", "br"):
            nodes.append((kind, f"L{draw.randrange(10 ** 9)}"))
        elif kind == "ul":
            nodes.append(("ul", [("li", tree(draw, depth + 1) if depth < 3 else [("a", f"L{draw.randrange(10 ** 9)}")]) for _ in range(2)]))
        elif depth < 4:
            nodes.append((kind, tree(draw, depth + 1)))
    return nodes


def written(nodes, draw):
    out = []
    for tag, inner in nodes:
        if tag == "a":
            out.append(f'<a class="x" href="/{inner}.pdf">{inner}</a>')
        elif tag == "br":
            out.append(draw.choice(["<br>", "<br/>", "<!-- <h4>no</h4> -->", "text &lt;a&gt; ", "<script>'<h4>'</script>"]))
        elif isinstance(inner, str):
            out.append(f"<{tag.upper() if draw.random() < .3 else tag}>{inner}</{tag}>")
        else:
            end = "" if tag == "li" and draw.random() < .5 else f"</{tag}>"
            out.append(f"<{tag}>{written(inner, draw)}{end}")
    return "".join(out)


def all_links(nodes):
    return [x for tag, inner in nodes for x in ([inner] if tag == "a" else all_links(inner) if isinstance(inner, list) else [])]


def name(text):
    return re.sub(r"[^a-zA-Z0-9\- .]", "", " ".join(text.replace("&amp;", "&").split())).strip().replace(" ", "-")


def expected(nodes):
    """(section, parent, sec, pos, link) by walking the siblings after each header."""
    rows, seen, parent = [], 0, None

    def visit(level):
        nonlocal seen, parent
        for i, (tag, inner) in enumerate(level):
            if tag in HEADERS:
                section, sec = name(inner), seen
                seen += 1
                if not section:
                    continue
                parent = section if tag == "h4" else parent
                below = []
                for other in level[i + 1:]:
                    if other[0] in HEADERS:
                        break
                    below += all_links([other])
                rows.extend((section, parent if tag in ("h4", "h5") else None, sec, pos, x) for pos, x in enumerate(below))
            elif isinstance(inner, list):
                visit(inner)

    visit(nodes)
    return rows


def test_random_trees(spark):
    draw = random.Random(3)
    trees = [tree(draw) for _ in range(300)]
    pages = spark.createDataFrame([(i, "https://h.org/d/", written(t, draw)) for i, t in enumerate(trees)], SCHEMA)
    got = sorted((r.page_id, r.sec, r.pos, r.section, r.parent or "", r.text, r.url)
                 for r in links_by_sibling_section(pages, parent_tag="h4").collect())
    want = sorted((i, sec, pos, section, parent or "", x, f"https://h.org/{x}.pdf")
                  for i, t in enumerate(trees) for section, parent, sec, pos, x in expected(t))
    assert len(want) > 500 and got == want


def test_odd_pages(spark):
    pages = spark.createDataFrame([
        (1, "https://h.org/", None), (2, "https://h.org/", ""), (3, None, "<h4>A</h4><a href=x.pdf>"), (4, "https://h.org/", "<h4>open <a href='/in'>t"),
        (5, "https://h.org/", "<h4>A</h4><p>one<div><a href=/a>a</a></div></h4></section><h5></h5><a href=/lost>l</a>"),
        (6, "https://h.org/", "<p><h4>A</h4><table><tr><td><h5>B</h5><a href=/b>b</a><td><a href=/c>c</a></table>"),
        (7, "https://h.org/", "<body><h4>A</h4></body></html><a href=/tail>t</a>")], SCHEMA)
    rows = [(r.page_id, r.section, r.url) for r in links_by_sibling_section(pages).collect()]
    assert sorted(rows, key=str) == [(3, "A", None), (5, "A", "https://h.org/a"), (6, "A", "https://h.org/b"), (6, "A", "https://h.org/c"),
                                     (6, "B", "https://h.org/b"), (7, "A", "https://h.org/tail")]


def test_plan_moves_nothing(spark):
    pages = spark.createDataFrame([(1, "https://h.org/", "")], SCHEMA)
    plan = links_by_sibling_section(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
