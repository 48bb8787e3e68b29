import random

import numpy as np
import pytest

from paperloom.llm import mixing, urlfilter

RULES = "host string, path string, verdict string"
PAGES = "page_id bigint, url string, host string, rule int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def judge(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[:3], f[3] == "block"), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "x.y.z.net", "EXAMPLE.Com", "org", "notexample.com", "", "É.com", "a..com"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/es/1", "/fr/", "/e", "/a?b", "?q=/en/", "#/en/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a', '#b', '/c'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "a://b://c/en/", "http://" + "a." * 3000 + "com/" + "x" * 5000, "x\n://com/\n?"] + urls[:40]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block"), ("Z.net", "/", "block"), ("z.net", "/", "allow"), ("org", "", "block"), ("x.y.z.net", "/e", "allow")]
    lowered = [(h.lower(), p, v) for h, p, v in rules]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
           urlfilter.judge_urls(pages, spark.createDataFrame([*rules, rules[0]], RULES)).collect()}
    assert got == {i: judge(u, lowered) for i, u in enumerate(urls)}


def test_empty_pages_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "h", 1)], PAGES)
    none = spark.createDataFrame([], RULES)
    assert [r.verdict for r in urlfilter.judge_urls(pages, none).collect()] == ["allow"]
    assert urlfilter.judge_urls(pages.limit(0), spark.createDataFrame([("com", "/", "block")], RULES)).collect() == []
    nulls = spark.createDataFrame([(None, None, None), ("com", None, "block")], RULES)
    assert [r.verdict for r in urlfilter.judge_urls(pages, nulls).collect()] == ["block"]


def test_cascade_is_exact_over_many_levels(spark):
    keys = spark.range(20000).selectExpr("xxhash64(id, 1) as h1", "xxhash64(id, 2) as h2", "id % 7 = 0 as listed")
    cascade = urlfilter.build_cascade(keys, fpr=0.5, first_fpr=0.4)
    rows = keys.toPandas()
    assert len(cascade.levels) > 4
    assert (cascade.has(rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all()
    with pytest.raises(ValueError):
        urlfilter.build_cascade(keys, max_bytes=64)


def seats_by_quotient(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats if any(votes.values()) else 0):
        best = min(votes, key=lambda u: (-votes[u] / (2 * got[u] + 1), u))
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportion_matches_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: ({u: rng.choice([0, 1, 5, 5, rng.randint(1, 10 ** rng.randint(1, 6))]) for u in range(rng.randint(1, 60))}, rng.randint(0, 300))
              for g in range(6)}
    groups[9] = ({0: 0, 1: 0}, 5)
    rows = [(g, u, float(v), s) for g, (votes, s) in groups.items() for u, v in votes.items()]
    units = spark.createDataFrame(rows, "g int, u int, v double, s bigint")
    got = {(r.g, r.u): r.q for r in mixing.apportion(units, "g", ["u"], "v", "s", "q").collect()}
    assert got == {(g, u): n for g, (votes, s) in groups.items() for u, n in seats_by_quotient(votes, s).items()}


DOCS = "doc_id bigint, text string, source string, size string"


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    docs = [(i, "w " * rng.randint(0, 300), rng.choice(["a", "a", "a", "b", "c", None, "É", ""]), "x") for i in range(3000)]
    docs += [(None, "x y z", "a", "x"), (5000, None, "b", "x"), (5001, "", "only empty", "x"), (5002, "w " * 30000, "c", "x"), docs[3], docs[3]]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    out = mixing.mix(df, shard_rows=64)
    rows = sorted(map(tuple, out.collect()), key=repr)
    assert rows == sorted(map(tuple, mixing.mix(df.repartition(3), shard_rows=64).collect()), key=repr)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(rows) == len(docs)
    sizes = {}
    for _, text, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2 * sizes[s] for s in full}
        open_ -= full
    target |= {s: rate * weight[s] for s in open_}
    taken = {}
    for i, size, source_size, goal, took in rows:
        assert 0 <= took <= 2 * size
        taken.setdefault(goal, []).append(took)
    for s in order:
        same = [x for x in order if target[x] == target[s]]
        got = next(v for k, v in taken.items() if np.isclose(k, target[s]))
        assert abs(sum(got) - len(same) * target[s]) <= 0.02 * len(same) * target[s] + 16


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, "x"), (2, "", "a", "x")], DOCS)
    assert sorted(map(tuple, mixing.mix(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
