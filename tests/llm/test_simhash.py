import random
import sys

import numpy as np
import pytest
import xxhash

from paperloom.llm import simhash
from paperloom.llm.components import components, labels

DOCS = "doc_id bigint, text string, extra string, component_id string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """prints: list of (id, print); the smallest id reachable, by id."""
    values = sorted({p for _, p in prints})
    a, b = zip(*[(i, j) for i in range(len(values)) for j in range(i, len(values))
                 if (values[i] ^ values[j]).bit_count() <= 3])
    label = labels(len(values), np.array(a), np.array(b))
    group = dict(zip(values, label.tolist()))
    least = {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    return [(i, format(p, "016x"), least.get(group[p])) for i, p in prints]


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_groups_match_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 40, 200, 400]))) for _ in range(60)]
    texts = list(base)
    for t in base * 4:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    data = [(i, t, "x", "y") for i, t in enumerate(texts)]
    data += [(900, None, "x", "y"), (901, " \t\n", "x", "y"), (None, texts[7], "x", "y"), (None, "nobody else has this", None, None),
             (7, texts[7], "x", "y"), (902, "É A b Ünï " * 50, "x", "y"), (903, "w1 " * 30000, "x", "y")]
    expected = sorted(brute_groups([(r[0], brute_print(r[1])) for r in data]), key=repr)
    assert rows(simhash.near_groups(spark.createDataFrame(data, DOCS).repartition(7))) == expected
    assert len({c for _, _, c in expected}) < len({p for _, p, _ in expected})


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).collect() == []
    assert simhash.keep_first(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("held", [1 << 16, 100])
def test_large_variants(spark, held):
    """Thousands of prints around a few centres, two clusters that only share a half, chains, random ones."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(700):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    high = rng.getrandbits(32) << 32
    prints |= {high | rng.getrandbits(32) for _ in range(500)}
    at = rng.getrandbits(64)
    for b in range(0, 60, 3):
        at ^= 7 << b
        prints.add(at)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = simhash.fingerprint_links(distinct, 3, held)
    got = {r.node: r.root for r in components(links).collect()}
    a, b = zip(*[(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3])
    label = labels(len(prints), np.array(a), np.array(b))
    mine = {}
    for p, l in zip(signed, label.tolist()):
        mine.setdefault(l, set()).add(p)
    theirs = {}
    for p in signed:
        theirs.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert links.count() < 64 * len(prints)


def test_components_of_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    links = spark.createDataFrame([*chain, *star, *star[:5], (5000, 5000), (-3, -4)], "a bigint, b bigint")
    roots = {}
    for r in components(links).collect():
        roots.setdefault(r.root, []).append(r.node)
    assert sorted(map(sorted, roots.values())) == [[-4, -3], list(range(201)), list(range(1000, 1300))]
    assert components(links.limit(0)).collect() == []


@pytest.mark.parametrize("held", [1 << 18, 7, 1])
def test_components_need_few_jobs_where_a_task_holds_the_links(spark, monkeypatch, held):
    """A chain of 3000 took about ten rounds of three plans each, which filled the driver; blocks of any size give the same sets."""
    rng = random.Random(5)
    names = [rng.randrange(-1 << 62, 1 << 62) for _ in range(3300)]
    chain = list(zip(names[:2999], names[1:3000]))
    cliques = [(names[3000 + 30 * k + i], names[3000 + 30 * k + j]) for k in range(10) for i in range(30) for j in range(i)]
    pairs = [*chain, *cliques, (names[0], names[0])]
    rng.shuffle(pairs)
    written = []
    module = sys.modules[components.__module__]
    monkeypatch.setattr(module, "stored", lambda df, f=module.stored: written.append(1) or f(df))
    roots = {}
    for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), held).collect():
        roots.setdefault(r.root, []).append(r.node)
    assert all(root in nodes for root, nodes in roots.items())
    assert sorted(map(sorted, roots.values())) == sorted([sorted(names[:3000]), *[sorted(names[3000 + 30 * k:3030 + 30 * k]) for k in range(10)]])
    assert held < 1 << 18 or len(written) <= 6


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("held", [1 << 14, 40])
def test_similar_texts(spark, monkeypatch, held):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (0.8, held))
    rng = random.Random(17)
    words = [f"w{i}" for i in range(3000)] + ["the", "of", "and", "to"] * 300
    base = [rng.choices(words, k=rng.randint(60, 400)) for _ in range(150)]
    texts = [" ".join(w) for w in base]
    for w in base + base[:1] * 300:
        w = list(w)
        for k in rng.sample(range(len(w)), max(1, int(len(w) * rng.choice([0.002, 0.01, 0.02, 0.1])))):
            w[k] = f"new{rng.random()}"
        texts.append(" ".join(w))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    rows += [(2000, texts[3], "x", "y"), (2001, None, "x", "y"), (2002, " ", "x", "y"), (None, texts[4], "x", "y"), (5, texts[5], "x", "y"),
             (2003, "a b", "x", "y"), (2004, "a b", "x", "y"), (2005, "a c", "x", "y"), (2006, "the of " * 40000, "x", "y")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(group[i] == group[j] for i, j in pairs) >= 0.92 * len(pairs) > 150
    for i in range(len(texts)):  # nobody is in a group without a text that is near
        if group[i] != i:
            assert any(jaccard(sets[i], sets[j]) > 0.35 for j in range(len(texts)) if j != i and group[j] == group[i])
    assert (group[2000], group[2002], group[2004], group[2005], group[2006]) == (group[3], 2001, 2003, 2005, 2006)
    kept = simhash.keep_first(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    assert sorted(i for i in ids if i is not None) == sorted(set(group.values())) and ids.count(None) == 1


def test_appended_cut_and_block_edited_copies(spark):
    """All pairs at 0.8 or more are found and no document without such a pair is lost, also where no words repeat."""
    rng = random.Random(23)
    texts = []
    for i in range(60):
        w = [f"{i}x{k}" for k in range(200)]
        new = [f"{i}y{k}" for k in range(110)]
        at = rng.randrange(150)
        texts += [w, w + new[:rng.choice([10, 20, 30, 48])], w[:rng.choice([162, 170, 190])], w[:at] + new[:12] + w[at + 12:],
                  new[:60] + w + new[60:], w[:130] + new[:40]]
    texts = [" ".join(w) for w in texts]
    sets = [grams(t) for t in texts]
    a, b = zip(*[(i, j) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8])
    expected = labels(len(texts), np.array(a), np.array(b))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS).repartition(3)
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert [group[i] for i in range(len(texts))] == expected.tolist()
    assert 120 <= len(set(group.values())) < 300


def test_hot_bands_give_the_same_groups_in_blocks(spark, monkeypatch):
    """Hundreds of texts on both sides of 0.8 of each other: what a task may hold does not change a group."""
    rng = random.Random(29)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for i in range(400):
        w = list(base)
        at = rng.randrange(200)
        for k in range(at, at + rng.choice([4, 12, 18, 24, 40])):
            w[k % 200] = f"{i}n{k}"
        texts.append(" ".join(w))
    sets = [grams(t) for t in texts]
    a, b = zip(*[(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    expected = labels(len(texts), np.array(a), np.array(b)).tolist()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS).repartition(3)
    most = []
    dealt = simhash._dealt
    monkeypatch.setattr(simhash, "_dealt", lambda *x: (most.append(max(r["count"] for r in dealt(*x).groupBy("run").count().collect())), dealt(*x))[1])
    for held in (40, 1 << 62):
        monkeypatch.setattr(simhash.similar_links, "__defaults__", (0.8, held))
        group = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
        assert [group[i] for i in range(len(texts))] == expected
    assert 1 < len(set(expected)) < 300 and most[0] < 3 * 40 < most[1]


def test_near_fingerprints_decide_what_is_kept(spark):
    """Texts within 3 bits whose sets of shingles are not similar are copies, also by way of a similar third text."""
    head = "alpha beta gamma " * 100
    tails = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(2)]
    near = [head + t for t in tails]
    assert bin(simhash.fingerprint(near[0]) ^ simhash.fingerprint(near[1])).count("1") <= 3
    alike = " ".join([tails[1], *(f"y{k}" for k in range(40))])
    rows = [(1, near[0]), (2, near[1]), (3, alike), (4, alike + " end"), (None, near[0]), (5, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len({r.component_id for r in simhash.similar_groups(df.filter("doc_id < 3")).collect()}) == 2
    assert sorted((r.doc_id for r in simhash.keep_first(df).collect()), key=str) == [1, 3, 5, None]
