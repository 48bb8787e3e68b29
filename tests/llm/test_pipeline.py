import os
import sys

import corpus_pipeline
from paperloom.llm import decontaminate, mixing, simhash, toxicity
from paperloom.llm.common import read

sys.path.insert(0, os.path.dirname(__file__))
from test_simhash import grams, jaccard  # noqa: E402
from test_suffixdedup import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_and_run_match_brute_force(spark):
    docs = read(spark, SF, "documents")
    labels, items = read(spark, SF, "labels"), {r.item_id: r.text for r in read(spark, SF, "benchmark").collect()}
    toxic = {r.doc_id for r in toxicity.score_texts(docs, docs, labels).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id not in toxic}
    sets = {i: grams(r.text) for i, r in rows.items()}
    near = [(i, j) for i in rows for j in rows if j < i and jaccard(sets[i], sets[j]) >= 0.8]
    firsts = {r.doc_id for r in simhash.keep_first(docs.filter(~docs["doc_id"].isin(list(toxic)))).collect()}
    assert sum(i in firsts and j in firsts for i, j in near) <= 0.1 * len(near) and near
    for i in rows.keys() - firsts:
        assert any(jaccard(sets[i], sets[j]) > 0.35 for j in rows if j < i)
    texts = {r[0]: r[4].decode(errors="ignore") for r in brute([(i, rows[i].text) for i in sorted(firsts)])}
    codes = decontaminate._Codes()
    words = lambda t: decontaminate.coded(decontaminate.WORDS.findall(t.lower()), codes)
    coded = {i: words(t) for i, t in items.items()}
    clean = {i: t for i, t in texts.items() if all(decontaminate.align(c, words(t))[0] < 0.5 for c in coded.values())}

    made = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = corpus_pipeline.stored(stage(spark, made, SF))
        assert made.columns == docs.columns, name
    assert {r.doc_id: r.text for r in made.collect()} == clean
    assert 0 < len(clean) < docs.count()
    mixed = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert mixed == sorted(map(tuple, mixing.mix(made).collect()))
    assert [r[1] for r in mixed] == [len(clean[r[0]].encode().split()) for r in mixed]


def test_five_stages():
    assert [f.__doc__.split(":")[0] for _, f in corpus_pipeline.STAGES] == [f"Operator {n}" for n in (9, 1, 6, 5, 8)]
    assert corpus_pipeline.ORACLE_SQL is None
