from paperloom.llm import licenses

DOCS = "doc_id bigint, text string, license string, digest int"


def known(spark, rows=licenses.KNOWN):
    return spark.createDataFrame(rows, "license string, text string")


def test_spellings_punctuation_and_copyright_lines(spark):
    mit = licenses.MIT
    docs = [(1, mit), (2, "Copyright (c) 2019 A. Person\n\n" + mit.upper()), (3, "© 2020 Somebody\n" + mit.replace("sublicense", "sub, licence").replace(",", " -- ")),
            (4, mit.replace("sublicense", "SUBLICENCE").replace("\n\n", "\n  * \n")), (5, mit + " and more"), (6, mit[:-40]),
            (7, "Some prose.\n  LICENCED under the Apache License - version 2.0!\nmore\nAll rights reserved"),
            (8, "prose. Licensed under the Apache License, Version 2.0."), (9, None), (10, ""), (11, "© 2021\n(c) me\n ...\n"),
            (12, "The MIT Licence (MIT)\nCopyright 1999\n" + mit), (None, mit), (1, mit), (13, "x " * 100000 + "\nReleased under CC0 1.0."), (14, "É licence")]
    got = licenses.scan(spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3), known(spark))
    assert got.columns == ["doc_id", "digest", "license", "notices"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(docs)
    assert {i for i, r in rows.items() if r.license == "MIT"} == {1, 2, 4, 12, None}
    assert {i: r.notices for i, r in rows.items() if r.notices and i in (7, 8, 13)} == {7: "Apache-2.0,proprietary", 13: "CC0-1.0"}
    assert all(rows[i].digest is None and rows[i].license is None and rows[i].notices is None for i in (9, 10, 11))
    assert rows[1].digest == rows[2].digest == rows[4].digest != rows[5].digest


def test_no_rows_no_licences_and_doubtful_ones(spark):
    docs = spark.createDataFrame([(1, "a b\nc", "x", 1)], DOCS)
    assert licenses.scan(docs.limit(0), known(spark)).collect() == []
    odd = [("L1", "A, b! C"), ("L2", "a b\nc"), ("L1", "A, b! C"), ("L3", None), ("L4", ""), (None, "a b c"), ("L5", "c")]
    assert [(r.license, r.notices) for r in licenses.scan(docs, known(spark, odd)).collect()] == [("L1,L2", "L5")]
    assert [r.license for r in licenses.scan(docs, known(spark).limit(0)).collect()] == [None]
