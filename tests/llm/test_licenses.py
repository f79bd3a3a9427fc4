"""License scans against plain word lists."""

from pyspark.sql import functions as F

from scoreweave.llm import licenses
from tests.llm.conftest import TEXTS

CASES = TEXTS + [
    "MIT\n-- License. mit license mitlicense, smit license", "😀 The Apache—License apache license general public license",
    "gnu General   PUBLIC license", "word " * 100 + "Licensed under CC BY-NC 4.0." + " word" * 100,
    "this work is licensed under a creative commons attribution 4.0 international", "license license the of and under",
    "word\n" * 70 + "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files\n"
    "to deal in the Software without restriction, including\nthe rights to use, copy, modify, merge, publish, distribute, sublicense, and sell\n"
    "copies of the Software, and to permit persons to whom it is furnished to do so\n" + "more\n" * 90,
]

LABELS = {
    "Licensed under CC BY 4.0": ["cc-by"], "CC BY-SA 4.0, licensed under": ["cc-by-sa"], "Licensed under CC BY-NC 4.0": ["cc-by-nc"],
    "Released under the BSD License": ["bsd"], "the terms of the Eclipse Public License form the source code subject to this is": [],
    "The program is made available under the terms of the Eclipse Public License.": ["epl"],
    CASES[-1]: ["mit"], "This is free and unencumbered software released into the public domain.": ["unlicense"],
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": ["gpl", "lgpl"],
    "This program is free software; you may redistribute it under the terms": [],
}


def brute(text):
    words, hits = licenses.notice_words(text or ""), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        hits += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    found = {}
    for notice in licenses.NOTICES:
        span, n = len(licenses.notice_words(notice.text)), {*licenses.notice_words(notice.text), *notice.must}
        for block in range(len(words) // span + 1):
            held = set(words[block * span : (block + 2) * span])
            if len(held & n) >= 0.8 * len(n) - 1e-9 and held.issuperset(notice.must) and not held & set(notice.without):
                found[notice.label] = max(found.get(notice.label, 0), len(held & n) / len(n))
    places = [k for k, _ in hits]
    base = sorted({x for _, x in hits})
    score = 1.0 if hits else max(found.values(), default=0.0)
    return len(words), len(hits), min(places, default=None), max(places, default=None), base, sorted({*base, *found}), score


def test_against_word_lists(docs_of):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = licenses.scan_licenses(docs_of(CASES)).select("doc_id", *[F.col(f"license.{n}") for n in names]).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {k: brute(t) for k, t in enumerate(CASES)}
    assert licenses.scan_licenses(docs_of([])).count() == 0


def test_notices_are_told_apart(docs_of):
    # The base phrase "general public license" gives gpl beside lgpl.
    rows = licenses.scan_licenses(docs_of(list(LABELS))).select("text", "license.labels").collect()
    assert {r["text"]: r["labels"] for r in rows} == LABELS


def test_columns_keep_their_values(docs_of):
    names = ["key", "label", "found", "_labels", "_text_key", "base", "row", "a.b", "text"]
    df = docs_of(["Released under the MIT License", None]).select(*[(F.col("text") if n == "text" else F.lit(n)).alias(n) for n in names])
    out = licenses.scan_licenses(df)
    assert out.columns == [*names, "license"] and all(r[n] == n for r in out.collect() for n in names[:-1])
