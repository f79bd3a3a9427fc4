"""License scans: an exact set-similarity join of license notices with blocks of text.

A notice of ``n`` words is looked for in blocks of ``2 n`` words, every ``n`` words, so each passage of its length lies
whole in a block. It is found where a block holds at least ``threshold`` of its distinct words, all words that tell it
from others, and none that speak against it. Words of notices are ordered by how many documents hold them, rarest
first; a block that reaches the threshold holds a word of the notice's prefix, so only texts with such a word and with
enough of the notice's words are looked at, under positional filters, and the counts of what remains are exact. The
notices are a parameter; their words are the only thing that is sent to tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.llm.common import filled, let, matches, text_key

#: Characters of a word, base phrases and their labels.
_LETTER = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


@dataclass(frozen=True)
class Notice:
    """Usual wording of a license; ``must`` are words that a block needs, ``without`` words that it may not hold."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


_CC, _ONLY = "This work is licensed under a Creative Commons {} 4.0 International License", ("noncommercial", "sharealike", "noderivatives", "noderivs")

#: Notices that the method looks for: titles, and passages that stand in the licenses or in the headers of files.
NOTICES = (
    Notice("mit", "Released under the MIT License", ("mit",)),
    Notice(
        "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", ("sublicense",),
    ),
    Notice("apache", "Licensed under the Apache License, Version 2.0", ("apache",)),
    Notice(
        "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at", ("apache",),
    ),
    Notice("gpl", "This work is licensed under the GNU General Public License", ("gnu", "general"), ("lesser", "affero")),
    Notice(
        "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu", "general"), ("lesser", "affero"),
    ),
    Notice("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu", "lesser")),
    Notice("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu", "affero")),
    Notice("cc-by", "Licensed under CC BY 4.0", ("cc", "by"), ("nc", "sa", "nd")),
    Notice("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc", "by", "nc")),
    Notice("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc", "by", "sa")),
    Notice("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc", "by", "nd")),
    Notice("cc-by", _CC.format("Attribution"), ("attribution", "commons"), _ONLY),
    Notice("cc-by-nc", _CC.format("Attribution-NonCommercial"), ("noncommercial", "commons")),
    Notice("cc-by-sa", _CC.format("Attribution-ShareAlike"), ("sharealike", "commons")),
    Notice("bsd", "Released under the BSD License", ("bsd",)),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "binary")),
    Notice("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla",)),
    Notice("epl", "made available under the terms of the Eclipse Public License", ("eclipse",)),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("fee", "granted")),
    Notice("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered",)),
    Notice(
        "zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software", ("express", "damages", "held"),
    ),
)


def notice_words(text: str) -> list[str]:
    """Words of a text, lower-cased in A to Z."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text: str | Column = "text") -> Column:
    """A struct of n_words, n_base, first_word, last_word and base_labels (an array) of one text."""
    t = filled(text)
    patterns = [(label, rf"(?i)(?<!{_LETTER})" + f"{_OTHER}+".join(p.split()) + rf"(?!{_LETTER})") for label, p in PHRASES]
    count = lambda c: let(_words(c), lambda w: F.size(w) - F.when(F.element_at(w, -1) == "", 1).otherwise(0))
    hit = lambda label, p: F.transform(
        matches(t, p), lambda m: F.struct(m["start"].alias("at"), F.lit(label).alias("label"))
    )
    any_of = t.rlike("|".join(p for _, p in patterns))
    hits = F.when(any_of, F.array_sort(F.concat(*[hit(*p) for p in patterns]))).otherwise(
        F.array().cast("array<struct<at:int,label:string>>")
    )
    word = lambda at: count(t.substr(F.lit(1), at)).cast("long")

    def summary(h: Column) -> Column:
        some = F.size(h) > 0
        return F.struct(
            count(t).cast("long").alias("n_words"), F.size(h).cast("long").alias("n_base"),
            F.when(some, word(F.get(h, F.lit(0))["at"])).alias("first_word"),
            F.when(some, word(F.element_at(h, -1)["at"])).alias("last_word"),
            F.array_sort(F.array_distinct(F.transform(h, lambda x: x["label"]))).alias("base_labels"),
        )

    return let(hits, summary)


def _words(text: Column) -> Column:
    """Words of a text in their order; an empty string may follow the last."""
    parts = F.split(text, _OTHER + "+")
    return let(parts, lambda p: F.when((F.get(p, F.lit(0)) == "") & (F.size(p) > 1), F.slice(p, 2, F.size(p))).otherwise(p))


def notice_blocks(docs: DataFrame, notices: Sequence[Notice] = NOTICES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """(key, block, label, containment) for each block of a text and notice that it holds enough of."""
    spark, sets = docs.sparkSession, [sorted({*notice_words(n.text), *n.must}) for n in notices]
    known = sorted({w for s in sets for w in s} | {w for n in notices for w in n.without})
    array = lambda ws: F.array(*map(F.lit, ws))
    # The known words of a text at their places, null for other words.
    words_of = lambda low: F.transform(_words(low), lambda w: F.when(w.isin(*known), w))
    own_of = lambda ws: F.array_compact(F.array_distinct(ws))
    low = F.lower(filled(text))
    held = docs.select(F.explode(own_of(words_of(low))).alias("w"))
    often = dict(held.groupBy("w").count().collect())  # at most the notices' words
    rank = {w: k for k, w in enumerate(sorted(known, key=lambda w: (often.get(w, 0), w)))}
    table, whole, parts = [], [], []
    for number, (notice, words) in enumerate(zip(notices, sets, strict=True)):
        ordered, need = sorted(words, key=rank.__getitem__), math.ceil(threshold * len(words) - 1e-9)
        prefix = ordered[: len(words) - need + 1]
        table.append((number, notice.label, ordered, prefix, need, len(notice_words(notice.text)), list(notice.must), list(notice.without)))
        whole.append((number, words, prefix, need, notice.must))
        parts.append([[w] for w in notice.must] or [prefix])

    def may_hold(low: Column) -> Column:
        """Some notice's words that must be there stand in the text, as parts of words at least."""
        any_of = lambda ws: reduce(lambda a, b: a | b, [low.contains(w) for w in ws])
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(any_of, groups)) for groups in parts])

    def perhaps(ws: Column, own: Column) -> Column:
        """(notice, ws) of the notices of whose words the text holds one of the prefix, all it must, and enough."""
        tests = []
        for number, words, prefix, need, must in whole:
            enough = F.arrays_overlap(own, array(prefix)) & (F.size(F.array_intersect(own, array(words))) >= need)
            for w in must:
                enough &= F.array_contains(own, w)
            tests.append(F.when(enough, number))
        return F.transform(F.array_compact(F.array(*tests)), lambda n: F.struct(n.alias("notice"), ws.alias("ws")))

    none = F.array().cast("array<struct<notice:int,ws:array<string>>>")
    # One expression: each step is computed once for a text, whatever the optimizer merges.
    hits = let(low, lambda t: F.when(may_hold(t), let(words_of(t), lambda ws: let(own_of(ws), lambda own: perhaps(ws, own)))).otherwise(none))
    fields = "notice int, label string, ordered array<string>, prefix array<string>, need int, span int, must array<string>, without array<string>"
    table = F.broadcast(spark.createDataFrame(table, fields))  # as long as the list of notices
    found = docs.select(text_key(text).alias("key"), F.explode(hits).alias("hit")).select("key", "hit.notice", "hit.ws")
    found = found.dropDuplicates(["key", "notice"]).join(table, "notice")
    placed = F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(F.concat("ordered", "without"), x["word"]))
    each = found.select("key", "notice", "label", "ordered", "prefix", "need", "must", "without", "span", F.explode(placed).alias("w"))
    block = F.floor(F.col("w.at") / F.col("span"))
    each = each.select("*", F.explode(F.array(block, block - 1)).alias("block")).filter("block >= 0")
    blocks = each.groupBy("key", "notice", "block").agg(
        F.collect_set("w.word").alias("held"), *[F.first(c).alias(c) for c in ("label", "ordered", "prefix", "need", "must", "without")]
    )
    holds = F.filter("ordered", lambda w: F.array_contains("held", w))
    # Positional filter: from the first word held in the prefix's order on, enough words must be left.
    first = F.array_position("ordered", F.get(holds, F.lit(0)))
    blocks = blocks.filter(F.arrays_overlap("held", "prefix") & (F.size("ordered") - first + 1 >= F.col("need")))
    fits = F.forall("must", lambda w: F.array_contains("held", w)) & ~F.exists("without", lambda w: F.array_contains("held", w))
    blocks = blocks.filter((F.size(holds) >= F.col("need")) & fits)
    return blocks.select("key", "block", "label", (F.size(holds) / F.size("ordered")).alias("containment"))


def scan_licenses(docs: DataFrame, notices: Sequence[Notice] = NOTICES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """Add ``license``: n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted) and score.

    Words are counted from 0. ``score`` is 1 where a base phrase stands, else the largest containment of a notice
    found, else 0. A null text counts as empty: no words, no labels, null places. Repeated rows get equal results, null
    ids don't matter, an empty table stays empty. Other columns stay as they are, whatever their names; an input column
    named ``license`` is replaced.
    """
    found = notice_blocks(docs, notices, threshold, text)
    found = found.groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "license"]).alias("row")
    rows = docs.select(whole, base(text).alias("base"), text_key(text).alias("key")).join(found, "key", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base.base_labels", F.coalesce("found", none)))
    score = F.when(F.col("base.n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return rows.select("row.*", F.col("base").withField("labels", labels).withField("score", score).alias("license"))
