"""Quality rules and sharding against plain Python."""

import heapq
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from scoreweave.llm import quality, sharding
from tests.llm.conftest import TEXTS


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(inside), failed


def test_quality_counts(docs_of):
    texts = TEXTS + ["# a b | c\n\n x \n x \n" * 9, "a b c d a b c e a b", "\x0b\x0c\r", "\x1cfoo bar x " * 20]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = quality.quality(docs_of(texts)).select("doc_id", *[F.col(f"quality.{n}") for n in names]).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {k: brute_quality(t) for k, t in enumerate(texts)}
    assert quality.quality(docs_of([])).count() == 0


def test_rules_decide(docs_of):
    good = " ".join(f"the word{k} of" for k in range(60))
    texts = [good, " ".join(f"wo$$$rd{k}###" for k in range(90)), good.upper(), None]
    out = quality.quality(docs_of(texts))
    assert [r[0] for r in out.orderBy("doc_id").select("quality.kept").collect()] == [True, False, False, False]
    lenient = quality.quality(docs_of(texts), rules=[quality.Rule("symbol_ratio", high=0.1)])
    assert [r[0] for r in lenient.orderBy("doc_id").select("quality.kept").collect()] == [True, False, True, False]


def heap_schedule(sizes, shards):
    loads = [(0, k) for k in range(shards)]
    out = Counter()
    for size in sorted(sizes, reverse=True):
        load, k = loads[0]
        heapq.heapreplace(loads, (load + size, k))
        out[size, k] += 1
    return out


def test_schedule_by_sizes_is_the_schedule_of_single_groups():
    draw = random.Random(3)
    for _ in range(60):
        shards, sizes = draw.randint(1, 9), [draw.choice([1, 2, 3, 7, 50, draw.randint(1, 400)]) for _ in range(draw.randint(0, 300))]
        plan = sharding.longest_first(Counter(sizes).items(), shards)
        assert Counter({(s, k): n for s, taken in plan for k, n in enumerate(taken) if n}) == heap_schedule(sizes, shards)


def test_shards(docs_of):
    texts = TEXTS + ["copy"] * 40 + [f"text {k} " * (k % 17) for k in range(200)]
    ids = [None, 5, 5, *range(len(texts) - 3)]
    rows = sharding.shard(docs_of(texts, ids), 4).collect()
    assert len(rows) == len(texts)
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    together = {}
    for r in rows:
        assert together.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    loads = Counter()
    for (size, k), n in heap_schedule(groups.values(), 4).items():
        loads[k] += size * n
    assert Counter({k: sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)}) == loads
    assert sharding.shard(docs_of([]), 4).count() == 0
