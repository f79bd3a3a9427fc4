"""Jaccard join, byte dedup, decontamination and the pipeline against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest

import corpus_pipeline
from scoreweave.llm import decontamination, jaccard, suffixes
from scoreweave.llm.components import components
from tests.llm.conftest import TEXTS


def near_copies(draw, words=120, groups=6, size=9):
    out = []
    for g in range(groups):
        text = [f"w{draw.randint(0, 60)}" for _ in range(words)]
        for k in range(size):
            copy = list(text)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(words)] = f"x{g}_{k}_{draw.randint(0, 99)}"
            out.append(" ".join(copy))
    return out


def brute_components(texts, ids, width=4, percent=85):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = {}
    for k in range(len(texts)):
        least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    return {ids[k]: (len(sets[k]), least[root(k)]) for k in range(len(texts))}


@pytest.mark.parametrize("extra", [1, 8])
def test_near_duplicates(docs_of, extra):
    texts = TEXTS + near_copies(random.Random(4))
    ids = list(range(100, 100 + len(texts)))
    random.Random(9).shuffle(ids)
    rows = jaccard.near_duplicates(docs_of(texts, ids).repartition(3), extra=extra, cell_bits=3).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == brute_components(texts, ids)


def test_near_duplicates_of_nulls_and_nothing(docs_of):
    assert jaccard.near_duplicates(docs_of([])).count() == 0
    rows = jaccard.near_duplicates(docs_of(["a b c d e", "a b c d e", None], [None, 3, None])).collect()
    assert sorted((r[0] or -1, r[1], r[2] or -1) for r in rows) == [(-1, 0, -1), (-1, 2, 3), (3, 2, 3)]


def test_components(library):
    draw = random.Random(8)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7)]
    up = {n: n for pair in links for n in pair}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {n: root(n) for pair in links for n in pair if pair[0] != pair[1]}
    assert {r[0]: r[1] for r in components(library.createDataFrame(links, "u long, v long")).collect()} == want


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if times[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,h,chunk", [(20, 5, 1 << 20), (20, 10, 64), (200, 50, 1 << 20)])
def test_repeated_bytes(docs_of, monkeypatch, length, h, chunk):
    draw = random.Random(length + h)
    shared = ["".join(draw.choices("abé ", k=draw.randint(length // 2, 3 * length))) for _ in range(6)]
    texts = TEXTS + ["".join(draw.choice([draw.choice(shared), "".join(draw.choices("abcdé", k=draw.randint(1, length)))]) for _ in range(6)) for _ in range(40)]
    texts += ["ab" * length, "z" * (2 * length)]
    out = suffixes.remove_repeats(docs_of(texts).repartition(3), length=length, h=h, cell_bits=3)
    want = dict(enumerate(brute_repeats(texts, length)))
    assert {r["doc_id"]: tuple(r)[1:5] for r in out.collect()} == want


def test_passes_of_long_texts_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "_CHUNK", 64)
    data = bytes(random.Random(1).choices(b"ab", k=500))
    windows = [p for a, b, _, _ in suffixes._runs(data, 20, 5) for p in range(a, b + 1)]
    assert windows == list(range(481))


def test_runs_go_on_across_passes(monkeypatch):
    data = bytes(random.Random(1).choices(b"ab", k=500))
    whole = list(suffixes._runs(data, 20, 5))
    monkeypatch.setattr(suffixes, "_CHUNK", 1 << 6)
    places = [p for _, _, p, _ in suffixes._runs(data, 20, 5)]
    assert len(places) == len(set(places)) and len(whole) > 1


def test_a_repeated_sample_between_two_passes_removes_nothing(docs_of):
    draw = random.Random(5)
    letters = bytes(range(97, 123))
    edge = suffixes._CHUNK - 200
    middle, first, place = b"", 500, 500
    while first == 500 or (500 - place) % 16 == 0:  # the sample's run must go over the edge, and so must a block
        middle = bytes(draw.choices(letters, k=1000))
        first, _, place, name = next(r for r in suffixes._runs(middle, 200, 50) if r[0] <= 500 <= r[1])
    body, place = bytes(draw.choices(letters, k=edge - 500)) + middle + bytes(draw.choices(letters, k=2000)), place + edge - 500
    other = b""
    while name not in {r[3] for r in suffixes._runs(other, 200, 50)}:
        other = bytes(draw.choices(letters, k=300)) + body[place : place + 50] + bytes(draw.choices(letters, k=300))
    twice = body[700_000:700_300]
    texts = [(body + twice).decode(), other.decode()]
    out = suffixes.remove_repeats(docs_of(texts), cell_bits=3).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in out} == dict(enumerate(brute_repeats(texts, 200)))


def test_no_repeats_in_nothing(docs_of):
    assert suffixes.remove_repeats(docs_of([])).count() == 0


def test_leaks(docs_of, library, monkeypatch):
    monkeypatch.setattr(decontamination, "_CHUNK", 500)
    draw = random.Random(6)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghi", k=draw.randint(2, 8))) for _ in range(n))
    items = [prose(40) for _ in range(8)] + ["", None, "tiny item xyz"]
    edited = list(items[1])
    for k in range(5, len(edited), 45):
        edited[k] = "Z"
    texts = [prose(300) + items[0] + prose(300), prose(50) + "".join(edited) + prose(9), prose(400), items[2][:110], None, "", "a tiny item xyz b", items[3], items[3]]
    items_of = library.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.leaks(docs_of(texts), items_of, block=700).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 0), (1, 1), (3, 2), (6, 10), (7, 3), (8, 3)}
    kept = decontamination.without_leaks(docs_of(texts), items_of, block=700)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [2, 4, 5] and kept.columns == docs_of([]).columns
    none = items_of.filter("false")
    assert decontamination.leaks(docs_of(texts), none).count() == 0 and decontamination.without_leaks(docs_of(texts), none).count() == 9


def test_every_unchanged_passage_of_the_length_is_found():
    draw = random.Random(8)
    prose = lambda n: "".join(draw.choices("abcdefghij     ", k=n))
    item = prose(400)
    index = decontamination.Index([(0, item)], 12, 64, 0.05)
    for size, found in ((64, True), (65, True), (72, True), (80, True), (96, True), (40, False)):
        for start in range(0, len(item) - size, 3):
            text = prose(150) + "|" + item[start : start + size] + "|" + prose(150)
            assert bool(index.scan(text)) == found, (size, start)


def test_any_ids_capitals_and_items_without_an_id(docs_of, library):
    draw = random.Random(9)
    items = ["".join(draw.choices("abcdefghi jkl", k=120)) for _ in range(4)]
    rows = [("x-1", items[0], 1), (None, items[1], 1), ("x-3", items[2], 1), ("x-4", "Whole Short Item of Forty Characters Here", 1)]
    known = library.createDataFrame(rows, "item_id string, text string, doc_id int")
    texts = ["so " + items[0].upper() + " on", "so " + items[1] + " on", "so " + items[3] + " on", "the whole short item of forty characters here", None]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs_of(texts), known).collect()}
    assert got == {(0, "x-1"), (1, None), (3, "x-4")}
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs_of(texts), known).collect()) == [2, 4]


def test_alignment():
    def full(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
        return min(row)

    draw = random.Random(2)
    for _ in range(300):
        a, b = ("".join(draw.choices("abc", k=draw.randint(3, 12))) for _ in range(2))
        got, want = decontamination.edits(a, b, 3), full(a, b)
        assert got is None if want > 3 else got[0] == want


def test_one_row_of_each_class_stays(docs_of):
    base = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    texts = [base, base, base + " x", other, "alone here", base + " y", None, "", other, "same id", "not the same"]
    ids = [5, 5, 3, None, 4, None, 6, None, None, 9, 9]
    out = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs_of(texts, ids)).collect()), key=str)
    want = [(3, base + " x"), (None, other), (4, "alone here"), (6, None), (None, ""), (9, "same id"), (9, "not the same")]
    assert out == sorted(want, key=str)


def test_stages_keep_columns_of_any_name(library, tmp_path):
    names = ["quality", "secrets", "pii", "license", "linked", "more", "_text_key", "_labels", "row", "name", "key", "words"]
    prose = " ".join(f"{'the of and to'.split()[k % 4]} word{k}" for k in range(60))
    texts = [(1, prose + " user: bob password = hunter2222"), (1, prose.replace("word", "item")), (None, prose.replace("word", "thing")), (2, prose.replace("word", "thing"))]
    docs = library.createDataFrame([(i, t, *names) for i, t in texts], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    library.createDataFrame([(0, "nothing of this kind is in here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(library, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *names]
        assert all(r[n] == n for r in docs.collect() for n in names)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 1, 2]


def test_pipeline(library, tmp_path):
    draw = random.Random(11)
    prose = lambda n: " ".join(draw.choice(["the", "of", "and"]) if k % 4 == 0 else f"word{draw.randint(0, 5000)}" for k in range(n))
    item, base = prose(40), prose(200)
    texts = [prose(150), base, base + " more", "### $$$ " * 80, prose(80) + item + prose(80), prose(90) + ' token = "abcdefgh1234" ' + prose(90), "short", None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    library.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    library.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(library, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {0, 1, 5}
    docs = library.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(library, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    clean = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(clean) == {0, 1, 5} and "abcdefgh1234" not in clean[5] and "<SECRET>" in clean[5] and clean[0] == texts[0]
    assert library.read.parquet(str(tmp_path / "documents.parquet")).filter("false").transform(lambda d: corpus_pipeline.quality_rules(library, d, str(tmp_path))).count() == 0


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_batch_of_texts_is_not_python_strings_all_at_once(monkeypatch):
    monkeypatch.setattr(jaccard.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    word = random.Random(5).randrange
    texts = [" ".join(str(word(10**9)) for _ in range(200)) for _ in range(4000)]
    texts[7], texts[9] = None, texts[8]
    ids, keys = pa.array(range(len(texts)), pa.int64()), pa.array([b"k"] * len(texts))
    size, column = sum(len(t or "") for t in texts), pa.array(texts)
    del texts
    batch = pa.RecordBatch.from_arrays([ids, column, keys], names=["doc_id", "text", "key"])
    rows = []
    assert _peak(lambda: rows.extend(b.num_rows for b in jaccard._summaries(iter([batch]), 5, 80, 8, 10, "long"))) < 1.6 * size
    assert rows[0] == 4000
    small = pa.RecordBatch.from_arrays([ids, column], names=["cid", "text"])
    assert _peak(lambda: [b.num_rows for b in jaccard._sets(iter([small]), 5)]) < 0.8 * size
