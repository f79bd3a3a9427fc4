"""Token ids, packing and token counts against plain encoding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreweave.llm import packing, token_counts
from scoreweave.llm.tokens import Encoder, vocabulary_file
from tests.llm.conftest import TEXTS

ODD = TEXTS + [
    "  a\n\n b  \t c  ", "it's <|endoftext|> don't 'll", "x.\x1cy_-a b.　q, 's", "a\n", "\na", " a", "a b\nc\x1d", "naïve café ²³", " x\u0085y",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pieces_give_the_ids_of_the_whole(plain):
    draw = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(draw.choices("ab. \n\t,'1é_-　\x1c", k=draw.randint(0, 40))) for _ in range(500)]
    for name in (vocabulary_file(), public_tokenizers.path("byte_bpe_50k.json")):
        encode, small = Encoder(name), Encoder(name, keep=3)
        assert all(ids(encode.encode(t)) == plain(t) for t in texts)
        assert all(ids(small.encode(t)) == plain(t) for t in texts)


def test_windows_hold_everything_within_the_capacity():
    draw = random.Random(1)
    for _ in range(40):
        sizes = [draw.randint(1, 100) for _ in range(draw.randint(0, 60))]
        parts = packing.windows_of(sizes, 100)
        assert sorted(k for p in parts for k in p) == list(range(len(sizes)))
        assert all(0 < sum(sizes[k] for k in p) <= 100 for p in parts)
    assert sorted(w for w, _ in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_packing(docs_of, plain):
    texts = ODD + ["word " * 700, "many different words here " * 900]
    names = [None, 1, 1, *range(10, 10 + len(texts) - 3)]
    rows = packing.pack(docs_of(texts, names), capacity=64, grain=16, block=5, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for name, text in zip(names, texts, strict=True):
        if name not in (None, 1):
            found = sorted(pieces[name])
            assert [i for _, p, _ in found for i in p] == plain(text) + [0] and {n for *_, n in found} == {len(plain(text)) + 1}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs_of([])).count() == 0


def test_token_counts(docs_of, plain, tmp_path, library):
    texts = ODD + ["word " * 700]
    token_counts.write_stream(docs_of(texts).coalesce(2), str(tmp_path / "s"), block=32)
    blocks = library.read.parquet(str(tmp_path / "s"))
    counts = token_counts.count_tokens(blocks).join(blocks.select("file", "block_no", "doc_ids"), ["file", "block_no"])
    rows = counts.withColumn("doc_id", F.get("doc_ids", F.col("place"))).collect()
    assert {int(r["doc_id"]): r["n_tokens"] for r in rows} == {k: len(plain(t)) for k, t in enumerate(texts)}
    for file in {r["file"] for r in rows}:
        own = sorted((r["doc_no"], r["start"], r["n_tokens"]) for r in rows if r["file"] == file)
        assert [r[0] for r in own] == list(range(len(own)))
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(own, own[1:], strict=False))


def test_raw_files_and_open_ends(library, tmp_path):
    draw, want = random.Random(2), []
    for k, closed in enumerate((True, False, True)):
        sizes = [draw.choice([0, 1, 5, 200]) for _ in range(50)]
        flat = [i for n in sizes for i in [*[7] * n, 9]]
        flat = flat if closed else flat + [7] * 3
        (tmp_path / f"{k}.bin").write_bytes(np.array(flat, "<u2").tobytes())
        want.append([(n, True) for n in sizes] + ([] if closed else [(3, False)]))
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_counts.read_flat_files(library, str(tmp_path), block=16)
    rows = token_counts.count_tokens(blocks, end_id=9).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["file"], r["doc_no"])):
        got[r["file"]].append((r["n_tokens"], r["ended"]))
    assert sorted(got.values()) == sorted(want)
