import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scoreweave.llm import alignment
from scoreweave.llm.tokens import vocabulary_file

FORMS = [
    "plain words here", "line\nends\n\nand  blanks ", " starts with a blank", "   ", " ", "\n", "\n\tx", "tab\there\r\nand\rthat);\r\n", "é😀 ﬁ 中文字 　x\xa0y",
    "<s> </s> <unk> <0x41> <|endoftext|>", "under▁score", "▁", "a\x00b \x1cc", "x" * 700, "1234567890 12,5 -- ==>", "Å ñ   z", "word " * 400, None, "",
]


@pytest.fixture(scope="module")
def plain():
    """Token bytes and ids by the libraries, whole texts."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    tool = alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def b_bytes(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        one = [(i, tool.bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, b_bytes(i)) for i in b.encode(text)]
        raw = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == raw == b"".join(x for _, x in two) else ([], [])

    return tokens


def _brute(texts, tokens):
    found = []
    for text in texts:
        spans = []
        for side in tokens(text):
            at, rows = 0, []
            for i, raw in side:
                rows.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(rows)
        a, b = spans
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, last = [], 0
        for cut in cuts:
            pick = lambda rows: ",".join(str(i) for s, e, i in rows if last <= s and e <= cut)  # noqa: B023, E731
            groups.append(pick(a) + "|" + pick(b))
            last = cut
        links = [(i, j) for s, e, i in a for t, u, j in b if s < u and t < e]
        found.append((len(a), len(b), groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(n, top.get(i, 0))
    for n_a, n_b, groups, links in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), sha


def _got(df, **options):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return [(r["doc_id"], *[r[n] for n in names]) for r in alignment.align(df, **options).collect()]


def _texts(count):
    draw, syllables = random.Random(5), ["an", "ter", "é", "qu", "ß", "ing", "Lo", "😀", "9", "-", "the", "　", "\n", "  "]
    return ["".join(draw.choice(syllables) + draw.choice(["", "", " "]) for _ in range(draw.randrange(1, 60))) for _ in range(count)]


@pytest.mark.parametrize("options", [{}, {"block_chars": 40}])
def test_documents_match_brute_force(docs_of, plain, options):
    texts = FORMS + _texts(60) + FORMS[:3]
    ids = [*range(len(texts) - 2), None, None]
    got = _got(docs_of(texts, ids).repartition(3), **options)
    want = [(i, *row) for i, row in zip(ids, _brute(texts, plain), strict=True)]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_store_that_overflows_changes_nothing(docs_of, plain, monkeypatch):
    texts = _texts(40)
    tool = alignment.Aligner(vocabulary_file(), alignment.piece_model_file(), keep=30)
    for text in texts:
        if not tool.room():
            tool.forget()
        parts = tool.pieces(text)
        tool.learn(parts)
        block = alignment._Block(tool.known)
        block.add(0, [tool.known.number[p] for p in parts])
        assert tuple(block.rows[0][1:]) == tuple(np.array(list(_brute([text], plain))[0], object)[[0, 1, 2, 3, 6]])


def test_both_forms_of_the_byte_vocabulary_agree(docs_of):
    df = docs_of(FORMS)
    assert sorted(_got(df)) == sorted(_got(df, a_file=public_tokenizers.path("byte_bpe_50k.json")))


def test_empty_table_and_string_ids(docs_of, library):
    assert _got(docs_of(["a"]).limit(0)) == []
    df = library.createDataFrame([("x", "two words", 1)], "doc_id string, text string, pairs int")
    assert _got(df)[0][:3] == ("x", 2, 2)


def test_coalescing_links_overlaps_within_groups():
    group, a, b = alignment.coalesce(np.array([2, 5, 6, 9]), np.array([1, 5, 7, 8, 9]))
    assert list(zip(group.tolist(), a.tolist(), b.tolist(), strict=True)) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 2, 2), (1, 3, 2), (1, 3, 3), (1, 3, 4)]
