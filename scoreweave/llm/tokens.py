"""Token ids of texts, inside tasks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: White space as the vocabulary's own rule has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))
#: The rule never joins a word to white space after it, so texts may be cut before each run of white space.
_PIECE = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def pieces(text: str) -> list[str]:
    """Parts of a text that are encoded one by one with the ids of the whole."""
    if " ".join(text.split()) == text.replace("\n", " "):  # single blanks and line ends only: plain splitting does
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[p if p[0] == "\n" else " " + p for p in rest]]
    return _PIECE.findall(text)


def vocabulary_file() -> str:
    """The default vocabulary, byte-level BPE as ranks: the ids of ``byte_bpe_50k.json``, several times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts as little-endian uint32 bytes; special tokens are ordinary text.

    Words recur, so the ids of a piece are kept; the store is emptied when it holds ``keep`` pieces, which bounds
    memory (about 50 MB) and changes no result.
    """

    def __init__(self, vocabulary: str, keep: int = 300_000):
        self._encode = (_ranks if vocabulary.endswith(".tiktoken") else _json)(vocabulary)
        self._known: dict[str, bytes] = {}
        self._keep = keep

    def encode(self, text: str) -> bytes:
        parts, known = pieces(text), self._known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            new = list({p for p in parts if p not in known})
        if len(known) + len(new) > self._keep:
            known.clear()
            new = list(set(parts))
        if len(new) > self._keep:  # one text of very many words: nothing is kept
            return b"".join(self._plain(parts))
        known.update(zip(new, self._plain(new), strict=True))
        return b"".join(map(known.__getitem__, parts))

    def _plain(self, parts: list[str]) -> Iterable[bytes]:
        for k in range(0, len(parts), 10_000):
            yield from self._encode(parts[k : k + 10_000])


def _json(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: (np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))


def _ranks(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for word, rank in ranks.items():
        sizes[rank] = len(word)

    def encode(texts: list[str]) -> list[bytes]:
        # Pieces from white space to a word's end keep apart in one text: one call for all of them, cut by bytes.
        apart = [bool(t) and t[0] in _WHITE and t[-1] not in _WHITE for t in texts]
        joined = [t for t, a in zip(texts, apart, strict=True) if a]
        ids = np.array(encoding.encode_ordinary("".join(joined)), "<u4")
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in joined), np.int64, len(joined)))
        edges = [0, *(4 * np.searchsorted(np.cumsum(sizes[ids]), ends, "right")).tolist()]
        data = ids.tobytes()
        cut = iter([data[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)])
        return [next(cut) if a else np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t, a in zip(texts, apart, strict=True)]

    return encode


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One per Python worker, so that what it knows serves all its tasks."""
    return Encoder(vocabulary)
