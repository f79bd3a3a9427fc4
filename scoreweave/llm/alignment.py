"""Alignment of two tokenizers: which tokens of A and of B cover the same bytes, and how often ids meet corpus-wide.

Both tokenizers cut a text before white space that follows something else, so a text is a row of pieces that are
tokenized apart, and pieces recur. A task aligns each new piece once, many at a time, by interval coalescing: all A
and B tokens are sorted by their start, a running maximum of their ends is kept, a group breaks where a start reaches
it, and within groups each stretch between neighbouring starts is one overlap of an A and a B token. Documents are
then sums over their pieces.

How many documents hold a linked pair of ids needs the whole corpus: tasks cut the documents into blocks, write what
they found by block, and count pairs of a block before anything is shuffled. The counts go back to the blocks that
hold the pairs by a join; texts are read and tokenized once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreweave.llm.tokens import vocabulary_file
from scoreweave.session import cut_lineage

#: White space as the rule of tokenizer A has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))
#: The character that stands for a space in the pieces of tokenizer B.
_MARK = "\u2581"
#: Documents whose new pieces are aligned together.
_SLICE = 128
#: Bits of an id in a pair of ids.
_BITS = 32
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def piece_model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """Tokenizer A: byte-level BPE, given as ranks or as a tokenizer file; special tokens are ordinary text."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import tiktoken
            from public_tokenizers import PATTERN

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.bytes = {i: b for b, i in ranks.items()}
            encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [encoding.encode_ordinary(t) for t in texts]
            self.whole = encoding.encode_ordinary
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in tokenizer.get_vocab().items() if all(c in byte_of for c in t)}
        self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class PieceModel:
    """Tokenizer B: a sentence-piece model that puts a space before a text and marks spaces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, names = {}, [model.id_to_piece(i) for i in range(model.get_piece_size())]
        for i, name in enumerate(names):
            self.bytes[i] = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(_MARK, " ").encode()
        self._space = model.piece_to_id(_MARK)
        self._encode = lambda texts: model.encode(texts, num_threads=1)
        # A text may be cut before white space that no piece holds behind another character.
        inner = {c for name in names for k, c in enumerate(name) if k and name[k - 1] != c}
        self.cuts = "".join(sorted(c for c in _SPACES if (_MARK if c == " " else c) not in inner))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces of a text, the first of which begins with the space that the model would put there itself."""
        fed = self._encode([t[1:] if t[0] == " " else t for t in texts])
        # A lone space is no text to the model; before other white space it puts a space that isn't there.
        return [(ids or [self._space]) if t[0] == " " else ids[1:] for t, ids in zip(texts, fed, strict=True)]


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two rows of tokens that cover the same bytes, gapless from 0, by their ends.

    Returns the group of each link, and the link's A and B token; links in order of their bytes.
    """
    starts = np.concatenate([[0], a_ends[:-1], [0], b_ends[:-1]])
    ends = np.concatenate([a_ends, b_ends])
    kind = np.repeat([0, 1], [len(a_ends), len(b_ends)])
    order = np.lexsort((kind, starts))
    starts, ends, kind = starts[order], ends[order], kind[order]
    reach = np.maximum.accumulate(ends)
    breaks = np.concatenate([[True], starts[1:] >= reach[:-1]])
    group = np.cumsum(breaks) - 1
    # After the last token with a given start, the tokens of A and B seen last overlap until the next start.
    last = np.concatenate([starts[1:] != starts[:-1], [True]])
    seen = np.cumsum(kind)
    a, b = np.arange(len(kind)) - seen, seen - 1
    return group[last], a[last], b[last]


@dataclass
class _Known:
    """What is known of pieces, by number."""

    number: dict[str, int]
    text: list[str]  # groups as decimal ids
    figures: list[np.ndarray]  # chunks of rows n_a, n_b, n_groups, n_links, fits
    pairs: list[np.ndarray]  # chunks of links as pairs of ids


class Aligner:
    """Groups and links of texts. What is known of pieces is kept until ``keep`` of them are, which bounds memory and
    changes no result."""

    def __init__(self, a_file: str, b_file: str, keep: int = 150_000):
        self.a, self.b, self._keep = ByteLevel(a_file), PieceModel(b_file), keep
        self._a_len = _lengths(self.a.bytes)
        self._b_len = _lengths(self.b.bytes)
        self._names = [f"{i}{sign}" for size, signs in ((len(self._a_len), ",|"), (len(self._b_len), ",;")) for sign in signs for i in range(size)]
        cuts = re.escape(self.b.cuts)
        # Before white space that may be cut at, if what stands before it is no white space.
        self._cut = re.compile(rf"(?<=[^{_SPACE}])(?=[{cuts}])") if cuts else None
        self._plain = " " in self.b.cuts and "\n" in self.b.cuts
        self.forget()

    def forget(self) -> None:
        self.known = _Known({}, [], [], [])

    def pieces(self, text: str) -> list[str]:
        """Parts of space and text that both tokenizers treat one by one."""
        if self._plain and " ".join(text.split()) == text.replace("\n", " "):  # single blanks and line ends only
            first, *rest = text.replace("\n", " \n").split(" ")
            return [" " + first, *[p if p[0] == "\n" else " " + p for p in rest]]
        return self._cut.split(" " + text) if self._cut else [" " + text]

    def learn(self, parts: Iterable[str]) -> None:
        """Align pieces that are not known yet."""
        known = self.known
        new = [p for p in dict.fromkeys(parts) if p not in known.number]
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])

    def _learn(self, new: list[str]) -> None:
        # Pieces that don't end in white space are encoded by A in one go: it cuts before the next piece.
        tails = [p for p in new if p[-1] in _SPACES]
        new = [p for p in new if p[-1] not in _SPACES] + tails
        raw = [p.encode() for p in new]
        a = np.array(self.a.whole("".join(new[: len(new) - len(tails)])), np.int64)
        a = np.concatenate([a, *[np.array(ids, np.int64) for ids in self.a.encode(tails)]])
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        na = np.diff(np.searchsorted(np.cumsum(self._a_len[a]), ends, "right"), prepend=0)
        b_ids = self.b.encode(new)
        nb = np.fromiter(map(len, b_ids), np.int64, len(new))
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, nb.sum())
        fits, used = np.ones(len(new), bool), np.arange(len(new))
        b_ends = np.cumsum(self._b_len[b])
        same = len(b_ends) and np.array_equal(b_ends[np.cumsum(nb) - 1], ends) and b"".join(map(self.b.bytes.__getitem__, b.tolist())) == b"".join(raw)
        if not same:  # rare: a piece that B doesn't give back
            fits = np.array([b"".join(map(self.b.bytes.__getitem__, ids)) == r for ids, r in zip(b_ids, raw, strict=True)], bool)
            a, b, used = a[np.repeat(fits, na)], b[np.repeat(fits, nb)], np.flatnonzero(fits)
        figures, texts = np.zeros((len(new), 5), np.int64), [""] * len(new)
        if len(used):
            group, at, bt = coalesce(np.cumsum(self._a_len[a]), np.cumsum(self._b_len[b]))
            owner = np.repeat(np.arange(len(used)), na[fits])[at]  # pieces end with a token of each: no group spans two
            first = np.concatenate([[True], group[1:] != group[:-1]])
            count = lambda x: np.bincount(x, minlength=len(used))
            figures[used] = np.stack([na[fits], nb[fits], count(owner[first]), count(owner), np.ones(len(used), np.int64)], 1)
            self.known.pairs.append(a[at] << _BITS | b[bt])
            for k, text in zip(used.tolist(), self._shown(a, b, group, at, bt, na[fits] + nb[fits]), strict=True):
                texts[k] = text
        number = self.known.number
        number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        self.known.text += texts
        self.known.figures.append(figures)

    def _shown(self, a, b, group, at, bt, tokens) -> list[str]:
        """Groups of each piece as ``a1,a2|b1;a3|b2``: each token's number with the sign that follows it."""
        a_group, b_group = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_group[at], b_group[bt] = group, group
        closes = lambda g: np.concatenate([g[1:] != g[:-1], [True]])
        n = len(self._a_len)
        names = np.concatenate([a + n * closes(a_group), 2 * n + b + len(self._b_len) * closes(b_group)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        signed = list(map(self._names.__getitem__, names[order].tolist()))
        ends = np.cumsum(tokens).tolist()
        return ["".join(signed[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def room(self) -> bool:
        return len(self.known.number) < self._keep


def _lengths(of: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(of) + 1, np.int64)
    for i, b in of.items():
        out[i] = len(b)
    return out


@lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str) -> Aligner:
    """One per Python worker, so that what it knows serves all its tasks."""
    return Aligner(a_file, b_file)


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ragged rows, one row after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each ragged row."""
    edges, total = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as differences to the one before: those of a document's sorted pieces are small."""
    return zstandard.compress(np.diff(numbers, prepend=0).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<i4").astype(np.int64))


class _Block:
    """Documents of a task until they are written: per document its figures and its distinct pieces with their counts."""

    def __init__(self, known: _Known):
        self._known = known
        self._figures = np.concatenate(known.figures) if known.figures else np.zeros((0, 5), np.int64)
        self._pairs = np.concatenate(known.pairs) if known.pairs else np.zeros(0, np.int64)
        ends = np.cumsum(self._figures[:, 3])
        self._starts = ends - self._figures[:, 3]
        self.rows: list[tuple] = []
        self._pieces: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []

    def add(self, place: int, parts: list[int]) -> None:
        where = np.array(parts, np.int64)
        figures = self._figures[where]
        if not len(where) or not figures[:, 4].all():
            self.rows.append((place, 0, 0, 0, 0, ""))
            self._pieces.append(np.zeros(0, np.int64))
            self._counts.append(np.zeros(0, np.int64))
            return
        texts = ";".join(map(self._known.text.__getitem__, parts))
        self.rows.append((place, *figures[:, :4].sum(axis=0).tolist(), hashlib.sha256(texts.encode()).hexdigest()))
        own, counts = np.unique(where, return_counts=True)
        self._pieces.append(own)
        self._counts.append(counts)

    def pack(self) -> dict:
        """The block as one row: its distinct pairs with the number of its documents that hold them, its pieces' links
        as places among these pairs, and its documents' pieces."""
        sizes = np.array([len(p) for p in self._pieces], np.int64)
        pieces, places = np.unique(np.concatenate(self._pieces), return_inverse=True) if sizes.sum() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        links = self._figures[pieces, 3]
        pairs, linked = np.unique(self._pairs[_gather(self._starts[pieces], links)], return_inverse=True)
        begins = np.cumsum(links) - links
        held = np.zeros(len(pairs), np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        places = places.reshape(-1)
        linked = linked.reshape(-1)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = places[i:j]
            held[np.unique(linked[_gather(begins[own], links[own])])] += 1
        names = ["place", *_FIGURES, "groups_sha256"]
        columns = dict(zip(names, map(list, zip(*self.rows, strict=True)), strict=True))
        counts = np.concatenate([*self._counts, np.zeros(0, np.int64)])
        return columns | {
            "pairs": pairs, "held": held, "links": _packed(links), "linked": _packed(linked),
            "sizes": _packed(sizes), "pieces": _packed(places), "counts": _packed(counts),
        }


def _blocks(docs: DataFrame, a_file: str, b_file: str, most: int) -> DataFrame:
    """Blocks of about ``most`` characters; a longer text is a block of its own."""
    figures = [T.StructField(n, T.LongType()) for n in _FIGURES]
    docs_type = T.ArrayType(T.StructType([docs.schema["doc_id"], *figures, T.StructField("groups_sha256", T.StringType())]))
    binary = [T.StructField(n, T.BinaryType()) for n in ("links", "linked", "sizes", "pieces", "counts")]
    longs = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("pairs", "held")]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", docs_type), *longs, *binary])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, number = aligner(a_file, b_file), TaskContext.get().partitionId() << 33
        ids: list[pa.Array] = []
        held: list[tuple[int, list[int]]] = []
        size = rows = 0

        def out() -> pa.RecordBatch:
            nonlocal number
            block = _Block(tool.known)
            for place, parts in held:
                block.add(place, parts)
            row, names = block.pack(), pa.concat_arrays(ids)
            struct = pa.StructArray.from_arrays(
                [names.take(pa.array(row["place"])), *[pa.array(row[n], pa.int64()) for n in _FIGURES], pa.array(row["groups_sha256"], pa.string())],
                ["doc_id", *_FIGURES, "groups_sha256"],
            )
            listed = pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)
            columns = [pa.array([number], pa.int64()), listed, *[pa.array([row[n]], pa.list_(pa.int64())) for n in ("pairs", "held")]]
            columns += [pa.array([row[f.name]], pa.binary()) for f in binary]
            number += 1
            return pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                texts = [t if t and _MARK not in t else "" for t in batch.column(1).to_pylist()]
                parts = [tool.pieces(t) if t else [] for t in texts]
                if not tool.room():
                    if held:
                        yield out()
                        ids, held, size, rows = [], [], 0, 0
                    tool.forget()
                tool.learn(chain.from_iterable(parts))
                ids.append(batch.column(0))
                for k, own in enumerate(parts):
                    held.append((rows + k, list(map(tool.known.number.__getitem__, own))))
                    size += len(texts[k])
                    if size >= most:
                        yield out()
                        ids, held, size, rows = [batch.column(0).slice(k + 1)], [], 0, -k - 1
                rows += batch.num_rows
        if held:
            yield out()

    return docs.mapInArrow(run, schema)


def align(
    docs: DataFrame, a_file: str | None = None, b_file: str | None = None, block_chars: int = 4_000_000,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is byte-level BPE of space and text, B a sentence-piece model that adds the space itself; special tokens are
    ordinary text. Groups are the stretches between byte offsets where tokens of both end; links are all pairs of A and
    B token occurrences whose byte ranges overlap. A pair of ids counts how many rows of ``docs`` hold it linked;
    ``count_sum`` adds that over a document's links, and ``n_best`` is how many links have the highest count of their A
    id, ties included. ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``.

    Texts that are null, empty, or that B's tokens don't give back byte by byte have zeros and an empty digest.
    Repeated rows count again, null ids are kept, an empty table gives no rows; other columns are left out.
    """
    a_file, b_file = a_file or vocabulary_file(), b_file or piece_model_file()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = cut_lineage(_blocks(rows, a_file, b_file, block_chars))
    pairs = blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("block", "p.pairs", "p.held")
    counts = pairs.groupBy("pairs").agg(F.sum("held").alias("count"))
    # Pairs of one A id: no more than B has ids.
    top = F.max("count").over(Window.partitionBy(F.shiftright("pairs", _BITS)))
    counts = counts.select("pairs", "count", (F.col("count") == top).alias("best"))
    back = pairs.select("block", "pairs").join(counts, "pairs").groupBy("block")
    back = back.agg(F.sort_array(F.collect_list(F.struct("pairs", "count", "best"))).alias("found"))
    back = back.select("block", F.col("found.count").alias("count"), F.col("found.best").alias("best"))
    # A block without pairs is missing there.
    whole = blocks.drop("pairs", "held").join(back, "block", "left")
    fields = [docs.schema[doc_id].dataType, *[T.LongType()] * 6, T.StringType()]
    names = ["doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, fields, strict=True)])
    columns = ["docs", "links", "linked", "sizes", "pieces", "counts", "count", "best"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                of = dict(zip(columns, row.columns, strict=True))
                numbers = {n: _unpacked(of[n][0].as_py()) for n in columns[1:6]}
                found = of["docs"].flatten()
                n_best = count_sum = np.zeros(len(found), np.int64)
                if len(numbers["pieces"]):
                    sums = []
                    for name in ("best", "count"):
                        weight = of[name].flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
                        piece = _sums(weight[numbers["linked"]], numbers["links"])
                        sums.append(_sums(piece[numbers["pieces"]] * numbers["counts"], numbers["sizes"]))
                    n_best, count_sum = sums
                part = [found.field(n) for n in ("doc_id", *_FIGURES)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(n_best), pa.array(count_sum), found.field("groups_sha256")], names)

    return whole.select(*columns).mapInArrow(finish, schema)
