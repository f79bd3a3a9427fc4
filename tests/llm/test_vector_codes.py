import hashlib
import math
import random

import pytest

from scoreweave.llm import vector_codes

TYPES = "vec_id long, embedding array<float>, label int, code string, part string"


def _plain(rows, entries=16, parts=8, rounds=6):
    """Row by row, with whole numbers: codes and errors by place, and the codebooks."""
    kept = [k for k, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    whole = {k: [math.floor(4096 * x) for x in rows[k][1]] for k in kept}
    if not kept:
        return {}, None
    width = len(whole[kept[0]]) // parts
    piece = lambda v, p: v[p * width : (p + 1) * width]
    books = [[piece(whole[k], p) for k in order[:entries]] for p in range(parts)]

    def nearest(v, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        for p, book in enumerate(books):
            found = {}
            for k in kept:
                v = piece(whole[k], p)
                found.setdefault(nearest(v, book)[0], []).append(v)
            for e, members in found.items():
                book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = {}
    for k in kept:
        near = [nearest(piece(whole[k], p), books[p]) for p in range(parts)]
        out[k] = "".join(f"{e:02x}" for e, _ in near), sum(d for _, d in near)
    numbers = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(numbers.encode()).hexdigest()


def _frame(spark, rows, slices=3):
    return spark.createDataFrame([(*r, "mine", "p") for r in rows], TYPES).repartition(slices)


def _same(library, rows):
    books = vector_codes.fit_codebooks(_frame(library, rows))
    got = vector_codes.encode(_frame(library, rows), books, keep=["label"]).collect()
    want, sha = _plain(rows)
    assert (books.sha256() if books else None) == sha
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in got) == sorted((str(rows[k][0]), *v) for k, v in want.items())


def _floats(values):
    import numpy as np

    return [float(np.float32(x)) for x in values]


@pytest.mark.parametrize("n,dims,spread", [(300, 64, 0.3), (40, 16, 0.001), (9, 8, 5.0), (1, 8, 1.0)])
def test_codes_match_plain_arithmetic(library, monkeypatch, n, dims, spread):
    monkeypatch.setattr(vector_codes, "BLOCK", 64 * dims)
    draw = random.Random(n)
    rows = [(k, _floats(draw.gauss(0, spread) for _ in range(dims)), k % 3 or None) for k in range(n)]
    rows += rows[: n // 4] + [(10_000 + k, rows[0][1], 7) for k in range(n)]
    _same(library, rows)


def test_nulls_odd_numbers_and_equal_ids(library):
    ok = _floats([0.1, -0.1, 0.25, -0.0, 1e-30, -1e-30, 3, -3])
    rows = [
        (1, None, 1), (2, [None] * 8, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] + [0.0] * 7, 1), (5, ok, None), (5, ok[::-1], 2),
        (None, ok, 1), (6, [0.0] * 8, 1), (7, [-1 / 8192] * 8, 1), (8, _floats([70000.0] * 8), 1), (9, _floats([-1e9] * 8), 1),
    ]
    _same(library, rows)


def test_other_lengths_and_huge_components_have_no_code(library):
    rows = [(0, [], 1), (1, [0.5] * 8, 1), (2, [0.5] * 16, 1), (3, [1e30] + [0.0] * 7, 1), (4, [0.25] * 8, 1)]
    df = _frame(library, rows)
    out = {r["vec_id"]: r for r in vector_codes.encode(df, vector_codes.fit_codebooks(df)).collect()}
    assert {k for k, r in out.items() if r["code"] is None} == {0, 2, 3} and out[1]["error"] == 0
    with pytest.raises(ValueError):
        vector_codes.fit_codebooks(_frame(library, [(1, [0.5] * 9, 1)]))


def test_empty_tables(library):
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        df = _frame(library, rows)
        assert vector_codes.fit_codebooks(df) is None
        assert [r["code"] for r in vector_codes.encode(df, None).collect()] == [None] * (rows == [(1, [], 1)])


def test_query_sums_errors_by_label(library, tmp_path):
    from scoreweave.llm.queries import op12_vector_codes

    draw = random.Random(1)
    rows = [(k, _floats(draw.random() for _ in range(16)), draw.choice([None, 1, 2])) for k in range(80)]
    _frame(library, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, sha = _plain(rows)
    out = op12_vector_codes(library, str(tmp_path)).collect()
    assert len(out) == 80 and {r["codebooks_sha256"] for r in out} == {sha}
    for r in out:
        assert r["label_error"] == sum(want[k][1] for k, x in enumerate(rows) if x[2] == rows[r["vec_id"]][2])
