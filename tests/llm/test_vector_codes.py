"""Vector codes against plain k-means on integers."""

import hashlib
import math

import numpy as np
import pytest

from stagewise.llm import vector_codes as op


def plain(rows, rounds=op.ROUNDS):
    """The contract over (vec_id, embedding, label) rows, one distance after another."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(op.SCALE * np.float32(x).astype("f8")) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    width = len(ints[0]) // op.PARTS
    part = lambda i, p: ints[i][p * width : (p + 1) * width]
    books = [[part(i, p) for i in order[: op.ENTRIES]] for p in range(op.PARTS)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda i, p: min((far(part(i, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(op.PARTS):
            own = [best(i, p)[1] for i in range(len(kept))]
            for k in range(len(books[p])):
                members = [part(i, p) for i in range(len(kept)) if own[i] == k]
                if members:
                    books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    out, sums = [], {}
    for i, row in enumerate(kept):
        found = [best(i, p) for p in range(op.PARTS)]
        error = sum(d for d, _ in found)
        sums[row[2]] = sums.get(row[2], 0) + error
        out.append((row[0], "".join(f"{k:02x}" for _, k in found), error, row[2]))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((a, b, c, sums[d], digest) for a, b, c, d in out), key=repr)


def frame(spark, rows):
    table = [(*r, "x", "y") for r in rows]
    return spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, code string, entry string").repartition(3)


def vectors(n, width=32, seed=3, spread=0.2):
    chance = np.random.default_rng(seed)
    centres = chance.normal(0, 0.3, (9, width))
    values = centres[chance.integers(0, 9, n)] + chance.normal(0, spread, (n, width))
    return [(int(i), [float(x) for x in values[i].astype("f4")], int(i) % 4 or None) for i in range(n)]


@pytest.mark.parametrize("spread", [0.01, 0.3])
def test_codes_match_plain_means(spark, spread):
    rows = vectors(240, spread=spread)
    assert sorted(map(tuple, op.vector_codes(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = vectors(80)
    rows += [(1000, None, 1), (1001, [None, *rows[0][1][1:]], 1), (1002, [float("nan"), *rows[0][1][1:]], 1), (1003, [float("inf")] * 32, 2)]
    rows += [(None, rows[3][1], None), (None, rows[4][1], 7), *rows[:20], *[(2000 + i, [0.5] * 32, 5) for i in range(30)], (7, [0.25] * 32, 3)]
    assert sorted(map(tuple, op.vector_codes(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_few_vectors_and_one(spark):
    for rows in (vectors(5), vectors(1), vectors(2, width=16)):
        assert sorted(map(tuple, op.vector_codes(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_vectors_that_cannot_be_cut_have_no_code(spark):
    rows = vectors(40)
    odd = [(500, [0.5] * 20, 1), (501, [], 1), (502, [0.5] * 64, None), (503, [1e30] * 32, 9)]
    got = {r.vec_id: (r.code, r.error) for r in op.vector_codes(frame(spark, rows + odd)).collect()}
    assert all(got.pop(i) == (None, None) for i, _, _ in odd)
    assert got == {i: (code, error) for i, code, error, _, _ in plain(rows)}
    assert [r.code for r in op.vector_codes(frame(spark, odd[:2])).collect()] == [None, None]
    assert op.vector_codes(frame(spark, [])).collect() == []


def test_bounds_hold_and_save_distances():
    chance = np.random.default_rng(5)
    parts = chance.integers(-200, 200, (3000, 4))
    book = parts[:64].copy()
    state = op.Bounds.fresh(parts, book, 16)
    seen, needed = [], []
    squared = op.squared
    for step in range(6):
        after = book + chance.integers(-30 // (step + 1), 30 // (step + 1) + 1, book.shape)
        seen.clear()
        op.squared = lambda a, c: (seen.append(len(a) * c.shape[-2]), squared(a, c))[1]
        try:
            needed.append(state.moved(parts, after, book))
        finally:
            op.squared = squared
        book = after
        far = squared(parts, book)
        assert (state.own == far.argmin(1)).all()
        steps = np.sqrt(far)
        assert (state.upper >= steps[np.arange(len(parts)), state.own]).all()
        listed = np.zeros(far.shape, bool)
        np.put_along_axis(listed, state.own[:, None].astype("i8"), True, 1)
        for place in range(state.near.shape[1]):
            rest = np.where(listed, np.inf, steps).min(1)
            assert (state.lower[:, place] <= rest).all()
            np.put_along_axis(listed, state.near[:, place, None].astype("i8"), True, 1)
        assert (state.outer <= np.where(listed, np.inf, steps).min(1)).all()
        state.narrowed(max(8, needed[-1]))
    assert sum(seen) < 0.6 * far.size
