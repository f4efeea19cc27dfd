"""Product codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest
from helpers import frame

from shoplens.llm import vector_codes
from shoplens.llm.vector_codes import LIMIT, decode, digest, encode, exact_products, nearest

SCHEMA = "vec_id long, label int, embedding array<float>, codes string, error string, x string"


def plain(rows, parts, entries, rounds):
    """Python integers only: codes, error by row; label sums; books."""
    kept = [(i, lab, [math.floor(256 * float(np.float32(v))) for v in e]) for i, lab, e in rows if e and all(v is not None and math.isfinite(v) for v in e)]
    if not kept:
        return [], None
    w = len(kept[0][2]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for _, _, x in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))[::-1]

    for _ in range(rounds):
        got = [[best(c[p], books[p])[0] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(order)):
                own = [c[p] for c, g in zip(cut, got) if g[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    out = []
    for (i, lab, _), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for k, _ in found), sum(f for _, f in found)))
    sums = {}
    for _, lab, _, err in out:
        sums[lab] = sums.get(lab, 0) + err
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, err, sums[lab], sha) for i, lab, c, err in out), key=str), books


def run(spark, rows, **kw):
    df = frame(spark, [(i, lab, e, "c", "e", "x") for i, lab, e in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, digest(*encode(df, **kw)).collect()), key=str)


def vectors(n, width, seed=1, spread=1.0):
    r = np.random.default_rng(seed)
    return [(int(i), [None, 1, 2][i % 3], [float(np.float32(v)) for v in r.normal(0, spread, width)]) for i in r.permutation(n)]


@pytest.mark.parametrize("bits", [None, 5, 9])
def test_products_are_exact(bits):
    r = np.random.default_rng(3)
    for top in (1, 300, LIMIT - 1):
        a, b = r.integers(-top, top + 1, (40, 7)), r.integers(-top, top + 1, (9, 7))
        a[0], b[0] = -top, -top
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert exact_products(a, b, bits).tolist() == want


def test_ties_go_to_the_lower_index():
    book = np.array([[5, 0], [0, 5], [5, 0], [0, 0]])
    best, far = nearest(np.array([[5, 0], [5, 5], [1, 0]]), book)
    assert best.tolist() == [0, 0, 3] and far.tolist() == [0, 25, 1]


@pytest.mark.parametrize("spread", [0.01, 1.0, 5000.0])
def test_equals_plain_integers(spark, spread):
    rows = vectors(300, 32, spread=spread)
    want, _ = plain(rows, 16, 64, 2)
    assert run(spark, rows) == want


def test_awkward_rows(spark):
    rows = vectors(40, 32)
    v = rows[0][2]
    odd = [(100, 1, None), (101, 1, []), (102, 1, [None, *v[1:]]), (103, None, [math.nan, *v[1:]]), (104, 1, [*v[1:], math.inf]), (None, 1, v), (None, None, v)]
    rows += odd + rows[:9] + rows[:9] + [(7, 2, rows[3][2]), (200, 1, [0.0] * 32), (201, 1, [-0.0] * 32), (202, 1, [-1 / 512] * 32)]
    want, _ = plain(rows, 16, 64, 2)
    assert run(spark, rows) == want


def test_equal_vectors_leave_entries_unused(spark):
    rows = [(i, 1, [0.5, -0.5] * 8) for i in range(70)] + [(99, 1, [0.25, -0.75] * 8)]
    want, books = plain(rows, 16, 64, 2)
    assert run(spark, rows) == want
    assert books[0][1] == [128]


def test_no_vector(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, None)]) == []


def test_undefined_vectors_fail(spark):
    for rows in ([(1, 1, [1.0] * 15)], [(1, 1, [1e9] * 16)], [(1, 1, [1.0] * 16), (2, 1, [1.0] * 32)]):
        with pytest.raises(Exception, match="vector"):
            run(spark, rows)


def test_approximation(spark):
    rows = vectors(200, 16)
    codes, books = encode(frame(spark, [(i, lab, e, "c", "e", "x") for i, lab, e in rows], SCHEMA), entries=200, rounds=0)
    by_id = {i: e for i, _, e in rows}
    for r in decode(codes, books).collect():
        assert r["error"] == 0
        assert all(0 <= x - y < 1 / 256 for x, y in zip(by_id[r["vec_id"]], r["approximation"]))


def test_parameters(spark):
    with pytest.raises(ValueError):
        encode(frame(spark, [], SCHEMA), entries=257)
    assert vector_codes.books_digest(None) == hashlib.sha256(b"").hexdigest()
