"""Tries of conversations against plain prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import frame

from shoplens.llm import prefix_trie
from shoplens.llm.prefix_trie import DoubleArray, branched, dense, numbered, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n string, base long, pos long"


def plain_built(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def plain_nodes(built):
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = lambda q: not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append(
            (min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)),
             sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(spark, rows, levels=16, shard=4096):
    turns = numbered(frame(spark, [(*r, 7, "n", 8, 9) for r in rows], SCHEMA)).cache()
    out = trie(branched(turns), turns.select("conv_id").distinct(), levels, shard)
    return sorted(map(tuple, out.select(*COLUMNS).collect()))


def conversations(seed, n=60, words=3, turns=30):
    """Few different turns, so that prefixes are shared; copies of whole conversations; some long ones."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 400), n):
        for t in range(r.choice([0, 1, 3, 9, 12, turns])):
            rows.append((c, t, r.choice(["user", None, ""]), r.choice(["", None, "é😀", "a" * r.randrange(1, words)])))
    return rows


@pytest.mark.parametrize("levels,shard", [(16, 4096), (4, 7), (1, 3)])
def test_equals_plain_prefixes(spark, levels, shard):
    rows = conversations(levels)
    r = random.Random(9)
    r.shuffle(rows)
    assert run(spark, rows, levels, shard) == plain_nodes(plain_built(rows))


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "x"), (3, None, "user", "b"), (3, None, "user", "a"), (3, 1, None, None), (3, 1, None, None), (3, 1, None, None), (10**18, 5, "a", "b"), (-7, 2, "a", "b")]
    rows += [(20, t, "r", "same") for t in range(100)] + [(25, t, "r", "same") for t in range(100)] + [(30, 1, "r", "z" * 300_000)]
    # Turns with one number go by a hash, so the plain order is only known where they are equal or alone.
    rows = [x for x in rows if x[3] != "b" or x[1] is not None]
    assert run(spark, rows, 8) == plain_nodes(plain_built(rows))


def test_turns_with_one_number_keep_all_rows(spark):
    out = numbered(frame(spark, [(1, 1, "a", x, 0, "", 0, 0) for x in "pqpqq"], SCHEMA)).collect()
    assert sorted(r["pos"] for r in out) == [1, 2, 3, 4, 5] and len({r["t1"] for r in out}) == 2


def test_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "a", "b")]) == []


def test_turnless_conversations_end_at_the_root(spark):
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(lone, 1, "user", "x")]
    got = run(spark, rows)
    assert got == plain_nodes(plain_built(rows)) and got[0][1:5] == (0, None, 1, 0)


def test_prefix_hashes_over_blocks_of_bands(spark):
    turns = spark.range(3).selectExpr("id conv_id", "explode(sequence(1, 40)) pos").selectExpr("conv_id", "cast(pos as long) pos", "pos * 7 t1", "pos * 9 t2", "1L bytes")
    runs = turns.selectExpr("conv_id", "pos - 1 band", "xxhash64(t1, pos) x1", "xxhash64(t2, pos) x2")
    for r in (prefix_trie.running_xor(runs, block=4).groupBy("conv_id").agg({"band": "count"}).collect()):
        assert r["count(band)"] == 40
    got = {(r["conv_id"], r["band"]): r for r in prefix_trie.running_xor(runs, block=4).collect()}
    for (c, b), r in got.items():
        assert r["start1"] == (got[c, b - 1]["end1"] if b else 0) and r["end1"] == r["start1"] ^ r["x1"] and r["end2"] == r["start2"] ^ r["x2"]


def test_double_array_holds_exactly_its_paths():
    r = np.random.default_rng(5)
    paths = {tuple(r.integers(0, 40, r.integers(0, 6))) for _ in range(800)}
    codes = np.full((len(paths), 6), -1, np.int64)
    for i, p in enumerate(paths):
        codes[i, : len(p)] = p
    table = DoubleArray(codes)
    known = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    states = {(): 0}
    for d in range(1, 7):
        for p in [p for p in states if len(p) == d - 1]:
            to = table.walk(np.full(42, states[p]), np.arange(-1, 41))
            assert to[0] == -1
            for c in range(41):
                assert (to[c + 1] >= 0) == ((*p, c) in known)
                if to[c + 1] >= 0:
                    states[(*p, c)] = int(to[c + 1])
    assert len(set(states.values())) == len(known) + 1
    numbers = dense(np.array([[5, 9], [5, 2], [7, 5]]))
    assert numbers.tolist() == [[0, 2], [0, 3], [1, 0]]
