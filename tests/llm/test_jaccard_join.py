"""The Jaccard join against all pairs on small tables, and its parts."""

import itertools
import random

import numpy as np
import pytest
from helpers import component_of, documents, frame, prose, shingles

from shoplens.llm import jaccard_join as j


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in component_of(sets, links).items()}


def changed(text, n, seed):
    w, r = text.split(" "), random.Random(seed)
    for i in r.sample(range(len(w)), n):
        w[i] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_against_all_pairs(spark, k, percent):
    texts = [None, "", " \n\t", "One", "one", "ONE two", "one two", "a b c", "A\x0bB\tC", "É b c", "é b c"]
    for seed in range(12):
        base = prose(seed, 40 + 35 * seed)
        texts += [base, base.upper(), base]
        texts += [changed(base, n, seed * 10 + n) for n in (1, 1, 2, 3, 5, 9)]
        texts.append(base + " " + prose(seed + 100, 4))
    # A chain: each text is near the next only.
    chain = prose(77, 120)
    for step in range(6):
        texts.append(chain)
        chain = changed(chain, 2, 500 + step)
    texts.append(prose(500, 3000))
    texts.append(changed(prose(500, 3000), 12, 4))
    random.Random(3).shuffle(texts)
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(docs, k, percent, block=7).collect()}
    assert got == brute(list(enumerate(texts, 1)), k, percent)


def test_awkward_rows(spark):
    schema = "doc_id long, text string, component_id string, node long, key string, mark1 string"
    rows = [(5, "a b c d", "x", 1, "k", "m"), (5, "a b c d", "x", 1, "k", "m"), (3, "A b C d", "y", 2, "k", "m"), (None, "a b c d", None, None, None, None), (9, None, None, None, None, None)]
    got = sorted(map(tuple, j.jaccard_components(frame(spark, rows, schema)).collect()), key=str)
    assert got == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9), (None, 2, None)]
    assert j.jaccard_components(frame(spark, [], schema)).collect() == []


def test_two_texts_under_one_id(spark):
    """Each of an id's two sets is linked with its own near copy."""
    rows = []
    for i in range(30):
        one, two = prose(1000 + i, 120, 5000), prose(2000 + i, 90, 5000)
        rows += [(i, one), (i, two), (100 + i, changed(one, 1, i)), (200 + i, changed(two, 1, i))]
    got = {(r["doc_id"], r["component_id"]) for r in j.jaccard_components(frame(spark, rows, "doc_id long, text string"), block=7).collect()}
    assert got == {(base + i, i) for i in range(30) for base in (0, 100, 200)}


def test_a_large_group_leaves_one_pair_a_member(spark):
    """Near copies of one text, five times as many: links to verify grow with the members, not with their keys."""
    base, made = prose(31, 150, 5000), {}
    real = j.verify
    for n in (60, 300):
        pairs = []
        j.verify = lambda found, *rest: (pairs.append(found.count()), real(found, *rest))[1]
        try:
            docs = frame(spark, [(i, changed(base, 1, i)) for i in range(n)], "doc_id long, text string")
            assert {r["component_id"] for r in j.jaccard_components(docs, 5, 80, block=32).collect()} == {0}
        finally:
            j.verify = real
        made[n] = pairs
    assert made == {60: [59, 0], 300: [299, 0]}


def test_large_unlike_sets_are_told_apart_by_their_counts(spark):
    """Long texts with one boilerplate share keys, but no pair of them is verified; near copies of long texts are linked."""
    boiler, texts = prose(41, 1200, 5000), []
    for i in range(24):
        texts.append(boiler + " " + prose(5100 + i, 1800 + 40 * i, 5000))
    texts += [changed(texts[i], 20, i) for i in range(4)]
    seen, real = [], j.verify
    j.verify = lambda found, *rest: (seen.extend(map(tuple, found.select("a", "b").collect())), real(found, *rest))[1]
    try:
        got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(documents(spark, texts), 5, 80, block=7).collect()}
    finally:
        j.verify = real
    assert sorted(seen) == [(i, 24 + i) for i in range(1, 5)]
    assert got == {i: i if i <= 24 else i - 24 for i in range(1, 29)}


def test_counts_bound_the_overlap():
    r = np.random.default_rng(12)
    for n, m in ((1, 2), (300, 300), (4000, 3000), (9000, 40_000)):
        one = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate([one[: n // 2], r.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2)]))
        points = j._points([j.group_counts(s).tobytes() for s in (one, other)])
        assert points.sum(axis=1).tolist() == [len(one), len(other)]
        both = len(np.intersect1d(one, other))
        bounds = [int(np.minimum(*p).sum()) for p in (points, j._folded(points, j.GROUPS))]
        assert both <= bounds[0] <= bounds[1]
    crowded = np.arange(3000, dtype=np.uint64) << np.uint64(40)
    assert j.group_counts(crowded).sum() == 3000 and j.group_counts(crowded).dtype == np.uint8


def test_no_pair_is_lost_by_slices():
    """Sets at the threshold share a key, whatever their sizes."""
    r = np.random.default_rng(1)
    for n in (1, 2, 9, 10, 31, 57, 64, 120, 500):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            for lost, gained in ((len(a) // 10, 0), (len(a) // 20, len(a) // 20), (0, len(a) // 9)):
                b = np.unique(np.concatenate([a[lost:], r.integers(0, 2**63, gained, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
                    assert set(j._signature(a, 90)[0].tolist()) & set(j._signature(b, 90)[0].tolist())


def test_tree_finds_what_the_bound_allows():
    r = np.random.default_rng(2)
    points = r.poisson(4, (300, j.GROUPS)).astype(np.int64)
    points[100:200] = points[50] + r.integers(0, 2, (100, j.GROUPS))
    tree = j.CountTree(points)
    for q in points[::17]:
        need = j._need(int(q.sum()), 90)
        want = np.flatnonzero(np.minimum(points, q).sum(axis=1) >= need(points.sum(axis=1)))
        assert sorted(tree.search(q, need)[0].tolist()) == want.tolist()


def test_unrelated_sets_share_no_key():
    """Empty slices get no key where a non-empty one is sure to agree; pairs at the threshold still share one."""
    r = np.random.default_rng(11)
    seen = {}
    for i in range(300):
        keys, _ = j._signature(np.unique(r.integers(0, 2**63, 300, dtype=np.uint64)), 80)
        for k in keys.tolist():
            seen.setdefault(k, set()).add(i)
    assert all(len(v) == 1 for v in seen.values())
    for n in (1, 2, 3, 5, 9, 20, 63, 64, 100, 300):
        for percent in (80, 90):
            for _ in range(30):
                one = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
                gone = r.integers(0, n * (100 - percent) // 100 + 1)
                other = np.unique(np.concatenate([one[gone:], r.integers(0, 2**63, r.integers(0, 1 + n // 20), dtype=np.uint64)]))
                both = len(np.intersect1d(one, other))
                if 100 * both >= percent * (len(one) + len(other) - both):
                    assert np.intersect1d(j._signature(one, percent)[0], j._signature(other, percent)[0]).size
