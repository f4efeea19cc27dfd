"""Shared passages against brute force."""

import collections
import itertools
import random

import numpy as np
import pytest
from helpers import component_of, documents, frame, prose, words

from shoplens.llm import substring_dedup as s


def plain_windows(h, width):
    out = []
    for c in range(len(h)):
        l, r = c, c
        while l > 0 and h[l - 1] > h[c]:
            l -= 1
        while r + 1 < len(h) and h[r + 1] >= h[c]:
            r += 1
        if r - l + 1 >= width:
            out.append((l, c, r))
    return sorted(out)


def test_compact_windows():
    r = np.random.default_rng(4)
    for n, values in ((1, 9), (40, 6), (200, 50), (500, 2**60)):
        h = r.integers(0, values, n).astype(np.uint64)
        spans = np.array([0, n // 3, n // 3]), np.array([n // 3, n // 3, n])
        got = s.compact_windows(h, *spans, 5)
        want = [(k, a + l, a + c, a + e) for k, (a, b) in enumerate(zip(*spans)) for l, c, e in plain_windows(h[a:b].tolist(), 5)]
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_long_texts_are_cut_with_an_overlap():
    own, lo, hi = s._segments(np.array([0, 10]), np.array([10, 110]), 40, 15)
    assert own.tolist() == [0, 1, 1, 1, 1] and lo.tolist() == [0, 10, 35, 60, 85] and hi.tolist() == [10, 50, 75, 100, 110]


def texts_with_passages():
    r = random.Random(8)
    hot, other = prose(1000, 70), prose(1001, 55)
    boiler = prose(1002, 30)
    texts = [prose(i, 60 + 20 * (i % 9)) for i in range(30)]
    for i in range(0, 24, 2):
        texts[i] += " " + hot + " " + prose(3000 + i, 10 + i)
    for i in range(0, 24, 6):
        texts[i + 1] = prose(4000 + i, 7) + "\n" + other + " " + texts[i + 1]
    for i in range(1, 30, 3):
        texts[i] += " " + boiler + " " + prose(5000 + i, 40)
    # Two that share a whole passage around the boilerplate, though the first with the boilerplate does not.
    pair = prose(1003, 20) + " " + boiler + " " + prose(1004, 20)
    texts += [prose(6000, 30) + " " + pair, pair + " " + prose(6001, 90), None, "", "a b", texts[3], texts[3], prose(9, 49), prose(9, 49)]
    near = hot.split(" ")
    near[35] = "changed"
    texts.append(prose(7000, 25) + " " + " ".join(near))
    r.shuffle(texts)
    return texts, near


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_equal_passages_are_never_lost(spark, broadcast_rows):
    texts, near = texts_with_passages()
    got = s.passages(documents(spark, texts), broadcast_rows=broadcast_rows).collect()
    first = {}
    for i, t in enumerate(texts, 1):
        if t is not None:
            first.setdefault(t, i)
    assert sorted((r["a"], r["b"]) for r in got if r["kind"] == "copy") == sorted((first[t], i) for i, t in enumerate(texts, 1) if t is not None and first[t] != i)
    w = {i: words(t) for t, i in first.items()}
    runs = {}
    for i, x in w.items():
        for k in range(len(x) - 49):
            runs.setdefault(tuple(x[k : k + 50]), set()).add(i)
    found = [r for r in got if r["kind"] == "passage"]
    for r in found:
        x, y = w[r["a"]][r["a_from"] : r["a_to"]], w[r["b"]][r["b_from"] : r["b_to"]]
        x, y = ({tuple(v[k : k + 5]) for k in range(len(v) - 4)} for v in (x, y))
        assert r["a_to"] - r["a_from"] >= 50 and abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
    assert len(found) == len({(r["a"], r["b"], r["a_from"], r["b_from"]) for r in found})
    linked = component_of(w, [(r["a"], r["b"]) for r in found])
    for members in runs.values():
        for a, b in itertools.combinations(members, 2):
            assert linked[a] == linked[b]
    inside = {i for m in runs.values() if len(m) > 1 for i in m}
    ends = {r["a"] for r in found} | {r["b"] for r in found}
    changed = next(i for i, t in enumerate(texts, 1) if t and " changed " in t)
    assert inside <= ends and changed in ends and ends <= inside | {changed}


def test_awkward_rows(spark):
    schema = "doc_id long, text string, node string, key string, a string, kind string, l int"
    text = prose(1, 120)
    rows = [(7, text, *"nkax", 1), (7, text, *"nkax", 1), (2, prose(2, 9) + " " + text, *"nkax", 1), (None, text, None, None, None, None, None), (4, None, *"nkax", 1)]
    got = sorted((r["kind"], r["a"], r["b"]) for r in s.passages(frame(spark, rows, schema)).collect())
    assert got == [("passage", 2, 7)]
    assert s.passages(frame(spark, [], schema)).collect() == []


def test_recall_of_near_passages(spark):
    """Words changed, inserted or deleted anywhere in passages of 60, 90 and 100 words: nine in ten of each kind are found."""
    r = random.Random(5)
    edits = {"change": lambda w, i: w[:i] + ["changed"] + w[i + 1 :], "insert": lambda w, i: w[:i] + ["changed"] + w[i:], "delete": lambda w, i: w[:i] + w[i + 1 :]}
    texts, kinds = [], []
    for kind, edit in edits.items():
        for size, times in ((60, 1), (90, 1), (100, 2)):
            for _ in range(60):
                n = len(kinds)
                passage = prose(10_000 + n, size, 20_000).split(" ")
                other = passage
                for _ in range(times):
                    other = edit(other, r.randrange(len(other)))
                texts += [prose(20_000 + n, 30, 20_000) + " " + " ".join(passage)]
                texts += [prose(30_000 + n, 20, 20_000) + " " + " ".join(other) + " " + prose(40_000 + n, 20, 20_000)]
                kinds.append((kind, size, times))
    got = {(x["a"], x["b"]) for x in s.passages(documents(spark, texts)).collect()}
    assert got <= {(2 * n + 1, 2 * n + 2) for n in range(len(kinds))}
    found = collections.Counter(kinds[a // 2] for a, _ in got)
    print(found)
    assert all(found[k] >= 54 for k in set(kinds)), found


def ends_of(rows):
    return {(r["a"], r["b"]) for r in rows if r["kind"] == "passage"}


def test_a_link_does_not_hide_another_passage(spark):
    """Many triples a, b, c: all hold one boilerplate; b and c share a second passage, of which a holds all but the end."""
    texts = []
    for i in range(40):
        boiler, shared = prose(100 + i, 70), prose(200 + i, 50)
        part = " ".join(shared.split(" ")[:45])
        texts += [" ".join([boiler, prose(300 + i, 20), part, prose(400 + i, 40)])]
        texts += [" ".join([prose(500 + i, 15), boiler, prose(600 + i, 25), shared, prose(700 + i, 15)])]
        texts += [" ".join([prose(800 + i, 35), shared, prose(900 + i, 30)] + ([boiler] if i % 2 else []))]
    rows = s.passages(documents(spark, texts)).collect()
    got, starts = ends_of(rows), {(r["a"], r["b"], r["b_from"]) for r in rows}
    for i in range(40):
        a, b, c = 3 * i + 1, 3 * i + 2, 3 * i + 3
        assert (a, b) in got and (b, c, 35) in starts and ((a, c) in got) == bool(i % 2), i


def test_the_first_text_does_not_hide_near_passages_of_others(spark):
    """Triples a, b, c: a holds 48 words of a passage of 60; b and c hold it all, c with a word beyond changed, inserted or deleted."""
    texts = []
    for i in range(90):
        shared, at = prose(100 + i, 60, 20_000).split(" "), 48 + i % 2
        other = [shared[:at] + ["changed"] + shared[at + 1 :], shared[:at] + ["changed"] + shared[at:], shared[:at] + shared[at + 1 :]][i % 3]
        texts += [" ".join([prose(200 + i, 20, 20_000), *shared[:48], prose(300 + i, 60, 20_000)])]
        texts += [" ".join([prose(400 + i, 15, 20_000), *shared, prose(500 + i, 25, 20_000)])]
        texts += [" ".join([prose(600 + i, 35, 20_000), *other, prose(700 + i, 30, 20_000)])]
    got = ends_of(s.passages(documents(spark, texts)).collect())
    # Texts 3i + 2 and 3i + 3, whose equal runs are shorter than a passage.
    between = {3 * i + 2 for i in range(90)}
    found = {a for a, b in got if a in between and b == a + 1}
    print(len(found))
    assert len(found) >= 81, len(found)


def test_a_later_place_of_the_first_text_is_not_hidden(spark):
    """The first text holds all but the last word of a passage before the whole of it."""
    texts = []
    for i in range(40):
        shared = prose(100 + i, 50)
        part = shared.split(" ")[:49]
        texts += [" ".join(part + [prose(200 + i, 30), shared, prose(400 + i, 5)])]
        texts += [" ".join([prose(500 + i, 15), shared, prose(600 + i, 25)])]
    got = ends_of(s.passages(documents(spark, texts)).collect())
    assert got == {(2 * i + 1, 2 * i + 2) for i in range(40)}


def shared(x, y, places, least=0.8):
    ids = {w: np.uint64(i + 1) for i, w in enumerate(sorted({*x, *y}))}
    a, b = (s.shingle_hashes(np.array([ids[w] for w in v], np.uint64), 5) for v in (x, y))
    found = s.shared_passages(a, b, np.array(places, np.int64), 5, 50, least)
    for a_from, a_to, b_from, b_to, similarity in found:
        u, v = ({tuple(t[k : k + 5]) for k in range(lo, hi - 4)} for t, lo, hi in ((x, a_from, a_to), (y, b_from, b_to)))
        assert min(a_to - a_from, b_to - b_from) >= 50 and abs(len(u & v) / len(u | v) - similarity) < 1e-12 and similarity >= least
    return [p[:4] for p in found]


def plain_own_keys(a, b, places, reach, size=4):
    theirs, own, out = list(s._run_hashes(a, size)), list(s._run_hashes(b, size)), set()
    for ca, cb, before, after in places:
        near = set(theirs[max(0, ca - reach) : ca + reach])
        for run in own[max(0, cb - before) : max(0, cb + after - size + 2)]:
            if run not in near:
                out.add((int(s.mix(np.array([run ^ b[cb]])).view(np.int64)[0]), cb, before, after))
    return out


def test_runs_that_the_first_text_lacks_for_many_pairs_at_once():
    r = np.random.default_rng(8)
    pairs = [(np.zeros(0, np.uint64), np.arange(9, dtype=np.uint64), np.zeros((0, 4), np.int64)), (np.arange(2, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.array([(1, 4, 4, 4), (0, 8, 8, 0)]))]
    for n in (1, 3, 4, 30, 200, 200):
        x = r.integers(1, 40, n).astype(np.uint64)
        y = np.concatenate([r.integers(1, 40, 6).astype(np.uint64), x])
        y[r.integers(0, len(y), 1 + n // 15)] = 77
        m = len(y)
        pairs.append((x, y, np.array([(r.integers(0, n), c, r.integers(0, min(c, 12) + 1), r.integers(0, min(m - 1 - c, 12) + 1)) for c in r.integers(0, m, 2 * n)])))
    got = collections.defaultdict(list)
    for columns in s._own_keys(pairs, 12):
        for pair, *row in zip(*(c.tolist() for c in columns)):
            got[pair].append(tuple(row))
    for i, (x, y, places) in enumerate(pairs):
        assert len(set(got[i])) == len(got[i]) and set(got[i]) == plain_own_keys(x, y, places.tolist(), 12), i


def test_an_equal_run_survives_a_grown_span_that_is_unlike():
    """Repeated sentences: nine in ten places are equal, yet the sets of the grown span are not similar enough."""
    refrain, tail = [f"r{i}" for i in range(10)] * 6, [f"t{i}" for i in range(10)]
    x, y = refrain + ["one"] + tail, refrain + ["two"] + tail
    assert shared(x, y, [(20, 20)]) == [(0, 60, 0, 60)]
    assert shared(["p"] + x, y, [(21, 20), (40, 39)]) == [(1, 61, 0, 60)]
    # Of the grown spans the longest similar one is given.
    plain = [f"p{i}" for i in range(80)]
    x, y = plain + ["one"] + refrain + ["one"] + tail, plain + ["two"] + refrain + ["two"] + tail
    (found,) = shared(x, y, [(10, 10)])
    assert found[0] == 0 and found[1] >= 141


def test_similarities_of_nested_spans():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = r.integers(0, 12, (2, 60)).astype(np.uint64)
        left, right, shift = np.sort(r.integers(5, 30, 6))[::-1], np.sort(r.integers(30, 55, 6)), int(r.integers(-4, 5))
        spans = np.stack([left, right], axis=1)
        sets = [(set(a[lo : hi + 1]), set(b[lo - shift : hi - shift + 1])) for lo, hi in spans]
        assert np.allclose(s._similarities(a, b, spans, shift), [len(x & y) / len(x | y) for x, y in sets])


def test_inserted_and_deleted_words():
    """The spans on neighbouring diagonals are put together; what is too unlike is left out."""
    x = [f"w{i}" for i in range(60)]
    assert shared(x, x[:30] + ["new"] + x[30:], [(3, 3)]) == [(0, 60, 0, 61)]
    assert shared(["p"] + x[:30] + ["new"] + x[30:], x, [(40, 38)]) == [(1, 62, 0, 60)]
    assert shared(x[:20] + x[21:], x, [(2, 2)]) == [(0, 59, 0, 60)]
    assert shared(x, x[:20] + ["new"] + x[20:40] + ["new"] + x[40:], [(2, 2)]) == []
    # An unlike end is not taken along.
    y = [f"y{i}" for i in range(50)]
    assert shared(x + ["one"] + y[:8], x + [f"z{i}" for i in range(9)] + y[:8], [(10, 10)]) == [(0, 60, 0, 60)]


def test_query_gives_both_sides(spark, tmp_path):
    text = prose(1, 60)
    documents(spark, [text + " " + prose(2, 5), prose(3, 9) + " " + text, "x", "x"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in s.op2_passages(spark, str(tmp_path)).select("doc_id", "other_doc_id", "kind", "start", "end").collect()}
    assert got == {(1, 2, "passage", 0, 60), (2, 1, "passage", 9, 69), (3, 4, "copy", None, None), (4, 3, "copy", None, None)}
