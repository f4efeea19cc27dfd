"""Near-duplicate passages by compact windows.

A text is its sequence of shingles (runs of words). For one hash function, the subsequences whose smallest shingle hash is
that of place c are those that begin in [l, c] and end in [c, r]: a compact window, one node of the Cartesian tree
over the hashes. Windows of at least a passage's length stand for all long subsequences; two texts that share a passage
have windows with equal smallest hashes around it, for most of several hash functions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import document_words, mix, shared_folder, shingle_hashes, ship, stored, text_slices, with_defaults, word_hashes

COLUMNS = ("node", "key", "l", "c", "r", "left", "right")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.random.default_rng(91).integers(1, 2**63, 64, dtype=np.uint64)


def compact_windows(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Rows ``(span, l, c, r)``, ends inclusive: the Cartesian trees' nodes with at least ``width`` places, for all spans lo..hi of ``h``.

    Trees are walked from their roots, all spans at once; each node cuts its span at the smallest hash (of equal ones
    the first). Smallest places come from a sparse table, and narrow subtrees are never touched.
    """
    own = np.flatnonzero(hi - lo >= width)
    if not len(own):
        return np.zeros((0, 4), np.int64)
    lo, hi = lo[own].astype(np.int64), hi[own].astype(np.int64)
    n, longest = len(h), int((hi - lo).max())
    level = np.frexp(np.arange(longest + 1, dtype=float))[1].astype(np.int64) - 1  # by a span's length
    rows = np.empty((int(level[-1]) + 1, n), np.int32)
    rows[0], smallest = np.arange(n, dtype=np.int32), h
    for k in range(1, len(rows)):  # for spans of 2, 4, 8 ... places
        step, there = 1 << (k - 1), n - (1 << k) + 1
        a, b = smallest[:there], smallest[step : step + there]
        rows[k, :there] = np.where(b < a, rows[k - 1, step : step + there], rows[k - 1, :there])
        smallest = np.minimum(a, b)
    # All levels in one table: a text of repeats makes a deep tree, whose many levels hold few nodes.
    flat, begin = rows.ravel(), level * n
    end = begin - (1 << np.maximum(level, 0))
    out = []
    while len(lo):
        size = hi - lo
        a, b = flat[begin[size] + lo], flat[end[size] + hi]
        c = np.where(h[b] < h[a], b, a).astype(np.int64)
        out.append((own, lo, c, hi))
        own, lo, hi = np.concatenate([own, own]), np.concatenate([lo, c + 1]), np.concatenate([c, hi])
        wide = np.flatnonzero(hi - lo >= width)
        own, lo, hi = own[wide], lo[wide], hi[wide]
    own, lo, c, hi = (np.concatenate(x) for x in zip(*out))
    return np.stack([own, lo, c, hi - 1], axis=1)


def _run_hashes(s: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values, by prefix sums."""
    up = np.full(len(s) + 1, _PRIME, np.uint64)
    down = np.full(len(s) + 1, np.uint64(pow(int(_PRIME), -1, 2**64)), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s) * up[:-1])])
    return mix((sums[size:] - sums[:-size]) * down[: len(s) - size + 1]) if len(s) >= size else np.zeros(0, np.uint64)


def _segments(lo: np.ndarray, hi: np.ndarray, size: int = 1 << 19, overlap: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans cut to at most ``size`` places, each with ``overlap`` of the one before, and the spans' numbers: keeps tables bounded."""
    if not len(lo) or (hi - lo).max() <= size:
        return np.arange(len(lo)), lo, hi
    own, a, b = [], [], []
    for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist())):
        while True:
            own.append(i)
            a.append(x)
            b.append(min(y, x + size))
            if x + size >= y:
                break
            x += size - overlap
    return np.array(own), np.array(a), np.array(b)


def text_windows(data: np.ndarray, offsets: np.ndarray, words: int, passage: int, hashes: int) -> np.ndarray:
    """Rows ``(text, key, l, c, r, left, right)`` of all texts of a slice; places are shingles from the text's start.

    ``key`` is the smallest hash, with the number of its function in the low three bits. ``left`` and ``right`` are hashes of the
    quarter passage of shingles that ends, or begins, at c; 0 where the text is too short for it.
    """
    starts, _, found = word_hashes(data, np.unique(offsets[:-1][offsets[:-1] < len(data)]), False)
    width = passage - words + 1
    side = -(-width // 4)
    if len(found) < passage:
        return np.zeros((0, 7), np.int64)
    bounds = np.searchsorted(starts, offsets)
    shingles = shingle_hashes(found, words)
    first, last = bounds[:-1], np.maximum(bounds[1:] - words + 1, bounds[:-1])
    own, lo, hi = _segments(first, last)
    runs = _run_hashes(shingles, side)
    out = []
    for k in range(hashes):
        h = mix(shingles ^ _SALTS[k])
        w = compact_windows(h, lo, hi, width)
        text, c = own[w[:, 0]], w[:, 2]
        right = np.where(c + side <= last[text], runs[np.minimum(c, len(runs) - 1)] | np.uint64(1), np.uint64(0))
        left = np.where(c - side + 1 >= first[text], runs[np.maximum(c - side + 1, 0).clip(0, len(runs) - 1)] | np.uint64(1), np.uint64(0))
        key = (h[c] & ~np.uint64(7)) | np.uint64(k)
        begin = first[text]
        out.append(
            np.stack(
                [text, key.view(np.int64), w[:, 1] - begin, c - begin, w[:, 3] - begin, (left >> np.uint64(33)).astype(np.int64), (right >> np.uint64(33)).astype(np.int64)],
                axis=1,
            )
        )
    return np.concatenate(out)


def windows(docs: DataFrame, words: int, passage: int, hashes: int) -> DataFrame:
    """``node, key, l, c, r, left, right`` of the compact windows of each text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm import substring_dedup as s

        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in s.text_slices(batch.column(1), 1 << 20):
                w = s.text_windows(data, offsets, words, passage, hashes)
                for lo in range(0, len(w), 100_000):
                    part = w[lo : lo + 100_000]
                    columns = [ids[row + part[:, 0]], *part[:, 1:].T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), k) for x, k in zip(columns, kinds)], list(COLUMNS))

    return docs.select("node", "text").mapInArrow(run, "node long, key long, l int, c int, r int, left int, right int")


def shared_passages(a: np.ndarray, b: np.ndarray, windows: np.ndarray, words: int, passage: int, least: float) -> list[tuple[int, int, int, int, float]]:
    """``(a_from, a_to, b_from, b_to, similarity)`` in words of the passages that two texts share around their common windows.

    ``a``, ``b`` are shingle hashes; ``windows`` rows are the places of a common shingle in a and b. Those on the same diagonal (the
    difference of their places) are followed along it: equal shingles are joined over gaps, and of the spans grown so the longest counts whose
    shingle sets are similar enough; the equal run itself always is. From there equal runs on neighbouring diagonals are added, as
    inserted and deleted words ask for, while the sets stay similar enough. A place of b that lies in a passage already found is not looked up again, so a passage repeated in
    both texts is not given for every pairing. A passage counts from ``passage`` words in both texts. Similarity is the Jaccard
    similarity of the two spans' shingle sets, computed exactly.
    """
    out, last = [], None
    held = np.zeros(len(b), bool)  # places of b in a passage already found
    windows = windows[np.lexsort((windows[:, 0], windows[:, 0] - windows[:, 1]))]
    for ca, cb in windows.tolist():
        shift = ca - cb
        if shift != last:
            last, covered, starts = shift, -1, None
        if ca <= covered or held[cb]:
            continue
        if starts is None:
            starts, ends = _diagonal(a, b, shift)
        spans = np.array(_grow(starts, ends, ca))
        similar = _similarities(a, b, spans, shift) if len(spans) > 1 else np.ones(1)
        k = int(np.flatnonzero(similar >= least)[-1])
        start, end = spans[k].tolist()
        covered = end  # places before the span are of earlier windows
        found = (start, end, start - shift, end - shift)
        chain = _chain(a, b, found, words + passage // 5, least - 0.1)
        if len(chain):
            near = _nested_similarities(a, b, chain)
            fit = np.flatnonzero((near >= least) & (np.minimum(chain[:, 1] - chain[:, 0], chain[:, 3] - chain[:, 2]) + words >= passage))
            if len(fit):
                found, similar = tuple(chain[fit[-1]].tolist()), near[fit]
                k = -1
        if min(found[1] - found[0], found[3] - found[2]) + words >= passage:
            out.append((found[0], found[1] + words, found[2], found[3] + words, float(similar[k])))
            held[found[2] : found[3] + 1] = True
    return out


def _equal_length(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal values at the beginning of both."""
    n, at, size = min(len(a), len(b)), 0, 256
    while at < n:
        off = a[at : min(at + size, n)] != b[at : min(at + size, n)]
        k = int(off.argmax())
        if off[k]:
            return at + k
        at, size = at + size, 2 * size
    return n


@lru_cache
def _nearest(rows: int, columns: int) -> np.ndarray:
    """All pairs of steps as flat places of a table, nearest first: by the longer of the two, then their difference."""
    x, y = np.indices((rows, columns))
    return np.argsort((np.maximum(x, y) * max(rows, columns) + np.abs(x - y)).ravel(), kind="stable")


def _next_run(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, int, int] | None:
    """Steps in a and b to the end of the nearest equal run that begins within ``reach`` places, and its length."""
    if not len(a) or not len(b):
        return None
    same = a[:reach, None] == b[None, :reach]
    order = _nearest(*same.shape)
    same = same.ravel()[order]
    first = int(same.argmax())
    if not same[first]:
        return None
    x, y = divmod(int(order[first]), min(len(b), reach))
    n = _equal_length(a[x:], b[y:])
    return x + n, y + n, n


def _chain(a: np.ndarray, b: np.ndarray, span: tuple[int, int, int, int], reach: int, least: float) -> np.ndarray:
    """Spans ``(a_lo, a_hi, b_lo, b_hi)``, ends inclusive, grown from ``span`` by an equal run each, on any diagonal, while ``least`` of the places are equal."""
    a_lo, a_hi, b_lo, b_hi = span
    equal, spans = a_hi - a_lo + 1, []
    after = lambda: _next_run(a[a_hi + 1 :], b[b_hi + 1 :], reach)
    before = lambda: _next_run(a[:a_lo][::-1], b[:b_lo][::-1], reach)
    right, left = after(), before()
    while right or left:
        size = max(a_hi - a_lo, b_hi - b_lo) + 1
        shares = [(equal + run[2]) / (size + max(run[:2])) if run else -1.0 for run in (right, left)]
        if max(shares) < least:
            break
        if shares[0] >= shares[1]:
            a_hi, b_hi, equal = a_hi + right[0], b_hi + right[1], equal + right[2]
            right = after()
        else:
            a_lo, b_lo, equal = a_lo - left[0], b_lo - left[1], equal + left[2]
            left = before()
        spans.append((a_lo, a_hi, b_lo, b_hi))
    return np.array(spans, np.int64).reshape(-1, 4)


def equal_runs(a: np.ndarray, b: np.ndarray, windows: np.ndarray, words: int, passage: int) -> list[tuple[int, int, int, int]]:
    """``(a_from, a_to, b_from, b_to)`` in words of the equal runs of ``passage`` words or more around the common windows."""
    out, last = set(), (None, -1)
    for shift, ca in sorted(zip((windows[:, 0] - windows[:, 1]).tolist(), windows[:, 0].tolist())):
        if shift == last[0] and ca < last[1]:
            continue
        end = ca + _equal_length(a[ca:], b[ca - shift :])
        start = ca - _equal_length(a[:ca][::-1], b[: ca - shift][::-1])
        last = shift, end
        if end - start + words - 1 >= passage:
            out.add((start, end + words - 1, start - shift, end - shift + words - 1))
    return sorted(out)


def _diagonal(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[list[int], list[int]]:
    """First and last places, in a, of the equal runs of a and b (there ``shift`` lower)."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    same = np.zeros(hi - lo + 2, bool)
    np.equal(a[lo:hi], b[lo - shift : hi - shift], out=same[1:-1])
    edge = np.flatnonzero(same[1:] != same[:-1]) + lo
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def _similarities(a: np.ndarray, b: np.ndarray, spans: np.ndarray, shift: int) -> np.ndarray:
    """Jaccard similarity of the shingle sets of a and b (there ``shift`` lower) in each of ``spans``, ends inclusive, each within the next."""
    return _nested_similarities(a, b, np.concatenate([spans, spans - shift], axis=1))


def _nested_similarities(a: np.ndarray, b: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each of ``spans (a_lo, a_hi, b_lo, b_hi)``, ends inclusive, each within the next."""
    a_lo, a_hi, b_lo, b_hi = spans[-1]

    def step(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first span that holds a place."""
        return np.maximum(np.searchsorted(-lo, -at), np.searchsorted(hi, at))

    values, own = np.unique(np.concatenate([a[a_lo : a_hi + 1], b[b_lo : b_hi + 1]]), return_inverse=True)
    sides = np.full((2, len(values)), len(spans))
    n = a_hi - a_lo + 1
    np.minimum.at(sides[0], own[:n], step(np.arange(a_lo, a_hi + 1), spans[:, 0], spans[:, 1]))
    np.minimum.at(sides[1], own[n:], step(np.arange(b_lo, b_hi + 1), spans[:, 2], spans[:, 3]))
    held = lambda first: np.cumsum(np.bincount(first, minlength=len(spans) + 1)[: len(spans)])
    return held(sides.max(axis=0)) / held(sides.min(axis=0))


def _grow(starts: list[int], ends: list[int], at: int, least: float = 0.9) -> list[tuple[int, int]]:
    """First and last places of the equal run around ``at``, and of each span grown from it by a further run while at least ``least`` of the places are equal."""
    i = bisect_right(starts, at) - 1
    left = right = i
    equal = ends[i] - starts[i] + 1
    spans = []
    while True:
        spans.append((starts[left], ends[right]))
        best = None
        if right + 1 < len(starts):
            more = equal + ends[right + 1] - starts[right + 1] + 1
            best = (more / (ends[right + 1] - starts[left] + 1), more, 1)
        if left > 0:
            more = equal + ends[left - 1] - starts[left - 1] + 1
            best = max(best or (0, 0, 0), (more / (ends[right] - starts[left - 1] + 1), more, -1))
        if best is None or best[0] < least:
            return spans
        equal = best[1]
        if best[2] > 0:
            right += 1
        else:
            left -= 1


def _own_keys(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], reach: int, size: int = 4) -> Iterator[tuple[np.ndarray, ...]]:
    """``(pair, key, cb, before, after)``, an array each: for the windows ``(ca, cb, before, after)`` of b each run of ``size`` shingles in them that is not near ``ca`` in a.

    ``pairs`` has the shingles of a and b and the windows. Keys are of the run and the common shingle. All pairs are looked up at once,
    a bounded number of windows at a time; only rows of one such part are sure to differ.
    """
    xs, ys, places = zip(*pairs)
    pair = np.repeat(np.arange(len(pairs)), [len(p) for p in places])
    windows = np.concatenate(places)
    x_size, y_size = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    x_first, y_first = np.cumsum(x_size) - x_size, np.cumsum(y_size) - y_size
    x_runs, y_runs = np.maximum(x_size - size + 1, 0), np.maximum(y_size - size + 1, 0)
    b = np.concatenate(ys)
    theirs, own = np.append(_run_hashes(np.concatenate(xs), size), np.uint64(0)), _run_hashes(b, size)
    values, rank = np.unique(theirs, return_inverse=True)
    n = len(theirs) + 1
    sorted_places = np.sort(rank * n + np.arange(len(theirs)))
    for at in range(0, len(windows), 4_000):
        p, (ca, cb, before, after) = pair[at : at + 4_000], windows[at : at + 4_000].T
        near, to = x_first[p] + np.minimum(np.maximum(ca - reach, 0), x_runs[p]), x_first[p] + np.minimum(ca + reach, x_runs[p])
        lo, hi = np.maximum(cb - before, 0), np.minimum(cb + after - size + 2, y_runs[p])
        count = np.maximum(hi - lo, 0)
        w = np.repeat(np.arange(len(p)), count)
        i = np.arange(len(w)) + np.repeat(y_first[p] + lo - np.cumsum(count) + count, count)
        # Most runs of near copies stand on the window's diagonal; only others are looked for.
        across = i + (x_first[p] + ca - y_first[p] - cb)[w]
        there = (across >= near[w]) & (across < to[w])
        other = ~(there & (theirs[np.where(there, across, 0)] == own[i]))
        w, i = w[other], i[other]
        value = np.minimum(np.searchsorted(values, own[i]), len(values) - 1)
        k = np.searchsorted(sorted_places, value * n + near[w])
        met = (values[value] == own[i]) & (k < len(theirs))
        met &= sorted_places[np.where(met, k, 0)] < value * n + to[w]
        w, i = w[~met], i[~met]
        if not len(w):
            continue
        key = mix(own[i] ^ b[(y_first[p] + cb)[w]]).view(np.int64)
        window = np.unique(np.stack([p, cb, before, after], axis=1), axis=0, return_inverse=True)[1].ravel()[w]
        order = np.lexsort((key, window))
        first = np.ones(len(order), bool)
        first[1:] = (key[order[1:]] != key[order[:-1]]) | (window[order[1:]] != window[order[:-1]])
        w, key = w[order[first]], key[order[first]]
        yield p[w], key, cb[w], before[w], after[w]


def _verify(pairs: DataFrame, texts: DataFrame, words: int, passage: int, least: float, broadcast_rows: int) -> DataFrame:
    """``row, a, b, a_from, a_to, b_from, b_to, similarity`` from ``a, b, windows`` and the texts of both.

    ``row`` 0 is a passage; 1 an equal run of ``passage`` words or more around the windows of a pair with a passage; 2 a key of b's own
    in a window whose group has more texts: ``b`` is the text, ``a`` the key and the others ``cb, before, after``.
    """
    ids = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    need = texts.join(_fits(stored(ids, "ids"), broadcast_rows), "node", "left_semi")
    side = lambda c: need.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "windows", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm import substring_dedup as s

        for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
            out, wanted, size = [], [], 0
            left = s.document_words(batch.column(3), False)
            right = s.document_words(batch.column(4), False)
            own, *places = s._flat(batch.column(2), ("ca", "cb", "before", "after", "more"))
            places, bounds = np.stack(places, axis=1), np.searchsorted(own, np.arange(batch.num_rows + 1))
            for row, ((_, x), (_, y)) in enumerate(zip(left, right)):
                found = places[bounds[row] : bounds[row + 1]]
                a, b = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                x, y = s.shingle_hashes(x, words), s.shingle_hashes(y, words)
                more, both_places = found[found[:, 4] > 0, :4], np.unique(found[:, 0] << 32 | found[:, 1])
                found = np.stack([both_places >> 32, both_places & 0xFFFFFFFF], axis=1)
                shared = s.shared_passages(x, y, found, words, passage, least)
                out += [(0, a, b, *p) for p in shared]
                if shared:
                    out += [(1, a, b, *p, None) for p in s.equal_runs(x, y, found, words, passage)]
                if len(more):
                    wanted.append((b, x, y, more))
                    size += len(x) + len(y)
                if size >= 50_000:
                    yield from keys(wanted)
                    wanted, size = [], 0
                if len(out) >= 20_000:
                    yield table(out)
                    out = []
            yield table(out)
            yield from keys(wanted)

    def keys(wanted: list[tuple]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm import substring_dedup as s

        texts = np.array([b for b, *_ in wanted], np.int64)
        for pair, *columns in s._own_keys([w[1:] for w in wanted], passage) if wanted else ():
            for lo in range(0, len(pair), 50_000):
                key, *place = [pa.array(c[lo : lo + 50_000], pa.int64()) for c in columns]
                kind, b = pa.array(np.full(len(key), 2)), pa.array(texts[pair[lo : lo + 50_000]])
                yield pa.RecordBatch.from_arrays([kind, key, b, *place, pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.float64())], names)

    names = ["row", "a", "b", "a_from", "a_to", "b_from", "b_to", "similarity"]

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.float64())], names)

    return both.mapInArrow(run, "row long, a long, b long, a_from long, a_to long, b_from long, b_to long, similarity double")


def _fits(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a stored table of a few numbers a row, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _links(rows: DataFrame, words: int, passage: int) -> DataFrame:
    """``a, b, ca, cb, before, after, function, met, more``: each place in a group of two texts or more next to the first place of its first (smallest) text.

    ``before`` and ``after`` are those of b. Further places of the first text itself have a = b. ``met`` tells whether the interval of places
    that both windows cover on their diagonal can hold a passage, ``more`` is 1 if the group has more than two places.
    """
    first = rows.groupBy("group").agg(
        F.min(F.struct("node", "c", "before", "after")).alias("first"), F.max("node").alias("most"), (F.count("*") > 2).cast("int").alias("more")
    )
    # Stored: straight above its shuffle an aggregate keeps adaptive execution from cutting a hot group.
    first = stored(first.where("first.node < most").drop("most"), "firsts")
    joined = rows.join(first, "group").where("node > first.node or c > first.c")
    reach = F.least("before", "first.before") + F.least("after", "first.after") + words
    return joined.select(
        F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.c").alias("ca"), F.col("c").alias("cb"), "before", "after", "function", (reach >= passage).alias("met"), "more"
    )


def _slice_runs(data: np.ndarray, offsets: np.ndarray, words: int, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``passage`` words at each word of a slice, and for each text its first run and the end of its last."""
    starts, _, found = word_hashes(data, np.unique(offsets[:-1][offsets[:-1] < len(data)]), False)
    bounds = np.searchsorted(starts, offsets)
    runs = _run_hashes(shingle_hashes(found, words), passage - words + 1) if len(found) >= passage else np.zeros(0, np.uint64)
    return runs, bounds[:-1], np.maximum(bounds[1:] - passage + 1, bounds[:-1])


def _flat(column: pa.Array, names: tuple[str, ...]) -> list[np.ndarray]:
    """Row number and fields of all structs in a column of lists; a null list is empty."""
    text = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = pc.list_flatten(column)
    return [text, *[pc.struct_field(rows, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]]


def _inside(begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the intervals, given from ``first`` of their texts and cut to ``first`` and ``last``; ends exclusive."""
    lo = np.clip(first + begin, first, last)
    hi = np.maximum(np.clip(first + end, first, last), lo)
    size = n + 1 + (int(hi.max()) if len(hi) else 0)
    steps = np.bincount(lo, minlength=size)[:size] - np.bincount(hi, minlength=size)[:size]
    return np.cumsum(steps)[:n] > 0


def _whole_keys(rows: DataFrame, done: DataFrame, texts: DataFrame, words: int, passage: int) -> DataFrame:
    """``group, node, c, before, after, function`` for every run of ``passage`` words that lies in a window of ``rows`` and holds its place ``c``.

    Groups are of all its words. Runs inside one of the intervals ``node, b_from, b_to`` of ``done`` are left out.
    """
    places = rows.groupBy("node").agg(F.collect_set(F.struct("c", "before", "after")).alias("places"))
    done = done.groupBy("node").agg(F.collect_set(F.struct("b_from", "b_to")).alias("done"))
    width = passage - words + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm import substring_dedup as s

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in s.text_slices(batch.column(1)):
                n = len(offsets) - 1
                runs, first, last = s._slice_runs(data, offsets, words, passage)
                text, c, before, after = s._flat(batch.column(2).slice(row, n), ("c", "before", "after"))
                begin = c - np.minimum(before, width - 1)
                wanted = s._inside(begin, c + np.minimum(0, after - width + 1) + 1, first[text], last[text], len(runs))
                text, begin, end = s._flat(batch.column(3).slice(row, n), ("b_from", "b_to"))
                wanted &= ~s._inside(begin, end - passage + 1, first[text], last[text], len(runs))
                at = np.flatnonzero(wanted)
                own = np.searchsorted(first, at, "right") - 1
                for lo in range(0, len(at), 100_000):
                    x, i = at[lo : lo + 100_000], own[lo : lo + 100_000]
                    columns = [pa.array(ids[row + i], pa.int64()), pa.array(runs[x].view(np.int64)), pa.array((x - first[i]).astype(np.int32))]
                    columns += [pa.array(np.full(len(x), v, np.int32)) for v in (0, width - 1, 0)]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "group", "c", "before", "after", "function"])

    both = texts.join(places, "node").join(done, "node", "left").select("node", "text", "places", "done")
    return both.mapInArrow(run, "node long, group long, c int, before int, after int, function int")


def passages(
    docs: DataFrame, words: int = 5, passage: int = 50, least: float = 0.8, hashes: int = 3, agreeing: int = 1, broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """``kind, a, b, a_from, a_to, b_from, b_to, similarity``: links between texts that share a passage, and copies.

    ``kind`` ``passage``: words ``a_from`` to ``a_to`` (end exclusive) of document a and ``b_from`` to ``b_to`` of b
    agree: at least ``passage`` words, and a Jaccard similarity of ``least`` or more of their ``words``-word shingles. ``kind``
    ``copy``: the text of b equals that of a, the smallest id with it; only a stands for it in passages.

    Windows with one smallest hash and, on one side of it, the same quarter passage are a group. (A shared passage covers at least
    half a passage on one side of each of its smallest shingles, and of two parts around a changed, inserted or deleted word the
    longer one a quarter on one side of each of its places.) A group is linked through its first text: the interval that a
    member's window and the first one's share must hold a passage, ``agreeing`` of the ``hashes`` functions must
    say so, and the texts are compared. A place is not done because its two texts are linked: all runs of ``passage`` words around
    the places of one function, those inside an equal run with a linked first text excepted, are then grouped by all their
    words. (Who shares an excepted run with the text shares it with that first text.) So equal passages of
    ``passage`` words are never lost. Near passages of two other members are looked for by what the first text lacks: every run of four
    shingles in a member's window that the first text does not have around its place is grouped with the same run of
    others around the same shingle, and these groups are linked through their own first texts; near ones are found if one function's smallest
    shingle has a quarter passage without a change on one side (measured in the README). A
    passage in a third of all documents costs one link a document; pairs of a group are never made.

    Texts are read whole. Null texts and those with fewer than ``passage`` words share no passage, but equal texts are copies, empty ones
    too. Rows without an id or text are left out; rows that share an id count as one document, the first of its texts in hash order. Other columns are
    ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    ship(spark)
    docs = with_defaults(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    marked = docs.select("doc_id", F.xxhash64("text").alias("m1"), F.crc32("text").alias("m2"), F.length("text").alias("m3"))
    one = marked.groupBy("doc_id").agg(F.min(F.struct("m1", "m2", "m3")).alias("m")).select("doc_id", "m.*")
    firsts = one.groupBy("m1", "m2", "m3").agg(F.min("doc_id").alias("node"))
    classes = stored(one.join(firsts, ["m1", "m2", "m3"]).select("doc_id", "node", "m1", "m2", "m3"), "classes")
    # One row a node, whatever the number of rows with its id; only the few others are looked for.
    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("m1"), F.crc32("text").alias("m2"), F.length("text").alias("m3"))
    same = ["doc_id", "m1", "m2", "m3"]
    others = marked.join(classes.where("doc_id = node").select(*same), same, "left_anti").distinct()
    others = _fits(stored(others, "others"), broadcast_rows)
    kept = kept.join(others, same, "left_anti").select(F.col("doc_id").alias("node"), "text")
    again = stored(marked.groupBy(*same).count().where("count > 1").select(F.col("doc_id").alias("node")).distinct(), "again")
    texts = kept
    if not again.isEmpty():
        again = _fits(again, broadcast_rows)
        texts = kept.join(again, "node", "left_anti").unionAll(kept.join(again, "node", "left_semi").dropDuplicates(["node"]))

    # Groups with one text are left behind here.
    found = stored(windows(texts, words, passage, hashes), "windows")
    shared = found.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    rest = stored(found.join(_fits(stored(shared, "keys"), broadcast_rows), "key"), "shared")
    beside = lambda side: F.when(F.col(side) != 0, F.xxhash64("key", F.lit(side), side))
    wide = F.lit(passage)
    rest = rest.select(
        F.explode(F.filter(F.array(beside("left"), beside("right")), lambda x: x.isNotNull())).alias("group"), "node", "c",
        F.least(F.col("c") - F.col("l"), wide).alias("before"), F.least(F.col("r") - F.col("c"), wide).alias("after"),
        F.col("key").bitwiseAND(7).cast("int").alias("function"),
    )
    links = []
    for turn in range(2):
        joined = stored(_links(rest, words, passage), f"joined_{turn}")
        pairs = joined.where("met and a < b").groupBy("a", "b").agg(
            F.collect_set(F.struct("ca", "cb", "before", "after", F.lit(0).alias("more") if turn else F.col("more"))).alias("windows"), F.countDistinct("function").alias("agree")
        )
        pairs = stored(pairs.where(F.col("agree") >= (1 if turn else agreeing)).select("a", "b", "windows"), f"both_places{turn}")
        verified = stored(_verify(pairs, texts, words, passage, least, broadcast_rows), f"verified_{turn}")
        links.append(verified.where("row = 0").drop("row"))
        if not turn:
            # One function is enough: its smallest shingle of an equal passage is a place of all texts that share it.
            left = joined.where("function = 0").select(F.col("b").alias("node"), F.col("cb").alias("c"), "before", "after").distinct()
            left = stored(left, "left")
            # Passages that members share, but not with the first text, hold runs that it has not. Equal rows (of windows in two
            # groups, or of two first texts) add nothing: what follows gathers least and greatest texts and sets.
            near = verified.where("row = 2").select(
                F.col("b").alias("node"), F.col("a").alias("group"), *[F.col(x).cast("int").alias(y) for x, y in (("a_from", "c"), ("a_to", "before"), ("b_from", "after"))], F.lit(0).alias("function")
            )
            if left.isEmpty() and near.isEmpty():
                break
            done = verified.where("row = 1").select(F.col("b").alias("node"), "b_from", "b_to")
            there = texts.join(_fits(stored(left.select("node").distinct(), "left_nodes"), broadcast_rows), "node", "left_semi")
            whole = stored(_whole_keys(left, done, there, words, passage), "whole").select(*near.columns).unionAll(near)
            shared = whole.groupBy("group").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("group")
            rest = whole.join(_fits(stored(shared, "whole_keys"), broadcast_rows), "group")
    out = links[0]
    for more in links[1:]:
        out = out.unionAll(more)
    copies = classes.where("doc_id <> node").select(
        F.lit("copy").alias("kind"), F.col("node").alias("a"), F.col("doc_id").alias("b"),
        *[F.lit(None).cast("long").alias(c) for c in ("a_from", "a_to", "b_from", "b_to")], F.lit(1.0).alias("similarity"),
    )
    return out.distinct().select(F.lit("passage").alias("kind"), "*").unionAll(copies)


def op2_passages(spark, sf_dir: str) -> DataFrame:
    """Each link from both sides: words ``start`` to ``end`` of ``doc_id`` are those from ``other_start`` to ``other_end`` of ``other_doc_id``."""
    links = passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = ("doc_id", "other_doc_id", "start", "end", "other_start", "other_end")
    sides = [F.struct(*[F.col(c).alias(n) for c, n in zip(order, names)]) for order in (("a", "b", "a_from", "a_to", "b_from", "b_to"), ("b", "a", "b_from", "b_to", "a_from", "a_to"))]
    return links.select("kind", "similarity", F.explode(F.array(*sides)).alias("side")).select("side.*", "kind", "similarity")
