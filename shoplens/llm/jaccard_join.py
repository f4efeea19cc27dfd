"""N-gram Jaccard join over count vectors indexed in R-trees.

The shingles of a document are hashed into groups. The group counts are a point, and the summed coordinate minima of two
points bound the overlap of the two sets from above. Points that can have partners are dealt to blocks, each block is
an R-tree over the counts of 64 groups, and of the pairs found those whose bound on all groups reaches the needed overlap are
verified on the sets. Large sets have more groups: with many shingles a group, unrelated counts are nearly equal.

Dealing is exact: if two sets of a size class differ in at most d shingles, they agree in at least one of
d + 1 slices of the hash space, so both come under one key (slice, contents). Keys with one member are done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import components, document_words, mix, shared_folder, shingle_hashes, ship, stored, with_defaults

GROUPS = 64
_MOST = 4096
_FAN = 16


def _classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(size class, slices) under which a set of ``n`` shingles is filed: its own class, and the next one if a partner may lie there."""
    own = (n).bit_length() - 1
    out = []
    for c in (own, own + 1):
        largest = 2 ** (c + 1) - 1
        if c == own or n * 100 >= 2**c * percent:
            # Two sets of at most ``largest`` shingles with Jaccard >= percent differ in at most so many.
            union = (2 * largest * 100) // (100 + percent)
            out.append((c, (union * (100 - percent)) // 100 + 1))
    return out


def _signature(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the slices and the group counts of one sorted set.

    A partner differs from a set of n shingles in (100 - percent) * n / percent at most. A set with more non-empty slices than
    that agrees with every partner in one of these, so its empty slices, which unrelated sets have as well, get no key.
    """
    most = len(shingles) * (100 - percent) // percent
    keys = []
    for c, slices in _classes(len(shingles), percent):
        # A further scramble: slices and groups must not depend on one another.
        own = mix(shingles ^ np.uint64(0xA5A5A5A5 + c))
        at = ((own >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(slices, np.uint64)
        np.add.at(sums, at, mix(own))
        key = mix(sums + mix(np.arange(slices, dtype=np.uint64) + np.uint64(c << 40))).view(np.int64)
        full = np.bincount(at, minlength=slices) > 0
        keys.append(key[full] if full.sum() > most else key)
    return np.concatenate(keys), group_counts(shingles)


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles in each group, one byte a group: 64 groups or, for large sets, one for four to eight shingles, at most ``_MOST`` while bytes suffice.

    Groups are leading bits, so sums of neighbours are the counts of fewer groups.
    """
    bits = min(max(GROUPS, 1 << (max(len(shingles) // 4, 1).bit_length() - 1)), _MOST).bit_length() - 1
    while True:
        counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        bits += 1


def _folded(points: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer ``groups``, along the last axis."""
    return points.reshape(*points.shape[:-1], groups, -1).sum(axis=-1, dtype=np.int32)


def _points(counts: list[bytes]) -> np.ndarray:
    """One matrix of the members' counts, in as many groups as all have."""
    groups = min(map(len, counts))
    if all(len(c) == groups for c in counts):
        return np.frombuffer(b"".join(counts), np.uint8).reshape(-1, groups).astype(np.int32)
    return np.stack([_folded(np.frombuffer(c, np.uint8), groups) for c in counts])


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); letters A-Z in lower case, a null or wordless text has none."""
    for row, hashes in document_words(column, fold=True):
        yield row, np.unique(shingle_hashes(hashes, words))


def _marks(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit marks of a set; equal sets have equal marks."""
    a = np.add.reduce(mix(s ^ np.uint64(0x1234567))) if len(s) else np.uint64(0)
    b = np.add.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11))) if len(s) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, mark1, mark2, keys, counts`` for each row."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_shingles", "mark1", "mark2", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm import jaccard_join as j

        for batch in batches:
            n, one, two, keys, counts = [], [], [], [], []
            for _, s in j.shingle_sets(batch.column(1), words):
                a, b = j._marks(s)
                k, c = j._signature(s, percent) if len(s) else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
                n.append(len(s))
                one.append(a)
                two.append(b)
                keys.append(k)
                counts.append(c.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.binary())],
                names,
            )

    schema = "doc_id long, n_shingles long, mark1 long, mark2 long, keys array<long>, counts binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class CountTree:
    """An R-tree over count vectors, packed by sorting on the widest coordinates. Only box maxima bound an overlap."""

    def __init__(self, points: np.ndarray):
        self.order = self._pack(points, np.arange(len(points)))
        self.points = points[self.order]
        self.levels = []
        boxes = self.points
        while len(boxes) > 1:
            starts = np.arange(0, len(boxes), _FAN)
            boxes = np.maximum.reduceat(boxes, starts)
            self.levels.append(boxes)

    def _pack(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) <= _FAN:
            return at
        own = points[at]
        axis = int(own.var(axis=0).argmax())
        at = at[np.argsort(own[:, axis], kind="stable")]
        half = -(-len(at) // 2 // _FAN) * _FAN
        return np.concatenate([self._pack(points, at[:half]), self._pack(points, at[half:])])

    def search(self, point: np.ndarray, needed: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, bounds) of the points whose bound on the overlap with ``point`` reaches ``needed`` of their size."""
        nodes = np.zeros(1, np.int64) if self.levels else np.arange(len(self.points))
        # No partner is smaller than what ``point`` itself needs.
        least = needed(np.zeros(1))[0]
        for level in range(len(self.levels) - 1, -1, -1):
            bound = np.minimum(self.levels[level][nodes], point).sum(axis=1)
            nodes = nodes[bound >= least]
            nodes = (nodes[:, None] * _FAN + np.arange(_FAN)).ravel()
            size = len(self.levels[level - 1]) if level else len(self.points)
            nodes = nodes[nodes < size]
        own = self.points[nodes]
        bound = np.minimum(own, point).sum(axis=1)
        fits = bound >= needed(own.sum(axis=1))
        return self.order[nodes[fits]], bound[fits]


def _need(size: int, percent: int) -> Callable[[np.ndarray], np.ndarray]:
    """Overlap that a partner of a given size needs: inter / union >= percent / 100."""
    return lambda other: np.maximum(np.ceil(percent * (size + other) / (100 + percent)), np.ceil(size * percent / 100))


def _needs(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Overlaps that pairs of sizes need: inter / union >= percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def _bounds(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounds on the overlap of ``a[x]`` and ``b[y]`` on all groups, a bounded part at a time."""
    step = max(1, (1 << 21) // a.shape[1])
    return np.concatenate([np.zeros(0, np.int64), *[np.minimum(a[x[k : k + step]], b[y[k : k + step]]).sum(axis=1) for k in range(0, len(x), step)]])


def nearest_pairs(ids: np.ndarray, points: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """``(earlier, member, bound)``: for each member the member with a smaller id and the largest bound, if that reaches the needed overlap.

    All members walk the tree's leaves together: those whose bound with a leaf's box is too small are left out, the others
    meet the leaf's points.
    """
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    n = len(ids)
    if n == 2:
        bound, sizes = int(np.minimum(points[0], points[1]).sum()), points.sum(axis=1)
        return [(int(ids[0]), int(ids[1]), bound)] if bound >= _needs(sizes[0], sizes[1], percent) and ids[0] < ids[1] else []
    sizes, fine = points.sum(axis=1), points
    points = _folded(fine, GROUPS)
    tree = CountTree(points)
    best, at = np.full(n, -1), np.full(n, -1)
    least = -(-sizes * percent // 100)
    boxes = tree.levels[0] if tree.levels else points
    for k, box in enumerate(boxes):
        own = np.sort(tree.order[k * _FAN : (k + 1) * _FAN])
        q = np.flatnonzero(np.minimum(points, box).sum(axis=1) >= least)
        q = q[q > own[0]]
        if not len(q):
            continue
        bound = np.minimum(points[q][:, None, :], points[own][None, :, :]).sum(axis=2)
        needed = _needs(sizes[q][:, None], sizes[own][None, :], percent)
        fits = (bound >= needed) & (ids[own][None, :] < ids[q][:, None])
        if fine.shape[1] > GROUPS:
            x, y = np.nonzero(fits)
            bound[x, y] = _bounds(fine, fine, q[x], own[y])
            fits &= bound >= needed
        bound = np.where(fits, bound, -1)
        j = bound.argmax(axis=1)
        top, who = bound[np.arange(len(q)), j], own[j]
        better = (top > best[q]) | ((top == best[q]) & (top >= 0) & (who < at[q]))
        best[q[better]], at[q[better]] = top[better], who[better]
    found = np.flatnonzero(at >= 0)
    return [(int(ids[at[i]]), int(ids[i]), int(best[i])) for i in found]


def apart_pairs(left: tuple, right: tuple, percent: int) -> list[tuple[int, int, int]]:
    """``(a, b, bound)`` of all pairs of left and right members in different components whose bound reaches the needed overlap."""
    ids, fine, parts = left
    nodes, others_fine, theirs = right
    points, others = _folded(fine, GROUPS), _folded(others_fine, GROUPS)
    tree, out = CountTree(points), []
    sizes, needed = points.sum(axis=1), others.sum(axis=1)
    boxes = tree.levels[0] if tree.levels else points
    for k, box in enumerate(boxes):
        own = tree.order[k * _FAN : (k + 1) * _FAN]
        q = np.flatnonzero(np.minimum(others, box).sum(axis=1) >= -(-needed * percent // 100))
        if not len(q):
            continue
        bound = np.minimum(others[q][:, None, :], points[own][None, :, :]).sum(axis=2)
        fits = (bound >= _needs(needed[q][:, None], sizes[own][None, :], percent)) & (theirs[q][:, None] != parts[own][None, :])
        x, y = np.nonzero(fits)
        x, y, bound = q[x], own[y], bound[x, y]
        if fine.shape[1] > GROUPS:
            bound = _bounds(others_fine, fine, x, y)
            near = bound >= _needs(needed[x], sizes[y], percent)
            x, y, bound = x[near], y[near], bound[near]
        a, b = ids[y], nodes[x]
        out += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), bound.tolist())
    return out


def _runs(df: DataFrame, by: list[str], use: Callable[[dict[str, np.ndarray]], list[tuple[int, int, int]]]) -> DataFrame:
    """``(a, b, bound)`` from ``use`` on each run of rows that agree in ``by``; runs have bounded size."""
    df = df.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def done(part: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
            columns = {c: part[c].to_numpy() for c in part.columns if c != "counts"}
            counts, out = part["counts"].tolist(), []
            for lo, hi in zip(edges, edges[1:]):
                if hi - lo > 1:
                    out += use({c: v[lo:hi] for c, v in columns.items()} | {"counts": _points(counts[lo:hi])})
            return pd.DataFrame(out, columns=["a", "b", "bound"])

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[by].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            if len(edges) > 1:
                yield done(rest.iloc[: edges[-1]], edges)
                rest = rest.iloc[edges[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield done(rest, [0, len(rest)])

    return df.mapInPandas(run, "a long, b long, bound long")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, broadcast_rows: int) -> DataFrame:
    """The pairs whose sets meet the threshold exactly: 100 * intersection >= percent * union.

    Texts move, not sets: hashes do not compress. A node's marks tell its text where rows share an id.
    """
    wanted = stored(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    texts = docs.join(wanted, "doc_id", "left_semi")
    marks = nodes.select(F.col("node").alias("doc_id"), "mark1", "mark2").join(wanted, "doc_id", "left_semi")
    side = lambda df, c: df.select(*[F.col(x).alias(c if x == "doc_id" else f"{c}_{x}") for x in df.columns])
    marked = pairs.join(side(marks, "a"), "a").join(side(marks, "b"), "b")
    # Pairs of numbers go to the texts of one side, if they are few; so only the other side's texts are shuffled beside them.
    marked = F.broadcast(marked) if pairs.count() <= broadcast_rows else marked
    both = side(texts, "a").join(marked, "a").join(side(texts, "b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm import jaccard_join as j

        for batch in batches:
            marks = list(zip(*[batch.column(i).to_pylist() for i in range(2, 6)]))
            keep = []
            for (_, x), (_, y), m in zip(j.shingle_sets(batch.column(6), words), j.shingle_sets(batch.column(7), words), marks):
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and (*j._marks(x), *j._marks(y)) == m)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_mark1", "a_mark2", "b_mark1", "b_mark2", "a_text", "b_text").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90, block: int = 512, broadcast_keys: int = 2_000_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the size of its set and the smallest id reachable by links.

    Texts are read whole and lower-cased in A-Z only. Two documents link when 100 * intersection >= ``percent`` * union of their
    sets of ``words``-word shingles; no such link between different texts is lost.

    1. Equal sets become one node, the smallest id; a group of copies costs one row from here on.
    2. Nodes are filed under their slice keys. Keys with several members are buckets; buckets with the same members count once.
    3. A bucket is cut into blocks of about ``block`` members, each with the bucket's first member. In each block's R-tree a member
       looks for the earlier member with the largest bound. Of a member's pairs from all blocks the best one is verified; links are
       joined to components.
    4. Buckets whose members are now in one component are done. In all others every pair in different components is looked up
       through the R-trees, blocks against blocks, where members of the bucket's largest component are compared with the others only.

    Null, empty and wordless texts have an empty set and link with nothing. A row without an id has no component; rows that
    share an id but not a set are linked under that id if it is the smallest of both sets; each set keeps its own partners. Other columns are ignored. No rows give no rows.
    Sums are combined before shuffles; large buckets are cut by a hash, so no group meets in one task. Up to
    ``broadcast_keys`` shared keys or ids (8 bytes each) are broadcast, more are joined by a shuffle, with the same result.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    docs = with_defaults(docs, doc_id="long", text="string")
    signed = stored(signatures(docs, words, percent), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    sets = ["mark1", "mark2", "n_shingles"]
    classes = usable.groupBy(*sets).agg(F.min("doc_id").alias("node"))
    copies = stored(usable.select("doc_id", *sets).join(classes, sets).where("doc_id <> node").select("doc_id", *sets).distinct(), "copies")
    firsts = usable.join(F.broadcast(copies) if copies.count() <= broadcast_keys else copies, ["doc_id", *sets], "left_anti")
    nodes = firsts.select(F.col("doc_id").alias("node"), *sets, "counts").dropDuplicates(["node", *sets])
    filed = firsts.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    # Nearly all keys have one member; only those of several are looked up again.
    several = filed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    several = stored(several, "several")
    held = stored(filed.join(F.broadcast(several) if several.count() <= broadcast_keys else several, "key").distinct(), "held")
    buckets = held.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), F.min("node").alias("pivot"))
    buckets = buckets.groupBy("n", "members", "pivot").agg(F.min("key").alias("key"))
    members = held.join(buckets.select("key", "n", "pivot"), "key")
    # An id with several sets is a member with the counts of each.
    members = stored(members.join(nodes.select("node", "counts").distinct(), "node").select("key", "n", "pivot", "node", "counts"), "members")

    blocks = F.ceil(F.col("n") / block).cast("int")
    # The pivot is in every block, so that blocks of one bucket meet.
    own = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node", "key"), blocks).cast("int"))
    )
    dealt = members.select("key", F.explode(own).alias("block"), "node", "counts")
    pairs = _runs(dealt, ["key", "block"], lambda g: nearest_pairs(g["node"], g["counts"], percent))
    best = stored(pairs.groupBy("b").agg(F.max_by("a", F.struct("bound", -F.col("a"))).alias("a")).select("a", "b"), "best")
    links = stored(verify(best, nodes, docs, words, percent, broadcast_keys), "links")
    found = components(links)

    parted = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per_part = parted.groupBy("key", "component").agg(F.count("*").alias("size"))
    open_ = per_part.groupBy("key").agg(F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("big")).where("all > big.size")
    open_ = open_.select("key", "all", F.col("big.component").alias("big"), F.col("big.size").alias("size"))
    parted = stored(parted.join(open_, "key"), "open")
    left_blocks, right_blocks = F.ceil(F.col("all") / block).cast("int"), F.ceil((F.col("all") - F.col("size")) / block).cast("int")
    spot = lambda of, salt: F.pmod(F.xxhash64("node", F.lit(salt)), of).cast("int")
    keep = ["key", "node", "component", "counts"]
    left = parted.select(*keep, F.lit(0).alias("side"), spot(left_blocks, 1).alias("i"), F.explode(F.sequence(F.lit(0), right_blocks - 1)).alias("j"))
    right = parted.where("component != big").select(*keep, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), left_blocks - 1)).alias("i"), spot(right_blocks, 2).alias("j"))

    def compare(group: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
        side = group["side"]
        cut = lambda s: tuple(group[c][side == s] for c in ("node", "counts", "component"))
        return apart_pairs(cut(0), cut(1), percent) if 0 < side.sum() < len(side) else []

    apart = _runs(left.unionAll(right), ["key", "i", "j"], compare).select("a", "b").distinct()
    apart = stored(apart.join(best, ["a", "b"], "left_anti"), "apart")
    more = verify(apart, nodes, docs, words, percent, broadcast_keys)
    found = components(links.unionAll(more))

    named = classes.select("mark1", "mark2", F.col("n_shingles").alias("n"), "node").join(found, "node", "left")
    named = named.select("mark1", "mark2", "n", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "mark1", "mark2")
    on = (rows["mark1"] == named["mark1"]) & (rows["mark2"] == named["mark2"]) & (rows["n_shingles"] == named["n"]) & rows["doc_id"].isNotNull()
    return rows.join(named, on, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN [words[i : i + 2] FOR i IN range(1, len(words) - 1)] WHEN len(words) > 0 THEN [words] ELSE [] END) AS shingle
  FROM texts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT s.doc_id AS a, t.doc_id AS b
  FROM shingles s JOIN shingles t ON s.shingle = t.shingle AND s.doc_id <> t.doc_id JOIN sizes x ON x.doc_id = s.doc_id JOIN sizes y ON y.doc_id = t.doc_id
  GROUP BY s.doc_id, t.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id
GROUP BY d.doc_id
"""
