"""Conversations as a trie of shared prefixes: double arrays per shard, shared nodes merged over all shards.

A conversation is cut into segments of a few turns. A segment starts at a node, the prefix of the turns before it, which is known by two
64-bit hashes. Equal segments are counted first. The distinct ones are sorted by start and turns and dealt in contiguous ranges, so
a shard holds neighbouring prefixes and a prefix that many share is cut between shards. Each shard packs its segments into BASE and
CHECK arrays over dense turn numbers and walks them for its nodes; nodes that several shards know are added up at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import ship, stored, with_defaults
from shoplens.plans import running_sum

LEVELS = 16  # turns of a segment
SHARD = 4096  # segments packed at once
_FREE = -1


class DoubleArray:
    """A trie over rows of numbers: the child of state s by code c is ``base[s] + c``, if ``check`` there is s.

    ``codes`` holds a row a path, filled with -1 behind its end. State 0 is the root. A state's children are placed together at the
    first base where all their cells are free.
    """

    def __init__(self, codes: np.ndarray):
        self.size = 1
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, _FREE, np.int64)
        self.check[0] = 0  # the root's own cell
        self._low = 1  # no cell below is free
        states = np.zeros(len(codes), np.int64)
        alive = np.arange(len(codes))
        for level in range(codes.shape[1]):
            alive = alive[codes[alive, level] >= 0]
            if not len(alive):
                break
            at, code = states[alive], codes[alive, level]
            pairs = np.unique(np.stack([at, code]), axis=1)
            cuts = np.flatnonzero(np.diff(pairs[0])) + 1
            for parent, own in zip(pairs[0][np.concatenate([[0], cuts])], np.split(pairs[1], cuts)):
                self._place(int(parent), own)
            states[alive] = self.base[at] + code

    def _room(self, size: int) -> None:
        if size > len(self.check):
            grown = max(size, 2 * len(self.check))
            self.base = np.concatenate([self.base, np.zeros(grown - len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(grown - len(self.check), _FREE, np.int64)])

    def _place(self, parent: int, own: np.ndarray) -> None:
        span = own - own[0]
        lo = self._low
        while True:
            self._room(lo + 1024 + int(span[-1]) + 1)
            found = lo + np.flatnonzero(self.check[lo : lo + 1024] == _FREE)
            for step in span[1:]:
                found = found[self.check[found + step] == _FREE]
                if not len(found):
                    break
            if len(found):
                break
            lo += 1024
        first = int(found[0])
        cells = first + span
        self.base[parent] = first - int(own[0])
        self.check[cells] = parent
        self.size = max(self.size, int(cells[-1]) + 1)
        while self._low < len(self.check) and self.check[self._low] != _FREE:
            self._low += 1

    def walk(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``codes``; -1 where there is none."""
        to = self.base[states] + codes
        inside = (codes >= 0) & (to > 0) & (to < self.size)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def dense(turns: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct values of each path's turns, level by level, so that a state's children get neighbouring ones."""
    flat = turns.T.ravel()
    _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return number[inverse].reshape(turns.shape[::-1]).T


NODES = "depth long, p1 long, p2 long, parent1 long, parent2 long, bytes long, n long, least long"


def _shard_nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes of one shard. Segments that start at different nodes hang below different children of the array's root."""
    n = batch.num_rows
    turns = batch.column("turns")
    sizes = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = turns.flatten()
    row = np.repeat(np.arange(n), sizes)
    level = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + 1
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    keys = np.zeros((n, 1 + int(sizes.max(initial=0))), pair)
    for name, head, turn in (("a", "start1", "t1"), ("b", "start2", "t2")):
        keys[name][:, 0] = batch.column(head).to_numpy()
        keys[name][row, level] = flat.field(turn).to_numpy()
    codes = dense(keys)
    codes[np.arange(codes.shape[1])[None, :] > sizes[:, None]] = -1
    trie = DoubleArray(codes)
    count, least = np.zeros(trie.size, np.int64), np.full(trie.size, np.iinfo(np.int64).max)
    fields = {k: np.zeros(trie.size, np.int64) for k in ("depth", "p1", "p2", "parent1", "parent2", "bytes")}
    salted = [np.zeros((n, codes.shape[1]), np.int64) for _ in range(3)]
    for grid, name in zip(salted, ("s1", "s2", "bytes")):
        grid[row, level] = flat.field(name).to_numpy()
    own_n, own_least = batch.column("n").to_numpy(), batch.column("least").to_numpy()
    first, second = batch.column("start1").to_numpy().copy(), batch.column("start2").to_numpy().copy()
    start = batch.column("start").to_numpy()
    alive = np.arange(n)
    states = trie.walk(np.zeros(n, np.int64), codes[:, 0])
    for j in range(1, codes.shape[1]):
        alive = alive[sizes[alive] >= j]
        to = trie.walk(states[alive], codes[alive, j])
        states[alive] = to
        np.add.at(count, to, own_n[alive])
        np.minimum.at(least, to, own_least[alive])
        fields["depth"][to] = start[alive] + j
        fields["parent1"][to], fields["parent2"][to] = first[alive], second[alive]
        first[alive] ^= salted[0][alive, j]
        second[alive] ^= salted[1][alive, j]
        fields["p1"][to], fields["p2"][to] = first[alive], second[alive]
        fields["bytes"][to] = salted[2][alive, j]
    at = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(fields[k][at]) for k in ("depth", "p1", "p2", "parent1", "parent2", "bytes")], pa.array(count[at]), pa.array(least[at])],
        ["depth", "p1", "p2", "parent1", "parent2", "bytes", "n", "least"],
    )


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, bytes): the turns of each conversation from 1, by ``turn`` with nulls first.

    Turns with one number go by the hash of role and text. Null role or text is empty. Rows without a conv_id belong to no conversation
    and are left out. Only hashes and lengths leave the scan; equal rows are counted before they are ordered. A conversation may have any
    number of turns: no task holds a whole one.
    """
    rows = with_defaults(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    what = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    rows = rows.select(
        "conv_id", "turn", F.xxhash64(F.lit(1), *what).alias("t1"), F.xxhash64(F.lit(2), *reversed(what)).alias("t2"), F.octet_length(what[1]).cast("long").alias("bytes")
    )
    rows = rows.groupBy("conv_id", "turn", "t1", "t2", "bytes").agg(F.count("*").alias("n"))
    rows = running_sum(rows, ["conv_id"], [F.asc_nulls_first("turn"), "t1", "t2"], "n", "upto")
    pos = F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto")))
    return rows.select("conv_id", pos.alias("pos"), "t1", "t2", "bytes")


def branched(turns: DataFrame, every: int = 5, spread: int = 9) -> DataFrame:
    """Rebuild each conversation c: the first h turns of conversation c - c % ``every``, then c's own turns after its first h.

    h is crc32 of c's decimal digits modulo ``spread``. Of a base at most ``spread`` - 1 turns are looked at, and as many copies are
    made as there are conversations of its group, at most ``every`` (or twice that around 0).
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % every
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    heads = turns.where(F.col("pos") < spread).withColumnRenamed("conv_id", "base")
    bases = heads.groupBy("base").agg(F.max("pos").alias("head"))
    todo = lengths.select("conv_id", h.alias("h"), base.alias("base"))
    first = todo.join(heads, "base").where("pos <= h").select("conv_id", "pos", "t1", "t2", "bytes")
    shift = todo.join(bases, "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("head", F.lit(0))) - F.col("h")).alias("shift"))
    rest = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "t1", "t2", "bytes")
    return first.unionAll(rest)


def segments(turns: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(conv_id, band, start1, start2, end1, end2, turns): runs of ``levels`` turns with the hashes of the prefixes before and after.

    A prefix's hash is the exclusive or of its turns' hashes, each taken together with its place.
    """
    salted = turns.select(
        "conv_id", "pos", "t1", "t2", F.xxhash64("pos", "t1", "t2").alias("s1"), F.xxhash64("t2", "t1", "pos").alias("s2"), "bytes"
    )
    runs = salted.groupBy("conv_id", F.floor((F.col("pos") - 1) / levels).alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "s1", "s2", "bytes"))).alias("turns"), F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2")
    )
    runs = stored(runs, "runs")
    # A band's start is all bands before it. Conversations of one band, nearly all of them, need no order.
    long = runs.where("band > 0").select("conv_id").distinct()
    single = runs.join(long, "conv_id", "left_anti").select("conv_id", "band", "turns", F.lit(0).cast("long").alias("start1"), F.lit(0).cast("long").alias("start2"), F.col("x1").alias("end1"), F.col("x2").alias("end2"))
    several = running_xor(runs.join(long, "conv_id", "left_semi"))
    return single.unionByName(several.select(*single.columns))


def running_xor(runs: DataFrame, block: int = 1 << 14) -> DataFrame:
    """Adds the prefix hashes at both ends of each run. A window holds ``block`` runs, a second one a row for each block of a conversation."""
    blocks = runs.withColumn("block", F.floor(F.col("band") / block))
    inside = Window.partitionBy("conv_id", "block").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    totals = blocks.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    rows = blocks.select("*", *[F.bit_xor(f"x{i}").over(inside).alias(f"r{i}") for i in (1, 2)]).join(offsets, ["conv_id", "block"])
    ends = rows.select("*", *[F.col(f"r{i}").bitwiseXOR(F.col(f"o{i}")).alias(f"end{i}") for i in (1, 2)])
    return ends.select("*", *[F.col(f"end{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"start{i}") for i in (1, 2)])


def shard_nodes(segs: DataFrame, levels: int = LEVELS, shard: int = SHARD) -> DataFrame:
    """The nodes of all segments as ``NODES``, once for each shard that knows them.

    ``parent1`` and ``parent2`` are the hashes of the prefix without the last turn, ``n`` counts conversations, ``least`` is the smallest.
    """
    ship(segs.sparkSession)
    keys = ["band", "start1", "start2", "turns"]
    distinct = segs.groupBy(*keys).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    dealt = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("start", F.col("band") * levels)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm.prefix_trie import _shard_nodes

        for batch in batches:
            for lo in range(0, batch.num_rows, shard):
                yield _shard_nodes(batch.slice(lo, shard))

    return dealt.mapInArrow(pack, NODES)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, sha): of the ids that end at a node, in ascending order. A hash is taken in order, so a node's ids pass through
    one task, but as a stream: nothing is gathered."""
    key = ["depth", "p1", "p2"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def flush(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*key, "sha"])

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            cut = np.ones(batch.num_rows, bool)
            cut[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(cut)[1:]):
                if not len(part):
                    continue
                own = tuple(int(c[part[0]]) for c in columns[:3])
                ids = ",".join(map(str, columns[3][part].tolist())).encode()
                if own == now:
                    state.update(b"," + ids)
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = own, hashlib.sha256(ids)
            if len(out) > 10_000:
                yield flush(out)
                out = []
        if now is not None:
            out.append((*now, state.hexdigest()))
        yield flush(out)

    return ends.repartition(*key).sortWithinPartitions(*key, "conv_id").select(*key, "conv_id").mapInArrow(digest, "depth long, p1 long, p2 long, sha string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (conv_id, depth, parent_conv_id, ...) with each of ``values`` summed over the subtree.

    A node is known by its smallest member and its depth. In each round every node's sum reaches the ancestor 1, 2, 4, ... levels up, so
    the rounds grow with the logarithm of the depth. Sums are combined on the map side before they meet the ancestor.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    rows = nodes.withColumn("_up", F.col("parent_conv_id"))
    step = 1
    while step <= deepest:
        sums = rows.where(F.col("depth") >= step).groupBy(F.col("_up").alias("conv_id"), (F.col("depth") - step).alias("depth"))
        sums = sums.agg(*[F.sum(v).alias(f"_{v}") for v in values])
        to = rows.select(F.col("conv_id").alias("_up"), (F.col("depth") + step).alias("depth"), F.col("_up").alias("_next")).where(F.col("depth") >= 2 * step)
        ahead = rows.where(F.col("depth") >= 2 * step).join(to, ["_up", "depth"]).drop("_up").withColumnRenamed("_next", "_up")
        near = rows.where(F.col("depth") < 2 * step).withColumn("_up", F.lit(None).cast("long"))
        rows = ahead.unionByName(near).join(sums, ["conv_id", "depth"], "left")
        added = {v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}
        rows = stored(rows.withColumns(added).drop(*[f"_{v}" for v in values]), "sums")
        step *= 2
    return rows.drop("_up")


def trie(turns: DataFrame, members: DataFrame, levels: int = LEVELS, shard: int = SHARD) -> DataFrame:
    """All nodes of the trie over ``turns`` (conv_id, pos from 1 without gaps, t1, t2, bytes).

    ``members`` lists the conv_ids, each once; those without turns end at the root. Columns: conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree,
    the bytes of a node's last text for every member but one) and ends_sha256 (of the members that end at the node).
    No conversation: no row.
    """
    segs = stored(segments(turns, levels), "segments")
    key = ["depth", "p1", "p2"]
    whole = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).where("n > 0")
    nothing = F.lit(0).cast("long")
    root = whole.select(nothing.alias("depth"), nothing.alias("p1"), nothing.alias("p2"), F.lit(None).cast("long").alias("parent1"), F.lit(None).cast("long").alias("parent2"), nothing.alias("bytes"), "n", "least")
    merged = shard_nodes(segs, levels, shard).groupBy(*key, "parent1", "parent2", "bytes").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    nodes = stored(merged.unionByName(root), "nodes")

    last = segs.groupBy("conv_id").agg(F.max(F.struct((F.col("band") * levels + F.size("turns")).alias("depth"), F.col("end1").alias("p1"), F.col("end2").alias("p2"))).alias("at"))
    ends = members.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"at.{c}"), nothing).alias(c) for c in key])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("parent1"), F.col("p2").alias("parent2"), F.col("least").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("p1"), F.col("parent2").alias("p2")).agg(F.count("*").alias("n_children"))
    linked = (
        nodes.join(parents, ["depth", "parent1", "parent2"], "left").join(children, key, "left").join(end_digests(ends), key, "left")
        .select(
            F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", nothing).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved_tokens"),
            F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
    return subtree_sums(stored(linked, "linked"), ["n_leaves", "saved_tokens"])


def op11_prefixes(spark, sf_dir: str) -> DataFrame:
    turns = stored(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie(branched(turns), turns.select("conv_id").distinct())


_CRC = "xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, b) END, 4294967295::BIGINT), 4294967295)"

OP11_SQL = f"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
built AS (
    SELECT i.conv_id, 0 AS piece, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base WHERE o.pos <= i.h
    UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id WHERE o.pos > i.h),
paths AS (
    SELECT conv_id, count(*) OVER w AS depth, list({{'r': role, 't': text}}) OVER w AS path, strlen(text) AS bytes FROM built
    WINDOW w AS (PARTITION BY conv_id ORDER BY piece, pos)
    UNION ALL SELECT conv_id, 0, [], 0 FROM ids),
sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY conv_id),
nodes AS (
    SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends_sha256
    FROM paths JOIN sizes USING (conv_id) GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
below AS (
    SELECT a.depth, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes) b JOIN full_nodes a ON a.depth = b.up AND a.path = b.path[:b.up] GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.depth = n.depth AND b.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
"""
