"""Near-duplicate embeddings by a forest of random-projection trees with overlapping splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import components, shared_folder, ship, stored, with_defaults

_GRID = 49  # quantiles 0.02 to 0.98, the 25th being the median


def _directions(dim: int, trees: int, depth: int, seed: int) -> np.ndarray:
    """Unit vectors, one for each tree and level, the same in every task."""
    d = np.random.default_rng([seed, dim]).standard_normal((trees * depth, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def unit_rows(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    # Scaled first, so that squares neither overflow nor vanish.
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def link_block(leaf: int, group: pd.DataFrame, threshold: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(links counted here by vector, spanning links) of the left and right members of one leaf.

    A pair that shares several leaves is counted in the one with the smallest number only.
    """
    side = group["side"].to_numpy()
    left, right = group[side == 0], group[side == 1]
    inner = not len(right)
    right = left if inner else right
    a, b = unit_rows(left["embedding"].tolist()), unit_rows(right["embedding"].tolist())
    linked = a @ b.T >= threshold
    if inner:
        linked &= ~np.eye(len(a), dtype=bool)
    if not linked.any():
        return [], []
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    left, right, linked = left.iloc[rows], right.iloc[cols], linked[np.ix_(rows, cols)]
    earlier: dict[int, int] = {}
    for own in (*left["leaves"], *right["leaves"]):
        for k in own:
            if k < leaf:
                earlier.setdefault(int(k), len(earlier))
    counted = linked
    if earlier:
        def held(of):
            m = np.zeros((len(of), len(earlier)), np.float32)
            for i, own in enumerate(of):
                m[i, [earlier[int(k)] for k in own if k < leaf]] = 1
            return m

        counted = linked & (held(left["leaves"]) @ held(right["leaves"]).T == 0)
    left_ids, right_ids = left["uid"].to_numpy(), right["uid"].to_numpy()
    counts = list(zip(left_ids.tolist(), (counted @ right["copies"].to_numpy()).tolist()))
    if not inner:
        counts += zip(right_ids.tolist(), (left["copies"].to_numpy() @ counted).tolist())
    counts = [(u, n) for u, n in counts if n]
    # Smallest number reachable inside this block; a star to it keeps components with few rows.
    x, y = left_ids.copy(), right_ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        nx = np.minimum(x, np.where(linked, y, top).min(axis=1))
        ny = np.minimum(y, np.where(linked, nx[:, None], top).min(axis=0))
        if (nx == x).all() and (ny == y).all():
            break
        x, y = nx, ny
    edges = {(int(u), int(r)) for u, r in zip(np.concatenate([left_ids, right_ids]), np.concatenate([x, y])) if u != r}
    return counts, sorted(edges)


def near_embeddings(
    vectors: DataFrame, threshold: float = 0.93, trees: int = 4, depth: int = 32, leaf_rows: int = 512, spill: float = 0.5, seed: int = 5,
) -> DataFrame:
    """``vec_id, label, n_links, component_id`` per row of ``vec_id, embedding, label``.

    Vectors link if their labels are equal and not null, they have the same length and their cosine in double precision is
    at least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.

    Equal vectors of a label become one with a number of copies. Each tree splits a label's vectors at the median of a random
    projection, level by level, for all nodes at once; medians come from quantile sketches that are combined before the
    shuffle. Vectors within ``spill`` standard deviations of a just-linked pair's projected difference of the cut go both ways. A node stops
    at ``leaf_rows`` rows, or when two directions in turn fail to make both halves at most 0.8 of it, as for a large group of near
    copies, which must be compared in any case. Such a leaf is compared whole, in blocks against blocks of
    ``leaf_rows``: no cap drops a row, and no task holds more than two blocks. Within leaves, all pairs are compared and the links counted, each pair once over all
    trees; what leaves a task are counts and spanning links, never the pairs of a group.

    A linked pair is missed only if all trees part it; measured recall is in the README. Repeated rows are vectors of their
    own. A row without an id has a null component if it stands alone. No rows give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    shared_folder(spark)
    vectors = with_defaults(vectors, vec_id="long", embedding="array<double>", label="string")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.withColumn("valid", F.coalesce(valid, F.lit(False)))
    nodes = rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("uid", F.monotonically_increasing_id()), "vectors")

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["embedding"].map(len)
            for dim, own in batch.groupby(dims):
                p = unit_rows(own["embedding"].tolist()) @ _directions(int(dim), trees, depth, seed).T
                p = p.reshape(len(own) * trees, depth)
                yield pd.DataFrame(
                    {
                        "uid": np.repeat(own["uid"].to_numpy(), trees), "label": np.repeat(own["label"].to_numpy(), trees), "dim": int(dim),
                        "tree": np.tile(np.arange(trees), len(own)), "projections": list(p),
                    }
                )

    at = nodes.select("uid", "label", "embedding").mapInPandas(project, "uid long, label string, dim int, tree int, projections array<double>")
    at = at.withColumn("path", F.xxhash64("label", "dim", "tree")).withColumn("tries", F.lit(0))
    key = ["label", "dim", "tree", "path", "tries"]
    margin = F.lit(spill * float(np.sqrt(2 - 2 * threshold))) / F.sqrt(F.col("dim").cast("double"))
    grid = F.array(*[F.lit(i / (_GRID + 1)) for i in range(1, _GRID + 1)])
    leaves = []
    for level in range(depth + 1):
        at = stored(at, f"level_{level}")
        here = F.element_at("projections", level + 1) if level < depth else F.lit(0.0)
        cut = at.groupBy(*key).agg(F.count("*").alias("n"), F.percentile_approx(here, grid, 500).alias("q"))
        middle = F.element_at("q", _GRID // 2 + 1)
        part = lambda test: (F.size(F.filter("q", test)) + 1) / F.lit(float(_GRID + 1))
        cut = cut.withColumn("middle", middle).withColumn("margin", margin)
        larger = F.greatest(part(lambda x: x <= F.col("middle") + F.col("margin")), part(lambda x: x >= F.col("middle") - F.col("margin")))
        state = F.when((F.col("n") <= leaf_rows) | F.lit(level == depth), "leaf").when(larger <= 0.8, "split").when(F.col("tries") >= 1, "leaf").otherwise("wait")
        cut = cut.withColumn("state", state).select(*key, "n", "middle", "margin", "state")
        at = at.join(cut, key)
        leaves.append(at.where("state = 'leaf'").select("uid", F.col("path").alias("leaf"), "n"))
        more = at.where("state != 'leaf'").withColumn("here", here)
        if more.isEmpty():
            break
        split = F.col("state") == "split"
        sides = F.filter(
            F.array(
                F.when(~split, F.lit(0)), F.when(split & (F.col("here") <= F.col("middle") + F.col("margin")), F.lit(1)),
                F.when(split & (F.col("here") > F.col("middle") - F.col("margin")), F.lit(2)),
            ),
            lambda x: x.isNotNull(),
        )
        at = more.withColumn("side", F.explode(sides)).select(
            "uid", "label", "dim", "tree", "projections",
            F.when(F.col("side") == 0, F.col("path")).otherwise(F.xxhash64("path", "side", F.lit(level))).alias("path"),
            F.when(F.col("side") == 0, F.col("tries") + 1).otherwise(0).alias("tries"),
        )
    members = leaves[0]
    for other in leaves[1:]:
        members = members.unionAll(other)
    members = stored(members, "leaves")
    own = members.groupBy("uid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    full = nodes.select("uid", "embedding", "copies").join(own, "uid")

    blocks = F.ceil(F.col("n") / leaf_rows).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("uid", F.lit("block")), F.col("blocks")).cast("int"))
    places = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.when(k >= F.col("b"), F.struct(F.col("b").alias("i"), k.alias("j"), F.lit(0).alias("side"))).otherwise(
            F.struct(k.alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"))
        ),
    )
    dealt = members.withColumn("place", F.explode(places)).select("leaf", "place.i", "place.j", "place.side", "uid").join(full, "uid")
    by = ["leaf", "i", "j"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def done(runs):
            counts, edges = [], []
            for g in runs:
                c, e = link_block(int(g["leaf"].iloc[0]), g, threshold)
                counts += c
                edges += e
            out = [(u, n, None) for u, n in counts] + [(u, None, v) for u, v in edges]
            return pd.DataFrame(out, columns=["uid", "n", "other"]).astype({"n": "Int64", "other": "Int64"})

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[by].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)]
            if len(edges) > 1:
                yield done([rest.iloc[lo:hi] for lo, hi in zip(edges, edges[1:])])
                rest = rest.iloc[edges[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield done([rest])

    found = stored(dealt.mapInPandas(compare, "uid long, n long, other long"), "links")
    counts = found.where("n is not null").groupBy("uid").agg(F.sum("n").alias("n"))
    groups = components(found.where("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    named = nodes.join(groups.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").join(counts, "uid", "left").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    keyed = rows.withColumn("label_", F.when(F.col("valid"), F.col("label"))).withColumn("embedding_", F.when(F.col("valid"), F.col("embedding")))
    on = (keyed["label_"] == named["label"]) & (keyed["embedding_"] == named["embedding"])
    return keyed.join(named, on, "left").select(
        keyed["vec_id"], keyed["label"], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", keyed["vec_id"]).alias("component_id"),
    )


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    found = near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(other) AS component_id, e.vec_id = min(other) AS kept
FROM embeddings e JOIN reach r ON r.vec_id = e.vec_id LEFT JOIN degree d ON d.vec_id = e.vec_id
GROUP BY e.vec_id
"""
