"""NTILE over a whole table without sorting it in one task."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import count_rows

_LOWEST = -(10**18)
_EXACT = 2**53
_SLOTS = 65_536


def _tie_slot(row_id: Column) -> Column:
    """One of 65,536 evenly filled slots, independent of how ids are spelled."""
    return F.substring(F.md5(row_id.cast("string")), 1, 4)


def _place(v: Column, slot: Column) -> Column:
    """A number that never falls along (value, slot). Beyond 2**53 doubles cannot tell slots apart, so the value alone counts."""
    n = F.conv(slot, 16, 10).cast("double")
    exact = (v > -_EXACT) & (v < _EXACT)
    return (
        F.when(v == _LOWEST, n * 1e20 - 1e30)
        .when(exact, v.cast("double") * _SLOTS + n)
        .otherwise(v.cast("double") * _SLOTS)
    )


def _cell(place: Column, spans: list[tuple[float, float]], bins: int) -> tuple[Column, Column]:
    """Number of the region among and between the spans, and the bin inside a span (0 between them)."""
    region, bin_ = F.lit(2 * len(spans)), F.lit(0)
    for k, (lo, hi) in reversed(list(enumerate(spans))):
        inside = F.lit(0) if hi == lo else F.least(F.floor((place - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
        region = F.when(place < lo, 2 * k).when(place <= hi, 2 * k + 1).otherwise(region)
        bin_ = F.when(place < lo, 0).when(place <= hi, inside).otherwise(bin_)
    return region, bin_


def exact_ntile(
    df: DataFrame, row_id: str, scores: dict[str, Column], buckets: int, accuracy: int = 10_000, bins: int = 2_000
) -> DataFrame:
    """Add one NTILE(``buckets``) column per entry of ``scores``.

    Each score is a whole-number column ranked ascending (NULL lowest); equal
    values are ordered by a hash slot of ``row_id``, then ``row_id``, so results
    are deterministic. ``row_id`` must be unique.

    Only the ``buckets - 1`` rows on the bucket edges matter. Three passes find them, whatever the size or spread of
    the values: a quantile sketch, whose rank error is at most 1 / ``accuracy``, brackets each edge; exact counts in
    ``bins`` bins of every bracket tell the edge's bin; the rows of that bin are ranked. A bin holds a small part of
    6 / ``accuracy`` of the rows; rows with one value are spread over their slots. What comes back to the driver is the sketches, at most
    (``bins`` + 1) x ``buckets`` counts and one row an edge, for each score. The edges are compared with every row in a map-only
    projection. ``df`` is read four times, so a dear one should be a stored table.
    """
    if buckets < 2:
        raise ValueError("buckets must be at least 2")
    rid = F.col(row_id)
    names = list(scores)
    values = {name: F.coalesce(v.cast("bigint"), F.lit(_LOWEST)) for name, v in scores.items()}
    keyed = df.select(rid.alias("id"), *[v.alias(f"v{i}") for i, v in enumerate(values.values())]).withColumn("slot", _tie_slot(F.col("id")))
    keyed = keyed.select("*", *[_place(F.col(f"v{i}"), F.col("slot")).alias(f"p{i}") for i in range(len(names))])

    margin = 3 / accuracy
    wanted = [0.0, 1.0, *[x for j in range(1, buckets) for x in (max(0.0, j / buckets - margin), min(1.0, j / buckets + margin))]]
    sketch = keyed.agg(count_rows().alias("n"), *[F.percentile_approx(f"p{i}", wanted, accuracy).alias(f"q{i}") for i in range(len(names))]).first()
    n = sketch["n"]
    if not n:
        return df.withColumns({name: F.lit(1) for name in names})
    ranks = [j * (n // buckets) + min(j, n % buckets) for j in range(1, buckets)]
    spans = {}
    for i in range(len(names)):
        low, high, *edges = sketch[f"q{i}"]
        # With few rows the ranks' rounding matters, and the whole range is one bracket.
        found = [(low, high)] if n < buckets * accuracy else sorted(zip(edges[::2], edges[1::2]))
        merged: list[tuple[float, float]] = []
        for lo, hi in found:
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        spans[i] = merged

    def cell(i: int) -> Column:
        region, bin_ = _cell(F.col(f"p{i}"), spans[i], bins)
        return F.struct(F.lit(i).alias("score"), region.alias("region"), bin_.alias("bin"), F.col(f"v{i}").alias("v"))

    tall = keyed.select("id", "slot", F.inline(F.array(*[cell(i) for i in range(len(names))])))
    counts = sorted(map(tuple, tall.groupBy("score", "region", "bin").agg(count_rows()).collect()))
    picks = []
    for i in range(len(names)):
        upto, at = 0, iter(enumerate(ranks, 1))
        j, rank = next(at)
        for score, region, bin_, m in counts:
            while score == i and rank is not None and rank <= upto + m:
                picks.append((i, region, bin_, j, rank - upto))
                j, rank = next(at, (None, None))
            upto += m if score == i else 0

    cells = reduce(lambda a, b: a | b, [(F.col("score") == s) & (F.col("region") == r) & (F.col("bin") == b) for s, r, b in sorted({p[:3] for p in picks})])
    ranked = tall.where(cells).withColumn("rank", F.row_number().over(Window.partitionBy("score", "region", "bin").orderBy("v", "slot", "id")))
    chosen = reduce(
        lambda a, b: a | b,
        [(F.col("score") == s) & (F.col("region") == r) & (F.col("bin") == b) & (F.col("rank") == k) for s, r, b, _, k in picks],
    )
    rows = {(x["score"], x["region"], x["bin"], x["rank"]): x for x in ranked.where(chosen).collect()}

    out = df
    for i, (name, v) in enumerate(values.items()):
        key = F.struct(v.alias("v"), _tie_slot(rid).alias("slot"), rid.alias("id"))
        above = []
        for s, r, b, _, k in picks:
            if s == i:
                edge = rows[s, r, b, k]
                above.append(F.when(key > F.struct(F.lit(edge["v"]).alias("v"), F.lit(edge["slot"]).alias("slot"), F.lit(edge["id"]).alias("id")), 1).otherwise(0))
        out = out.withColumn(name, reduce(add, above, F.lit(1)))
    return out
