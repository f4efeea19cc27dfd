"""Helpers shared by the operators: shipping code, shared storage, word hashes, running totals, components."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java form of a word; white space is the six ASCII characters and nothing else.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}  # by application, where local mode has no folder set


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    folder = tempfile.mkdtemp(prefix="run-")  # only the driver reads it, and serves it to the workers
    with open(os.path.join(folder, "shoplens_code.zip"), "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(os.path.join(folder, "shoplens_code.zip"))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="run-")
        base = _LOCAL[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shoplens-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_defaults(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types; a missing one is null. Other columns are ignored."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (df[f"`{have[c.lower()]}`"].cast(t) if c.lower() in have else F.lit(None).cast(t)).alias(c)
            for c, t in columns.items()
        ]
    )


# --- word hashes -----------------------------------------------------------------------------------------------

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20
_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_PRIME), -1, 2**64))
            for key, base in (("up", _PRIME), ("down", inverse)):
                steps = np.full(_BLOCK + 1, base, np.uint64)
                steps[0] = 1
                _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, breaks: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and 64-bit hashes of the words in UTF-8 ``data``; no word crosses ``breaks``.

    A word's hash is a polynomial over its bytes, from prefix sums; blocks keep temporaries bounded,
    and a word cut by a block boundary is put together from its parts.
    """
    up, down = _powers()
    table = _FOLDED if fold else _TABLE
    starts, ends, hashes = [], [], []
    for lo in range(0, len(data), _BLOCK):
        part = data[lo : lo + _BLOCK]
        solid = ~_IS_SPACE[part]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        at = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, lo + len(part))] - lo
        first[at] = solid[at]
        inner = at[at > 0] - 1
        last[inner] = solid[inner]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(np.where(solid, table[part], np.uint64(0)) * up[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s]
        if lo and len(s) and s[0] == 0 and solid[0] and starts and len(starts[-1]) and ends[-1][-1] == lo:
            if not len(at) or at[0] != 0:
                length = int(ends[-1][-1] - starts[-1][-1])
                shift = np.uint64(pow(int(_PRIME), length, 2**64))
                hashes[-1][-1:] += shift * h[:1]
                ends[-1][-1] = e[0] + lo
                s, e, h = s[1:], e[1:], h[1:]
        if len(s):
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(h)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), mix(np.concatenate(hashes))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; with fewer words the whole sequence as one; none without words."""
    if not len(words):
        return words
    size = min(k, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * _PRIME + words[i : i + n])
    return out


def text_slices(column: pa.Array, limit: int = 1 << 21, rows: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of at most ``rows`` rows holding about ``limit`` bytes; a null is an empty text."""
    for first in range(0, len(column), rows):
        for lo, data, offsets in _slices(column.slice(first, rows).cast(pa.large_string()).fill_null(""), limit):
            yield first + lo, data, offsets


def _slices(column: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def document_words(column: pa.Array, fold: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) for each row of a text column."""
    for first, data, offsets in text_slices(column):
        starts, _, hashes = word_hashes(data, np.unique(offsets[:-1][offsets[:-1] < len(data)]), fold)
        bounds = np.searchsorted(starts, offsets)
        for i in range(len(offsets) - 1):
            yield first + i, hashes[bounds[i] : bounds[i + 1]]


# --- running totals --------------------------------------------------------------------------------------------


def running_totals(
    df: DataFrame, group: list[str], order: list[str], tie: str, value: str, out: str, buckets: int
) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows before this one in its group, without one task per group.

    Rows are ordered by the hash of the ``order`` columns, and equal ones by ``tie``. Each group is cut into ``buckets``
    ranges of the hash; sums run within a range, and range totals (``buckets`` rows a group at most) are added.
    """
    spot = F.shiftrightunsigned(F.xxhash64(F.lit("queue"), *order), 1)  # 0 to 2**63 - 1
    slot = F.least(F.floor(spot / F.lit(float(2**63) / buckets)), F.lit(buckets - 1))
    rows = df.withColumn("_spot", spot).withColumn("_slot", slot.cast("long"))
    totals = rows.groupBy(*group, "_slot").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*group, "_slot").orderBy("_spot", *order, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = [rows[c].eqNullSafe(totals[c]) for c in [*group, "_slot"]]
    joined = rows.join(totals, on, "inner")
    kept = [rows[c] for c in df.columns]
    return joined.select(*kept, (rows[out] + totals["_base"]).cast("long").alias(out))


# --- connected components --------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` of every node on an edge ``(a, b)``; the component is its smallest node.

    Large and small stars alternate until the edges stand still. Hubs are met by a map-side combined minimum
    and a join on the hub, which adaptive execution splits; no neighbour list is ever gathered.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(e)
    for _ in range(max_rounds if last[0] else 0):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = (
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct().checkpoint()
        )
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError("components did not settle; raise max_rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
