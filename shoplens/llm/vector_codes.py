"""Product codes of vectors, in integers only: every distance, sum and tie is exact.

Components are scaled to integers and vectors cut into parts, each with a codebook of its own. Distances come from matrix
products: integers are split into limbs so short that float64 products and their sums stay below 2**53, and the
limb products are put together in int64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import ship, stored, with_defaults

LIMIT = 1 << 27  # of scaled components: sums of squared differences of 64 components stay below 2**63
_BATCH = 4096  # vectors whose distances are held at once


def _limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of ``bits`` bits, lowest first: ``x == sum(limb[i] << (bits * i))``. The top limb carries the sign."""
    out, rest = [], x
    while True:
        if not rest.size or max(int(rest.max()), -int(rest.min()) - 1) < 1 << (bits - 1):
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits


def exact_products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``a @ b.T`` of int64 matrices with components under ``LIMIT``, exact, by float64 matrix products of limbs."""
    inner = max(a.shape[1], 1)
    bits = bits or (53 - (inner - 1).bit_length()) // 2
    out = np.zeros((a.shape[0], b.shape[0]), np.int64)
    right = _limbs(b, bits)
    for i, x in enumerate(_limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry by squared distance, ties to the lower index, and that distance."""
    far = (x * x).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * exact_products(x, book, bits)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def scaled(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, x): kept vectors in integers, ``floor(scale * component)``.

    Dropped are vectors that are null or empty, or hold a null or non-finite component. All others must have one length, a multiple of
    ``parts``, and scaled components under ``LIMIT``; else the job fails, as parts or exact sums would not be defined.
    """
    rows = with_defaults(vectors, vec_id="long", label="string", embedding="array<double>").where("size(embedding) > 0")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform("embedding", lambda v: F.floor(v * scale))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    within = F.forall("embedding", lambda v: F.abs(v) < LIMIT / scale) & (F.size("embedding") % parts == 0)
    return rows.select("vec_id", "label", F.when(within, x).otherwise(F.raise_error(F.lit("vector too large, or not of whole parts"))).cast("array<bigint>").alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), width)


def learn(x: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """Codebooks ``[part, entry, component]``; None without a vector.

    They start as the parts of the ``entries`` smallest vec_ids (fewer vectors give fewer entries; equal ids go by their vectors). A
    round is one pass: each task adds up the parts it assigned, so that a row an entry and part is all that is shuffled,
    and as many are collected.
    """
    spark = x.sparkSession
    first = x.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return None
    width = len(first[0]["x"])
    if any(len(r["x"]) != width for r in first):
        raise ValueError("vectors differ in length")
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from shoplens.llm.vector_codes import _BATCH, _matrix, nearest

            own = shared.value
            sums, counts = np.zeros_like(own), np.zeros(own.shape[:2], np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, _BATCH):
                    rows = _matrix(batch.column(0).slice(lo, _BATCH), width).reshape(-1, parts, own.shape[2])
                    for p in range(parts):
                        best, _ = nearest(rows[:, p], own[p])
                        np.add.at(sums[p], best, rows[:, p])
                        counts[p] += np.bincount(best, minlength=own.shape[1])
            at = np.argwhere(counts)
            if len(at):
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([sums[p, e].tolist() for p, e in at], kind), pa.array(counts[at[:, 0], at[:, 1]])],
                    ["part", "entry", "sums", "n"],
                )

        tall = x.select("x").mapInArrow(add, "part int, entry int, sums array<long>, n long")
        totals = tall.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])], F.sum("n").alias("n"))
        for r in totals.collect():  # at most parts * entries rows
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
    return books


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray | None]:
    """Rows ``vec_id, label, codes, error`` and the codebooks; ``codes`` holds each part's entry, ``error`` the summed squared distances.

    See :func:`scaled` for what is dropped. Repeated ids and rows are each encoded. Columns other than vec_id, label and
    embedding are ignored; a missing one is null. Without a vector there is no row and no codebook. The scaled vectors are
    read ``rounds`` + 1 times; only codes are written.
    """
    spark = vectors.sparkSession
    ship(spark)
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    x = scaled(vectors, parts, scale)
    books = learn(x, parts, entries, rounds)
    if books is None:
        return x.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), None
    shared = spark.sparkContext.broadcast(books)
    width = parts * books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm.vector_codes import _BATCH, _matrix, nearest

        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                part = batch.slice(lo, _BATCH)
                rows = _matrix(part.column(2), width).reshape(-1, parts, own.shape[2])
                found = [nearest(rows[:, p], own[p]) for p in range(parts)]
                codes = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([f[0] for f in found], axis=1).ravel(), pa.int32()), parts)
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), codes.cast(pa.list_(pa.int32())), pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"]
                )

    return stored(x.mapInArrow(assign, "vec_id long, label string, codes array<int>, error long"), "codes"), books


def decode(codes: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """Adds ``approximation``, the vector that the codes stand for, as doubles."""
    tables = [F.array(*[F.array(*[F.lit(float(v) / scale) for v in entry]) for entry in book]) for book in books]
    return codes.withColumn("approximation", F.concat(*[F.element_at(t, F.col("codes")[p] + 1) for p, t in enumerate(tables)]))


def books_digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def digest(codes: DataFrame, books: np.ndarray | None) -> DataFrame:
    """Codes as hex digits, and each row's sum of errors over the rows of its label (nulls together)."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = codes.join(sums, codes["label"].eqNullSafe(sums["_label"]))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_codes(spark, sf_dir: str) -> DataFrame:
    return digest(*encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _round(i: int) -> str:
    return f"""
near{i} AS (SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
    SELECT x.vec_id, x.part, c.entry, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far
    FROM x JOIN book{i} c USING (part)) GROUP BY ALL)"""


def _book(i: int) -> str:
    return f"""
book{i + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY pos) AS v FROM (
        SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS v FROM (
            SELECT n.part, n.entry, u.pos, sum(x.v[u.pos])::BIGINT AS s, count(*) AS n
            FROM near{i} n JOIN x USING (vec_id, part), (SELECT unnest(range(1, 5)) AS pos) u GROUP BY ALL))
    GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)"""


OP13_SQL = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * 256)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (SELECT vec_id, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
book0 AS (SELECT part, entry, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 64),
{_round(0)},{_book(0)},{_round(1)},{_book(1)},{_round(2)},
coded AS (SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
