"""Language identification of documents that may mix languages.

A document is taken as a mixture: each of its character n-grams comes from one of the learned languages.
Expectation-maximisation estimates the proportions; the set of languages is chosen by penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import mix, ship, with_defaults

UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _folds() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(table)
    return _LETTERS[0]


def gram_counts(text: str, bits: int, chunk: int = 1 << 20) -> np.ndarray:
    """Counts of hashed letter n-grams (1 to 3, with word edges) of the whole text, in 2**bits buckets."""
    size = 1 << bits
    shift = np.uint64(64 - bits)
    total = np.zeros(size, np.int64)
    folds = _folds()
    tail = np.zeros(1, np.uint64)  # the text begins at a word edge
    for lo in range(0, len(text), chunk):
        codes = np.frombuffer(text[lo : lo + chunk].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate([tail, folds[codes].astype(np.uint64)])
        new = len(tail)
        if lo + chunk >= len(text):
            letters = np.concatenate([letters, np.zeros(1, np.uint64)])
        keep = letters != 0
        keep[1:] |= letters[:-1] != 0  # a run of other characters is one edge
        keep[:new] = True
        letters = letters[keep]
        one, two, three = letters[new:], letters[new - 1 :], letters[max(new - 2, 0) :]
        one = one[one != 0]
        total += np.bincount((mix(one + np.uint64(1)) >> shift).astype(np.int64), minlength=size)
        pair = two[:-1] * np.uint64(0x200000) + two[1:]
        total += np.bincount((mix(pair + np.uint64(1 << 50)) >> shift).astype(np.int64), minlength=size)
        if len(three) > 2:
            middle = three[1:-1] != 0  # no n-gram spans two words
            triple = ((three[:-2] << np.uint64(42)) | (three[1:-1] << np.uint64(21)) | three[2:])[middle]
            total += np.bincount((mix(triple ^ np.uint64(1 << 63)) >> shift).astype(np.int64), minlength=size)
        tail = letters[-2:]
    return total


@dataclass
class Model:
    """``logs[g, l]``: logarithm of the probability of n-gram bucket g in language l; languages in sorted order."""

    languages: list[str]
    logs: np.ndarray
    bits: int

    def predict(self, text: str | None, penalty: float = 4.0, rounds: int = 50) -> tuple[str, float, list[tuple[str, float]]]:
        """(language with the largest share, its share, all chosen languages with their shares).

        No text, no letter or no learned language: (``und``, 0, []). Ties go to the language first in order.
        ``penalty`` times the logarithm of the number of n-grams is the price of each further language.
        """
        if not text or not self.languages:
            return UNKNOWN, 0.0, []
        counts = gram_counts(text, self.bits)
        at = np.flatnonzero(counts)
        if not len(at) or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, []
        c = counts[at].astype(float)
        logs = self.logs[at]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p = np.maximum(p, 1e-12)
        price = penalty * np.log(c.sum() + 1)
        single = c @ np.log(p)
        chosen = [int(single.argmax())]
        share, best = np.ones(1), float(single.max())
        while len(chosen) < len(self.languages):
            density = p[:, chosen] @ share
            # The likelihood is concave in the shares: this bounds what any further language can add.
            gains = (c / density) @ p - c.sum()
            gains[chosen] = -np.inf
            if gains.max() <= price:
                break
            tried = [*chosen, int(gains.argmax())]
            weights = np.append(share * 0.9, 0.1)
            sub, value = p[:, tried], -np.inf
            for _ in range(rounds):
                parts = sub * weights
                total = parts.sum(axis=1)
                now = float(c @ np.log(total))
                weights = (c / total) @ parts / c.sum()
                if now - value < 1e-3:
                    break
                value = now
            if now - best <= price:
                break
            chosen, share, best = tried, weights / weights.sum(), now
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
        found = [(self.languages[chosen[i]], float(min(1.0, share[i]))) for i in order]
        return found[0][0], found[0][1], found


def train(docs: DataFrame, bits: int = 15, smoothing: float = 0.5) -> Model:
    """Learn from every row whose ``lang`` and ``text`` are not null: n-gram counts by language over all of them.

    Each task adds up its own rows; at most 2**bits rows a language leave a task, whatever the input's size, and the model
    has that many rows a language at the end, so it is collected. Texts are read whole, in chunks. An empty
    table gives a model without languages.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = with_defaults(docs, lang="string", text="string").where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm.language_id import gram_counts

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = gram_counts(text.as_py(), bits)
                totals[lang] = totals[lang] + counts if lang in totals else counts
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                ["lang", "gram", "n"],
            )

    sums = labelled.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = sums.toPandas()
    languages = sorted(table["lang"].unique().tolist())
    counts = np.zeros((1 << bits, len(languages)))
    for i, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        counts[own["gram"].to_numpy(), i] = own["n"].to_numpy()
    counts += smoothing
    return Model(languages, np.log(counts / counts.sum(axis=0)) if languages else counts, bits)


def identify(docs: DataFrame, model: Model, penalty: float = 4.0) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (the share of that language) and ``mixture`` (languages and shares).

    Reads only ``text``. One pass without a shuffle; the model is bounded by its number of buckets and goes as a
    broadcast variable. Null, empty and letterless texts give ``und`` with score 0 and an empty mixture. Other columns pass through;
    input columns named as the results are replaced. Repeated rows each get the same result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "score", "mixture")
    shared = spark.sparkContext.broadcast(model)
    columns = docs.columns
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(x.as_py(), penalty) for x in batch.column(columns.index("text"))]
            mixtures = [[{"lang": k, "share": v} for k, v in m] for _, _, m in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(mixtures, kind)],
                [*columns, "lang_pred", "score", "mixture"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = with_defaults(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string", lang="string")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = train(docs.where("not held_out"))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
