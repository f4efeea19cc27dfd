"""Toxicity of documents whose words may be disguised.

Leetspeak, spacing and repetition are taken as a noisy channel. A disguised stretch becomes a lattice of the letters that each character may
stand for; Viterbi picks the path that a character language model of all texts finds likeliest. The restored text is then scored by
words and beginnings of words that set toxic documents apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import mix, ship, stored, with_defaults
from shoplens.llm.language_id import _folds

# The letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
# Logarithmic prices of the channel: a character read as a letter, dropped, or read as the end of a word; a repetition shortened.
# Dropping a character also saves the price of a letter in the language model, about 2.5, and must not pay off by that alone.
AS_LETTER, DROPPED, AS_END, SHORTENED, JOINED = -1.0, -9.0, -4.0, -1.0, -0.5
BITS = 18

_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[$@|+€£])(?:[ .*_-](?:[^\W_]|[$@|+€£])){2,}(?![^\s.,;:!?])")
_MAYBE_SPACED = re.compile(r" \S[ .*_-]\S[ .*_-]\S(?!\w)")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_AROUND = ".,;:?\"'()<>[]{}%&*#~`^/\\=_-"
_WORD = re.compile(r"[^\W\d_]+")
_JOINED = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:[-./][^\W\d_]{2,})*")
_CHUNK = re.compile(r"\S+")


def _core(token: str) -> str:
    """The token without punctuation around it; at its end, marks and signs that come three times and more are also left out."""
    token = token.lstrip(_AROUND)
    while True:
        short = token.rstrip(_AROUND + "!")
        last = short[-1:]
        bare = short.rstrip(last) if last and not last.isalnum() else short
        if len(short) - len(bare) > 2:
            short = bare
        if short == token:
            return token
        token = short


# --- character language model ----------------------------------------------------------------------------------


def _cells(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    key = (np.uint64(kind) << np.uint64(63)) ^ (a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c
    return (mix(key + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)


_ANY = np.uint64(0x1FFFFF)  # no code point: counts a context whatever follows


def letter_counts(text: str, chunk: int = 1 << 20) -> np.ndarray:
    """Counts, in 2**BITS hashed cells, of each letter or word end after two, one and no characters before it, and of these contexts."""
    total = np.zeros(1 << BITS, np.int64)
    folds = _folds()
    tail = np.zeros(2, np.uint64)
    for lo in range(0, len(text), chunk):
        codes = np.frombuffer(text[lo : lo + chunk].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate([tail, folds[codes].astype(np.uint64)])
        if lo + chunk >= len(text):
            letters = np.concatenate([letters, np.zeros(1, np.uint64)])
        keep = letters != 0
        keep[1:] |= letters[:-1] != 0
        keep[:2] = True
        letters = letters[keep]
        a, b, c = letters[:-2], letters[1:-1], letters[2:]
        real = (b != 0) | (c != 0)
        a, b, c = np.where(b == 0, 0, a)[real], b[real], c[real]
        any_ = np.full(len(c), _ANY)
        for cells in (_cells(0, a, b, c), _cells(0, a, b, any_), _cells(1, any_, b, c), _cells(1, any_, b, any_)):
            total += np.bincount(cells, minlength=1 << BITS)
        tail = letters[-2:]
    return total


def learn_letters(docs: DataFrame) -> np.ndarray:
    """:func:`letter_counts` over the whole texts of all rows. Each task adds up its own; at most 2**BITS cells leave it and are collected."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm.toxicity import BITS, letter_counts

        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            short: list[str] = []
            held = 0
            for text in batch.column(0):
                text = text.as_py()
                short.append(text)
                held += len(text)
                if held > 1 << 20:
                    total += letter_counts("\n".join(short))
                    short, held = [], 0
            total += letter_counts("\n".join(short))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    tall = with_defaults(docs, text="string").where("text is not null").mapInArrow(count, "cell int, n long")
    table = tall.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    out[table["cell"].to_numpy(np.int64)] = table["n"].to_numpy()
    return out


# --- noisy channel ---------------------------------------------------------------------------------------------


class Restorer:
    """Undoes disguises in texts, with counts from :func:`letter_counts`."""

    def __init__(self, counts: np.ndarray, remembered: int = 100_000):
        self.counts = counts
        self.remembered = remembered
        self.logs: dict[tuple[str, str, str], float] = {}
        self.words: dict[str, str] = {}

    def _n(self, kind: int, a: int, b: int, c: int) -> int:
        x = [np.array([v], np.uint64) for v in (a, b, c)]
        return int(self.counts[_cells(kind, *x)[0]])

    def log(self, a: str, b: str, c: str) -> float:
        """Logarithm of the probability of ``c`` after ``a`` and ``b``; an empty string is the edge of a word."""
        key = (a, b, c)
        if key not in self.logs:
            if len(self.logs) > self.remembered:
                self.logs.clear()
            x, y, z, some = ord(a or "\0"), ord(b or "\0"), ord(c or "\0"), int(_ANY)
            x = x if b else 0
            low = (self._n(1, some, y, z) + 0.05) / (self._n(1, some, y, some) + 5.0)
            self.logs[key] = log((self._n(0, x, y, z) + 2.0 * low) / (self._n(0, x, y, some) + 2.0))
        return self.logs[key]

    @staticmethod
    def lattice(stretch: str) -> list[list[tuple[str, float]]]:
        """For each run of one character: what it may stand for, and at what price. A blank ends a word."""
        out = []
        for m in re.finditer(r"(.)\1*", stretch, re.S):
            c, n = m.group(1), len(m.group())
            price = SHORTENED if n > 2 else 0.0
            if c.isalpha():
                short = [(c, SHORTENED if n > 2 else DROPPED)] if n > 1 else []
                out.append([*short, (c * min(n, 2), price)])
            elif c in LEET:
                read = [(x * k, AS_LETTER + price) for x in LEET[c] for k in range(1, min(n, 2) + 1)]
                out.append([*read, *([] if c.isdigit() else [("", DROPPED)]), (" ", AS_END)])
            else:
                out.append([("", JOINED), (" ", AS_END)])
        return out

    def decode(self, stretch: str) -> str:
        """The likeliest reading of a lower-case stretch. Ties go to the reading found first. Linear in the length."""
        best: dict[tuple[str, str], tuple[float, tuple]] = {("", ""): (0.0, ())}
        for options in self.lattice(stretch):
            then: dict[tuple[str, str], tuple[float, tuple]] = {}
            for (a, b), (value, path) in best.items():
                for letters, price in options:
                    x, y, now = a, b, value + price
                    for c in letters:
                        if c == " ":
                            if not y:  # no word to end: the character is dropped
                                now += DROPPED - AS_END
                                continue
                            c = ""
                        now += self.log(x, y, c)
                        x, y = (y, c) if c else ("", "")
                    if (x, y) not in then or now > then[x, y][0]:
                        then[x, y] = (now, (path, letters) if letters else path)
            best = then
        ends = [(value + (self.log(a, b, "") if b else 0.0), path) for (a, b), (value, path) in best.items()]
        _, path = max(ends, key=lambda e: e[0])
        parts = []
        while path:
            path, letters = path
            parts.append(letters)
        return " ".join("".join(reversed(parts)).split())

    def word(self, token: str) -> str | None:
        """The restored form of a token between blanks; None if it shows no disguise."""
        if token.isalpha() and not _LONG_RUN.search(token):
            return None
        if token in self.words:
            return self.words[token] or None
        core = _core(token)
        plain = core.isalpha() and not _LONG_RUN.search(core)
        known = not plain and any(c.isalpha() for c in core)
        if known and _JOINED.fullmatch(core) and core[1:2] not in "-./" and not _LONG_RUN.search(core):
            known = False  # words that are joined or shortened
        if len(self.words) > self.remembered:
            self.words.clear()
        self.words[token] = self.decode(core) if known else ""
        return self.words[token] or None

    def _unspaced(self, text: str | None) -> str:
        low = (text or "").lower()
        return _SPACED.sub(lambda m: self.decode(m.group()), low) if _MAYBE_SPACED.search(" " + low) else low

    def tokens(self, text: str | None) -> set[str]:
        """The different tokens of the whole text in lower case, letters spaced out put together."""
        return set(self._unspaced(text).split())

    def text(self, text: str | None) -> str:
        """The whole text in lower case, disguised stretches restored."""
        low = self._unspaced(text)
        found = {t: w for t in set(low.split()) if (w := self.word(t)) is not None}
        return _CHUNK.sub(lambda m: found.get(m.group(), m.group()), low) if found else low


# --- classifier ------------------------------------------------------------------------------------------------

STARTS = (4, 5)


def features(restored: str) -> set[str]:
    """Words of three letters and more, and their first four and five letters marked by ``*``."""
    words = {w for w in _WORD.findall(restored) if len(w) > 2}
    return words.union(*[{w[:k] + "*" for w in words if len(w) >= k} for k in STARTS])


@dataclass
class Model:
    """``weights`` by feature; ``prior`` is the log-odds of a text without any."""

    letters: np.ndarray
    prior: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.restorer = Restorer(self.letters)
        self.names = set(self.weights)
        self.harmless: set[str] = set()  # tokens known to hold no feature; saves work only
        self.telling: dict[str, set[str]] = {}

    def found(self, text: str | None, remembered: int = 400_000) -> list[str]:
        """The features of the model that the restored text has, sorted."""
        out: set[str] = set()
        if not self.names:
            return []
        for token in self.restorer.tokens(text) - self.harmless:
            if token not in self.telling:
                got = self.names & features(self.restorer.word(token) or token)
                if not got:
                    self.harmless.add(token)
                    continue
                self.telling[token] = got
            out |= self.telling[token]
        if len(self.harmless) + len(self.telling) > remembered:
            self.harmless, self.telling = set(), {}
        return sorted(out)

    def score(self, names: list[str]) -> float:
        x = self.prior + sum(self.weights[n] for n in names)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    def __getstate__(self):
        return self.letters, self.prior, self.weights

    def __setstate__(self, state):
        self.letters, self.prior, self.weights = state
        self.__post_init__()


def fit(rows: list[list[int]], labels: np.ndarray, width: int, prior: float, rounds: int = 2000, sparse: float = 1e-4, lowest: float = -5.0) -> tuple[float, np.ndarray]:
    """Logistic regression on sets of feature numbers by gradient steps of adapted length.

    Weights start at 0 and are never negative: no word excuses another. In the first half each step shrinks them by ``sparse``, so that
    of the words of one text and its copies only those that also mark other texts remain; these are fitted freely in the second half.
    The log-odds of a text without a feature are at least ``lowest``, so that words which never stood alone do not need others.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    idx = np.array([i for r in rows for i in r], np.int64)
    w, b = np.zeros(width), prior
    seen_w, seen_b = np.full(width, 1e-8), 1e-8
    kept = np.ones(width, bool)
    for turn in range(rounds):
        if turn == rounds // 2:
            kept, sparse = w > 0, 0.0
            seen_w, seen_b = np.full(width, 1e-8), 1e-8
        z = b + np.bincount(at, w[idx], minlength=len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad_w, grad_b = np.bincount(idx, off[at], minlength=width) / len(rows) + sparse, float(off.mean())
        seen_w += grad_w**2
        seen_b += grad_b**2
        w = np.maximum(w - 0.3 * grad_w / np.sqrt(seen_w), 0.0) * kept
        b = max(b - 0.3 * grad_b / np.sqrt(seen_b), lowest)
    return float(b), w


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, most: int = 20_000, least_evidence: float = 15.0) -> Model:
    """Learn letters from the texts of all rows of ``docs``, and toxicity from those that ``labels`` (doc_id, toxic) marks.

    Features are counted over all labelled rows, and those kept that are more frequent in toxic ones, with a log-likelihood ratio of at least
    ``least_evidence``: the ``most`` strongest, which bounds the model. Their weights are fitted on about ``sample`` labelled rows at most, taken by hash.
    A doc_id with several labels counts as toxic if one of them says so; null labels and ids are not used. Without
    both kinds of labels there are no features and the score is one value for all.
    """
    spark = docs.sparkSession
    ship(spark)
    letters = learn_letters(docs)
    marks = with_defaults(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = with_defaults(docs, doc_id="long", text="string").where("doc_id is not null")
    # One plan at every size: texts and labels always meet by a shuffle, however few labels there are.
    labelled = texts.join(marks.hint("merge"), "doc_id").select((F.col("toxic") > 0).cast("int").alias("toxic"), "text", F.xxhash64("doc_id", "text").alias("hash"))
    shared = spark.sparkContext.broadcast(Model(letters, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm.toxicity import features

        own = shared.value.restorer
        sums: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())],
                ["feature", "clean", "toxic"],
            )

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = own.tokens(text.as_py())
                words = " ".join([own.word(t) or t for t in tokens])
                for f in [*features(words), ""]:  # the empty one counts the rows
                    if f not in sums:
                        sums[f] = [0, 0]
                    sums[f][toxic] += 1
                if len(sums) > 300_000:
                    yield flush()
                    sums = {}
        yield flush()

    tall = labelled.select("toxic", "text").mapInArrow(count, "feature string, clean long, toxic long")
    # What no toxic text has cannot be chosen. The row of the empty feature holds the totals.
    sums = tall.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = stored(sums.where("toxic > 0 or feature = ''"), "features")
    seen = sums.where("feature = ''").first()
    clean, toxic = (seen["clean"], seen["toxic"]) if seen else (0, 0)
    prior = log((toxic + 0.5) / (clean + 1.5))
    if not clean or not toxic:
        return Model(letters, prior)

    def part(n, total: float):
        return F.when(n > 0, n * F.log(n / total)).otherwise(0.0)

    n = (F.col("clean") + F.col("toxic")).cast("double")
    rest = F.lit(float(clean + toxic)) - n
    share = F.lit(toxic / (clean + toxic))
    evidence = 2 * (
        part(F.col("toxic").cast("double"), n * share) + part(F.col("clean").cast("double"), n * (1 - share))
        + part(F.lit(float(toxic)) - F.col("toxic"), rest * share) + part(F.lit(float(clean)) - F.col("clean"), rest * (1 - share))
    )
    strong = sums.where("feature <> ''").withColumn("evidence", evidence).where(F.col("evidence") >= least_evidence)
    strong = strong.where(F.col("toxic") * clean > F.col("clean") * toxic)
    rows = strong.orderBy(F.desc("evidence"), "feature").limit(most).collect()
    if not rows:
        return Model(letters, prior)
    names = [r["feature"] for r in rows]
    ids = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    draft = spark.sparkContext.broadcast(Model(letters, prior, dict.fromkeys(names, 0.0)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = draft.value, ids.value
        for batch in batches:
            got = [[numbers[f] for f in own.found(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], ["toxic", "found"])

    step = -(-(clean + toxic) // sample)
    few = labelled.where(F.pmod("hash", F.lit(step)) == 0).select("toxic", "text")
    table = few.mapInArrow(found, "toxic int, found array<int>").collect()
    table.sort(key=lambda r: (r["toxic"], r["found"]))  # so that sums do not depend on the order of arrival
    if not table:
        return Model(letters, prior)
    prior, weights = fit([r["found"] for r in table], np.array([r["toxic"] for r in table], float), len(names), prior)
    return Model(letters, prior, {n: w for n, w in zip(names, weights.tolist()) if w > 0})


def assess(docs: DataFrame, model: Model, restored: bool = True) -> DataFrame:
    """``docs`` plus ``score``, ``evidence`` (the features found) and ``restored`` (the whole text in lower case without disguises, if asked for).

    Reads only ``text``; one pass without a shuffle. A null text is restored as empty, and has the score of a text without evidence. Other
    columns pass through; input columns named as the results are replaced. Repeated rows get the same result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score", "evidence", "restored")
    shared = spark.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(columns.index("text"))
                got = [own.found(x.as_py()) for x in texts]
                more = [pa.array([own.restorer.text(x.as_py()) for x in texts], pa.string())] if restored else []
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([own.score(g) for g in got], pa.float64()), pa.array(got, pa.list_(pa.string())), *more],
                    [*columns, "score", "evidence", *["restored"] * restored],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, evidence array<string>{', restored string' * restored}")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = with_defaults(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    labels = with_defaults(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="long", toxic="int")
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    scored = assess(docs, train(docs, labels.where(kept)), restored=False)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
