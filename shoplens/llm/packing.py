"""Mixture-controlled packing: deficit round-robin over source queues fills fixed windows of tokens."""

from __future__ import annotations

import heapq
import json
import os
import struct
from collections import deque
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import running_totals, ship, stored, with_defaults

END = 0  # the id that closes a document


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each token by id, if the file is a byte-level BPE whose merges stand in the order of their ids; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)):
        return None
    return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(pairs)}


class _Pieces(dict):
    """Ids by piece, found when first asked for; a piece that is no word, or holds other white space, is refused by ``KeyError``."""

    def __init__(self, encode: Callable[[str], list[int]], form: str, older: dict[str, bytes]):
        super().__init__()
        self.encode, self.form, self.older = encode, form, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            line = piece[:1] == "\n"
            if piece.split() != [piece[line:]]:
                raise KeyError(piece)
            found = self.encode(piece if line else " " + piece)
            ids = struct.pack(f"<{len(found)}{self.form}", *found)
        self[piece] = ids
        return ids


class Ids:
    """Token ids of texts by one public tokenizer, as little-endian unsigned 32-bit binaries, or 16-bit where they fit (``size``).

    Words repeat: texts are cut before single blanks and line feeds, which no token of a byte-level BPE crosses, and the ids of the last
    ``keep`` pieces or more are kept. Pieces not seen are merged by the same vocabulary and merge order in the faster of two libraries,
    where the file allows it. Texts with any other white space go to the tokenizer whole. All ways give the same ids.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.form = f"<u{self.size}", "H" if self.size == 2 else "I"
        self.keep = keep
        ranks = _ranks(path)
        self.cuts, self.encode = ranks is not None, lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ranks:
            import public_tokenizers
            import tiktoken

            faster = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            probe = " a b\nc's 12,;é  x\t"
            if faster.encode_ordinary(probe) == self.encode(probe):
                self.encode = faster.encode_ordinary
        self.known = _Pieces(self.encode, self.form, {})

    def of(self, text: str) -> bytes:
        if self.cuts:
            if len(self.known) > self.keep:
                self.known.older = {}
                self.known = _Pieces(self.encode, self.form, self.known)
            # A piece that begins with a line feed has it; any other stands for a blank and itself.
            pieces = ("\n" + text).replace("\n", " \n")[1:].split(" ")
            try:
                return b"".join(map(self.known.__getitem__, pieces))[self.size :]
            except KeyError:  # an empty text, two blanks or line feeds in turn, or another white space
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


_LOADED: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, source, ids, n, width)``: ids of the whole text (null: empty) and the closing id; ``n`` counts both, ``width`` is bytes an id."""
    ship(docs.sparkSession)
    # Every executor has the library and its files; the name is resolved there.
    name = os.path.basename(tokenizer) if os.path.dirname(tokenizer) == "" else tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm.packing import END, ids_of

        path = name
        if os.path.dirname(name) == "":
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        ids = ids_of(path)
        close = np.asarray([END], ids.kind).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [ids.of(t or "") + close for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(out, pa.binary()), pa.array([len(x) // ids.size for x in out], pa.int64()),
                        pa.array([ids.size] * len(out), pa.int32()),
                    ],
                    ["doc_id", "source", "ids", "n", "width"],
                )

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, ids binary, n long, width int")


def prefix(amounts: list[int], done: int) -> list[int]:
    """How many of the first ``done`` ids each source gives, if its k-th id has its turn at (k + 1/2) / amount, ties in source order.

    As it is the beginning of one total order, no source's number ever falls as ``done`` grows.
    """
    total = sum(amounts)
    if not total:
        return [0] * len(amounts)
    given = [min(n, (2 * n * done + total) // (2 * total)) for n in amounts]
    miss = done - sum(given)
    if miss > 0:
        heap = [(Fraction(2 * g + 1, 2 * n), i) for i, (g, n) in enumerate(zip(given, amounts)) if g < n]
        heapq.heapify(heap)
        for _ in range(miss):
            _, i = heapq.heappop(heap)
            given[i] += 1
            if given[i] < amounts[i]:
                heapq.heappush(heap, (Fraction(2 * given[i] + 1, 2 * amounts[i]), i))
    elif miss < 0:
        heap = [(-Fraction(2 * g - 1, 2 * n), -i) for i, (g, n) in enumerate(zip(given, amounts)) if g]
        heapq.heapify(heap)
        for _ in range(-miss):
            _, i = heapq.heappop(heap)
            given[-i] -= 1
            if given[-i]:
                heapq.heappush(heap, (-Fraction(2 * given[-i] - 1, 2 * amounts[-i]), i))
    return given


def fill(lengths: list[deque], quanta: np.ndarray, first: int, window: int, packet: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Deficit round-robin: ``(source, piece, ids, sequence, offset)`` until all queues are empty.

    ``lengths`` holds each source's queue of piece lengths. In each round a source's deficit grows by its quantum,
    and it serves packets (at most ``packet`` ids of its head) while the deficit covers them. Deficits
    carry over to the next round and window; every window is filled before the next begins.
    """
    deficits = np.zeros(len(lengths))
    heads = [0] * len(lengths)  # position of the head in its queue
    sequence, offset = first, 0
    active = [s for s in range(len(lengths)) if lengths[s]]
    while active:
        for s in active:
            deficits[s] += quanta[s]
            queue = lengths[s]
            while queue:
                size = min(queue[0], packet)
                if deficits[s] < size and len(active) > 1:
                    break
                size = min(size, window - offset)
                yield s, heads[s], size, sequence, offset
                deficits[s] -= size
                offset += size
                if offset == window:
                    sequence, offset = sequence + 1, 0
                if size == queue[0]:
                    queue.popleft()
                    heads[s] += 1
                else:
                    queue[0] -= size
        active = [s for s in active if lengths[s]]


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    window: int = 1024,
    packet: int = 256,
    windows_per_task: int = 2048,
    rows_per_bucket: int = 2_000,
) -> DataFrame:
    """Pieces of sequences of ``window`` ids: ``doc_id, source, start, length, ids, doc_tokens, sequence_id, offset``.

    Every id of every document (its text's ids, then 0) lies in exactly one piece; all sequences but the last are full. The
    target proportions are the sources' shares of all ids, so that no queue runs dry before the others. Source s has
    been given its part of the first w * window ids of one fair order after w windows; these quotas cut
    the queues at the edges of runs of ``windows_per_task`` windows, which carries deficits of about one id a source across
    tasks, and deficit round-robin inside a run carries them across windows, to within ``packet`` ids.

    Queues are in the order of a hash of ids and contents. Positions come from running totals over ranges of that hash,
    so a source with a third of all rows is no single task; a run of windows is one group of bounded size, and a long
    document is cut between runs. A null source is a source of its own; a null text is an empty one and gives the
    closing id alone; repeated rows are packed as often as they occur. Other columns are ignored. No rows give no pieces.
    """
    spark = docs.sparkSession
    docs = with_defaults(docs, doc_id="long", source="string", text="string")
    tokens = tokenize(docs, tokenizer).withColumns({"row": F.monotonically_increasing_id(), "mark": F.xxhash64("ids")})
    tokens = stored(tokens, "tokens")
    sizes = {r["source"]: (r["n"], r["rows"]) for r in tokens.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(n for n, _ in sizes.values())
    runs = max(1, -(-total // (window * windows_per_task)))

    amounts = [sizes[s][0] for s in names]

    schema = "source string, rank int, run long, lo long, hi long, quantum double"

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shoplens.llm.packing import prefix

        for batch in batches:
            for r in batch["id"]:
                a, b = (prefix(amounts, min(total, (int(r) + d) * window * windows_per_task)) for d in (0, 1))
                yield pd.DataFrame(
                    [(s, i, int(r), a[i], b[i], window * sizes[s][0] / total) for i, s in enumerate(names) if b[i] > a[i]],
                    columns=["source", "rank", "run", "lo", "hi", "quantum"],
                )

    edges = spark.range(runs).mapInPandas(cuts, schema)
    meta = tokens.select("row", "doc_id", "mark", "source", "n")
    buckets = max(1, -(-max((rows for _, rows in sizes.values()), default=1) // rows_per_bucket))
    queue = running_totals(meta, ["source"], ["doc_id", "mark"], "row", "n", "at", buckets)
    # A document meets the runs whose cuts it overlaps: by the nearest guess, one run more on either side, then exactly.
    span = float(window * windows_per_task)
    share = F.create_map(*[x for s in names if s is not None for x in (F.lit(s), F.lit(sizes[s][0] / total))]) if any(s is not None for s in names) else None
    known = share[F.col("source")] if share is not None else F.lit(None).cast("double")
    own = F.coalesce(known, F.lit(sizes[None][0] / total if None in sizes else 1.0)) * span
    guess = lambda x, by: F.least(F.greatest(F.floor(x / own) + by, F.lit(0)), F.lit(runs - 1)).cast("long")
    queue = queue.withColumn("run", F.explode(F.sequence(guess(F.col("at"), -1), guess(F.col("at") + F.col("n"), 1))))
    cut = edges.alias("e")
    met = queue.alias("q").join(cut, F.col("q.source").eqNullSafe(F.col("e.source")) & (F.col("q.run") == F.col("e.run")))
    met = met.where("q.at < e.hi and q.at + q.n > e.lo").select(
        "q.row", "e.run", "e.rank", "e.quantum",
        (F.greatest("q.at", "e.lo") - F.col("q.at")).alias("start"),
        (F.least(F.col("q.at") + F.col("q.n"), F.col("e.hi")) - F.greatest("q.at", "e.lo")).alias("length"),
        F.greatest("q.at", "e.lo").alias("at"),
    )

    def schedule(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        from shoplens.llm.packing import fill

        group = group.sort_values(["rank", "at"], ignore_index=True)
        ranks = group["rank"].unique().tolist()
        mine = [group.index[group["rank"] == r].to_numpy() for r in ranks]
        lengths = group["length"].to_numpy()
        quanta = np.array([group["quantum"].iloc[m[0]] for m in mine])
        out, done = [], np.zeros(len(group), np.int64)
        for s, head, size, sequence, offset in fill([deque(lengths[m].tolist()) for m in mine], quanta, int(key[0]) * windows_per_task, window, packet):
            i = mine[s][head]
            if out and out[-1][0] == i and out[-1][3] == sequence and out[-1][4] + out[-1][2] == offset:
                out[-1][2] += size
            else:
                out.append([i, int(done[i]), size, sequence, offset])
            done[i] += size
        i, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*out))
        return pd.DataFrame(
            {"row": group["row"].to_numpy()[i], "start": group["start"].to_numpy()[i] + start, "length": length, "sequence_id": sequence, "offset": offset}
        )

    # Only lengths are scheduled; the ids move once, to their pieces.
    plan = met.groupBy("run").applyInPandas(schedule, "row long, start long, length long, sequence_id long, offset long")
    pieces = tokens.select("row", "doc_id", "source", "ids", "n", "width").join(plan, "row").select(
        "doc_id", "source", "start", "length", F.substring("ids", F.col("start") * F.col("width") + 1, F.col("length") * F.col("width")).alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", "offset", "width",
    )

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4").tobytes() for x, w in zip(batch.column(4), batch.column(8).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary()), *batch.columns[5:8]], batch.schema.names[:8])

    return pieces.mapInArrow(
        widen, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
