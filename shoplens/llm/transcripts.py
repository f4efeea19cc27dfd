"""Transcript parsing: a hidden Markov model over marker and line features recovers roles; turns are rendered canonically."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import ship, stored, with_defaults

_WORD_MARK = re.compile(r"\s*(?:#{1,3}\s*)?([A-Za-z]{1,14})\s?:(?:\s|$)")
_SIGN_MARK = re.compile(r"\s*([<>*\-])\s")
_SIZES = (256, 3, 8, 4)  # values of the features: marker, what stands before, length, end


def marker(line: str) -> tuple[int, int]:
    """(class of the speaker marker that a line begins with, where its text begins); class 0 is none. Words fall into classes by hash."""
    m = _WORD_MARK.match(line)
    if m:
        return 8 + zlib.crc32(m.group(1).lower().encode()) % 248, m.end()
    m = _SIGN_MARK.match(line)
    return (1 + "<>*-".index(m.group(1)), m.end()) if m else (0, 0)


def features(lines: list[str]) -> np.ndarray:
    """One row a line: marker class, what stands before (text, blank line, nothing), length class, last character class."""
    out, before = np.zeros((len(lines), 4), np.int64), 2
    for i, line in enumerate(lines):
        words = line.count(" ") + 1 if line.strip() else 0
        last = line.rstrip()[-1:]
        out[i] = marker(line)[0], before, min(7, words.bit_length()), 0 if not last else 1 if last == "?" else 2 if last in ".!" else 3
        before = 0 if words else 1
    return out


@dataclass
class Model:
    """Logarithms of the start, transition and feature probabilities; state 2r begins a turn of role r, state 2r + 1 goes on with it."""

    roles: list[str]
    start: np.ndarray
    moves: np.ndarray
    emits: list[np.ndarray]

    def decode(self, lines: list[str]) -> list[int]:
        """The most probable states (Viterbi); of equal ones the first in order."""
        if not lines or not self.roles:
            return []
        f = features(lines)
        scores = sum(e[f[:, k]] for k, e in enumerate(self.emits))
        best = self.start + scores[0]
        back = np.zeros((len(lines), len(best)), np.int32)
        for i in range(1, len(lines)):
            way = best[:, None] + self.moves
            back[i] = way.argmax(axis=0)
            best = way[back[i], np.arange(len(best))] + scores[i]
        path = [int(best.argmax())]
        for i in range(len(lines) - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        return path[::-1]

    def turns(self, text: str) -> list[tuple[str, int, int, str]]:
        """(role, first line, lines, text without marker and outer blank lines) of each turn."""
        lines = text.split("\n")
        out: list[tuple[str, int, list[str]]] = []
        for i, (line, state) in enumerate(zip(lines, self.decode(lines))):
            role = self.roles[state // 2]
            if state % 2 == 0 or not out or out[-1][0] != role:
                out.append((role, i, [line[marker(line)[1] :]]))
            else:
                out[-1][2].append(line)
        return [(role, at, len(body), "\n".join(body).strip("\n ")) for role, at, body in out]


def train(labelled: DataFrame, smoothing: float = 0.1) -> Model:
    """Learn from transcripts with known states: rows of ``text`` and ``roles``, an array with one entry a line: the role, with ``+`` before it where a turn begins.

    Tasks add up their rows; at most (roles x feature values) counts leave a task, and the model is that large, so it is collected. Rows
    whose arrays have not one entry a line, or are null, teach nothing. No rows give a model without roles.
    """
    ship(labelled.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shoplens.llm.transcripts import features

        total: Counter = Counter()
        for batch in batches:
            for text, roles in zip(batch["text"], batch["roles"]):
                if text is None or roles is None:
                    continue
                lines = text.split("\n")
                if len(lines) != len(roles) or any(r is None for r in roles):
                    continue
                total[("start", roles[0], "", 0)] += 1
                for a, b in zip(roles[:-1], roles[1:]):
                    total[("move", a, b, 0)] += 1
                for role, row in zip(roles, features(lines).tolist()):
                    for k, v in enumerate(row):
                        total[(f"emit{k}", role, "", v)] += 1
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", "a", "b", "v", "n"])

    counts = labelled.select("text", "roles").mapInPandas(count, "kind string, a string, b string, v int, n long")
    table = counts.groupBy("kind", "a", "b", "v").agg(F.sum("n").alias("n")).toPandas()
    roles = sorted({x.removeprefix("+") for x in table["a"]})
    state = lambda x: 2 * roles.index(x.removeprefix("+")) + (not x.startswith("+"))
    n = 2 * len(roles)
    start, moves, emits = np.full(n, smoothing), np.full((n, n), smoothing), [np.full((size, n), smoothing) for size in _SIZES]
    for kind, a, b, v, c in table.itertuples(index=False):
        if kind == "start":
            start[state(a)] += c
        elif kind == "move":
            moves[state(a), state(b)] += c
        else:
            emits[int(kind[4:])][v, state(a)] += c
    for r in range(len(roles)):  # a turn goes on only in its own role
        for s in range(n):
            if s // 2 != r:
                moves[s, 2 * r + 1] = 1e-9
    log = lambda m, axis: np.log(m / m.sum(axis=axis, keepdims=True)) if m.size else m
    return Model(roles, log(start, 0), log(moves, 1), [log(e, 0) for e in emits])


def render(role: str, text: str) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n{text}\n<|end|>\n"


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """One row a recovered turn: ``key, part, turn, role, first_line, n_lines, text, chat``.

    ``transcripts``: ``key, part, text``; each row is decoded whole, on its own. A null text gives no turn, an empty one a single empty turn.
    Adjacent lines of one role are one turn unless a marker begins another. Repeated rows give repeated turns; other columns are ignored.
    """
    spark = transcripts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shoplens.llm.transcripts import render

        own = shared.value
        for batch in batches:
            out = []
            for key, part, text in batch.itertuples(index=False):
                if text is not None:
                    out += [(key, part, i, r, at, n, body, render(r, body)) for i, (r, at, n, body) in enumerate(own.turns(text))]
            yield pd.DataFrame(out, columns=["key", "part", "turn", "role", "first_line", "n_lines", "text", "chat"])

    return transcripts.select("key", "part", "text").mapInPandas(
        run, "key string, part long, turn long, role string, first_line long, n_lines long, text string, chat string"
    )


def plain_transcripts(conversations: DataFrame, turns_per_part: int = 256, marked: float = 0.8) -> DataFrame:
    """``key, part, text, roles``: raw transcripts as people paste them, from ``conv_id, turn, role, text``.

    Four ways of marking speakers, one for each conversation; a share of 1 - ``marked`` of the turns has no marker but a blank line before it. What
    is marked hangs on hashes of the ids. ``roles`` are the true states. Parts are stretches of turn numbers, so a
    conversation with a third of all rows is no single group. A row without conv_id is a conversation of its own. Null texts are empty; a null turn
    counts as 0; a null role has no marker and the name ``unknown``. Equal rows stay, in any order.
    """
    c = with_defaults(conversations, conv_id="string", turn="long", role="string", text="string")
    key = F.coalesce("conv_id", F.concat(F.lit("row-"), F.hex(F.xxhash64("turn", "role", "text"))))
    style = F.pmod(F.xxhash64(key), 4)
    bare = F.pmod(F.xxhash64(key, "turn", F.lit("bare")), 1000) >= int(marked * 1000)
    role = F.coalesce("role", F.lit("unknown"))
    names = {
        "user": ("User: ", "Human: ", "Q: ", "> "), "assistant": ("Assistant: ", "AI: ", "A: ", "< "), "system": ("System: ", "Instructions: ", "### System: ", "* "),
    }
    mark = F.lit("")
    for name, marks in names.items():
        for i, m in enumerate(marks):
            mark = F.when((role == name) & (style == i), m).otherwise(mark)
    mark = F.when(role.isin(*names), mark).when(F.col("role").isNull(), "").otherwise(F.concat(role, F.lit(": ")))
    text = F.coalesce(F.regexp_replace("text", r"\r\n?", "\n"), F.lit(""))
    spaced = bare | (F.pmod(F.xxhash64(key, "turn", F.lit("space")), 2) == 0)
    body = F.concat(F.when(bare, "").otherwise(mark), text)
    n = F.size(F.split(body, "\n", -1))
    states = F.concat(
        F.array(F.concat(F.lit("+"), role)),
        F.when(n > 1, F.array_repeat(role, n - 1)).otherwise(F.array().cast("array<string>")),
        F.when(spaced, F.array(role)).otherwise(F.array().cast("array<string>")),
    )
    number = F.coalesce("turn", F.lit(0))
    rows = c.select(
        key.alias("key"), F.floor(number / turns_per_part).alias("part"),
        F.struct(number.alias("turn"), F.concat(body, F.when(spaced, "\n").otherwise("")).alias("body"), states.alias("states")).alias("t"),
    )
    ordered = rows.groupBy("key", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select(
        "key", "part", F.array_join(F.transform("ts", lambda t: t["body"]), "\n").alias("text"), F.flatten(F.transform("ts", lambda t: t["states"])).alias("roles")
    )


def op6_transcripts(spark, sf_dir: str) -> DataFrame:
    raw = stored(plain_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "transcripts")
    turns = parse(raw, train(raw))
    return turns.select(F.expr("try_cast(key as bigint)").alias("conv_id"), "part", "turn", "role", "first_line", "n_lines", "text", F.sha2("chat", 256).alias("chat_sha256"))
