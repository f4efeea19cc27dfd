"""Packing: every id in one piece, full windows, proportions; ids equal to the tokenizer's."""

import functools
import random
import string
import zlib

import numpy as np
import public_tokenizers
from helpers import frame, prose
from tokenizers import Tokenizer

from shoplens.llm import packing

SCHEMA = "doc_id long, text string, source string, row string, n string, ids string, at long"
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


@functools.cache
def plain_ids(text):
    t = TOKENIZER
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_ids_equal_the_tokenizers():
    ids = packing.Ids(PATH, keep=50)
    texts = ["", "a", " a", "a ", "a\nb", "\n", "a\n", "x y z", "<|endoftext|> b", "a b c", "it's 12 éá x'll don't", "😀 b\nc", "a  b", "a\tb c", "a\x1cb c", "​ b", "3.14 $5,000\nx_y", prose(1, 500)]
    for text in texts * 2:
        assert ids.of(text) == plain_ids(text)[:-1].astype(ids.kind).tobytes(), text


def test_ids_of_generated_texts():
    """Marks, digits, scripts, controls and every kind of white space, in all combinations that a seeded draw meets."""
    r = random.Random(8)
    parts = [
        *string.ascii_letters, *string.digits, *string.punctuation, "'s", "'ll", "don't", "<|endoftext|>", "http://a.b/c?d=1", "\u00e9", "e\u0301",
        "\u00df", "\u4e2d\u6587", "\u3042", "\u0438\u043c", "\u0627\u0644", "\u0939\u093f", "\U0001f600", "\U0001f468\u200d\U0001f469", "\u200b", "\ufeff", "\x00", "\x7f", "\ufffd",
    ]
    spaces = [" "] * 60 + ["\n"] * 12 + ["  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]
    ids = packing.Ids(PATH, keep=300)
    for _ in range(4000):
        few = r.random() < 0.6
        text = ""
        for _ in range(r.randrange(1, 30)):
            text += "".join(r.choices(parts, k=r.randrange(1, 7))) + (r.choice(" \n") if few else r.choice(spaces))
        text = text if r.random() < 0.1 else text[:-1]
        assert ids.of(text) == plain_ids(text)[:-1].astype(ids.kind).tobytes(), repr(text)
    assert len(ids.known.older) <= 300 + 30


def check(spark, rows, window, **options):
    got = packing.pack(frame(spark, rows, SCHEMA), window=window, **options).collect()
    texts = {r[0]: r[1] for r in rows}
    copies = {}
    for r in rows:
        copies[r[0]] = copies.get(r[0], 0) + 1
    spans, sequences = {}, {}
    for p in got:
        ids = plain_ids(texts[p["doc_id"]])
        assert p["doc_tokens"] == len(ids)
        assert bytes(p["ids"]) == ids[p["start"] : p["start"] + p["length"]].tobytes() and p["length"] > 0
        spans.setdefault(p["doc_id"], []).extend(range(p["start"], p["start"] + p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for doc, n in copies.items():
        assert sorted(spans[doc]) == sorted([*range(len(plain_ids(texts[doc])))] * n)
    fill = {}
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fill[s] = at
    assert sorted(fill) == list(range(len(fill)))
    assert all(n == window for s, n in fill.items() if s != len(fill) - 1)
    return got, len(fill)


def test_pieces(spark):
    rows = [(i, prose(i, 3 + (i * 53) % 300), ("a", "b", None, "c")[min(3, i % 7)], "r", "n", "i", 1) for i in range(60)]
    rows += [(100, None, "a", "r", "n", "i", 1), (101, "", "d", "r", "n", "i", 1), (102, prose(3, 9000), "a", "r", "n", "i", 1)]
    rows += [(103, prose(4, 70), "b", "r", "n", "i", 1)] * 3 + [(104, "é\t\t<|endoftext|>  \n x", "e", "r", "n", "i", 1)]
    got, n = check(spark, rows, 64, packet=16, windows_per_task=20, rows_per_bucket=7)
    shares, total = {}, 0
    for p in got:
        shares[p["source"]] = shares.get(p["source"], 0) + p["length"]
        total += p["length"]
    served = dict.fromkeys(shares, 0)
    for w in range(n - 1):
        for p in (p for p in got if p["sequence_id"] == w):
            served[p["source"]] += p["length"]
        for s, share in shares.items():
            # Within a packet of the target at every window's end, over all runs.
            assert abs(served[s] - (w + 1) * 64 * share / total) <= 16 + 64 * share / total + 1
    packing.digest(packing.pack(frame(spark, rows[:3], SCHEMA))).select("ids_crc32").collect()


def test_small(spark):
    assert packing.pack(frame(spark, [], SCHEMA)).collect() == []
    got, _ = check(spark, [(1, None, None, None, None, None, None)], 1024)
    assert [(p["start"], p["length"], p["offset"]) for p in got] == [(0, 1, 0)]
    crc = packing.digest(packing.pack(frame(spark, [(1, "Hello there", "s", "", "", "", 1)], SCHEMA))).first()["ids_crc32"]
    assert crc == zlib.crc32(plain_ids("Hello there").tobytes())


def test_quotas_never_fall():
    for amounts in ([5, 1, 1, 1000, 0], [1] * 9, [7, 3], [10**12, 1, 333]):
        total, before = sum(amounts), [0] * len(amounts)
        steps = range(total + 1) if total < 2000 else [total * i // 997 for i in range(998)]
        for done in steps:
            now = packing.prefix(amounts, done)
            assert sum(now) == done and all(a <= b <= n for a, b, n in zip(before, now, amounts))
            before = now
        assert before == amounts
