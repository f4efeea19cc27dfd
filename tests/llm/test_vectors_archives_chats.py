"""Embeddings, WARC archives and transcripts."""

import base64
import gzip
import hashlib
import itertools
import random

import numpy as np
from helpers import component_of, frame, prose

from shoplens.llm import embedding_dedup, transcripts, warc

VECTORS = "vec_id long, embedding array<double>, label int, n long, uid string, leaf string, copies string"


def near(rows, threshold):
    links = []
    for (a, x, la, *_), (b, y, lb, *_) in itertools.combinations(rows, 2):
        if la is not None and la == lb and usable(x) and usable(y) and len(x) == len(y):
            x_, y_ = np.array(x), np.array(y)
            if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= threshold:
                links.append((a, b))
    return links


def usable(x):
    return bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        rows.append((i, r.standard_normal(16).tolist(), i % 3, 1, "u", "l", "c"))
    base = r.standard_normal(16)
    for i in range(400, 640):  # a large group of near copies
        rows.append((i, (base + 0.12 * r.standard_normal(16)).tolist(), 1, 1, "u", "l", "c"))
    for i in range(640, 700):
        rows.append((i, (np.array(rows[i - 640][1]) + 0.1 * r.standard_normal(16)).tolist(), rows[i - 640][2], 1, "u", "l", "c"))
    rows += [(700 + i, rows[5][1], 2, 1, "u", "l", "c") for i in range(9)]
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] + [1.0] * 15, [float("inf")] * 16, rows[5][1]]
    rows += [(800 + i, x, None if i == 6 else 2, 1, "u", "l", "c") for i, x in enumerate(odd)]
    rows += [(900, [1e200, 1e200], 2, 1, "u", "l", "c"), (901, [1e-200, 1.0000001e-200], 2, 1, "u", "l", "c")]
    random.Random(1).shuffle(rows)
    got = {x["vec_id"]: x for x in embedding_dedup.near_embeddings(frame(spark, rows, VECTORS), leaf_rows=24).collect()}
    links = near([x for x in rows if x[0] < 900], 0.93) + [(900, 901)]
    degree = dict.fromkeys(got, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert all(got[i]["n_links"] <= n for i, n in degree.items())
    assert sum(x["n_links"] for x in got.values()) >= 0.98 * 2 * len(links)
    want = component_of(got, links)
    assert sum(got[i]["component_id"] == c for i, c in want.items()) >= 0.99 * len(want)
    for i in range(800, 807):
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    assert embedding_dedup.near_embeddings(frame(spark, [], VECTORS)).collect() == []
    twice = embedding_dedup.near_embeddings(frame(spark, [rows[0]] * 3 + [(None, [1.0], 1, 1, "", "", "")], VECTORS)).collect()
    assert sorted(str(x["component_id"]) for x in twice) == sorted([str(rows[0][0])] * 3 + ["None"])


PAGES = "page_id long, url string, html string, digest string, copy string, key string, bytes string"


def test_archives(spark):
    rows = [
        (5, "http://a/1", "same"), (2, "http://a/ 2", "same"), (9, None, None), (10, "http://e", ""), (11, "http://x", "é\r\n\r\nWARC/1.1\r\n\r\n\r\n😀\n"), (12, "http://x", "a\rb\nc\x00"),
        (2, "http://a/ 2", "same"), (None, "http://n", "same"), (None, "http://n", "none"), (13, "http://big", prose(1, 60_000)), (14, "u", "\r\n\r\n"),
    ]
    rows = [(*r, "d", "c", "k", "b") for r in rows]
    got = warc.captures(frame(spark, rows, PAGES)).collect()
    assert len(got) == len(rows) and len({x["id"] for x in got}) == len(rows)
    seen = []
    for x in got:
        about = dict(line.split(": ", 1) for line in bytes(x["metadata"]["block"]).decode().split("\r\n") if line)
        page = int(about["page-id"]) if "page-id" in about else None
        assert x["request"]["headers"]["warc-concurrent-to"] == x["id"]
        seen.append((page, x["record_type"], x["payload_digest"], int(about["payload-bytes"]), about.get("refers-to-page")))
        if x["record_type"] == "response":
            assert bytes(x["payload"]) in [(r[2] or "").encode() for r in rows if r[0] == page]
        else:
            assert x["payload"] is None and x["refers_to"] in {y["id"] for y in got if y["record_type"] == "response"}
    want = []
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (r[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = digest in first
        want.append((r[0], "revisit" if again else "response", digest, len(data), str(first[digest]) if again else None))
        first.setdefault(digest, r[0])
    key = lambda x: [str(v) for v in x]
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert warc.captures(frame(spark, [], PAGES)).collect() == []
    short = warc.captures(frame(spark, rows[:2], PAGES), least_bytes=5).collect()
    assert [x["record_type"] for x in short] == ["response"] * 2


def test_parse_round_trip():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nWARC/1\r\n\r\r\n\r\n"
    got = list(warc.parse(record * 3))
    assert [x[2] for x in got] == [b"WARC/1\r\n\r"] * 3
    assert list(warc.parse(gzip.decompress(gzip.compress(record)))) == got[:1] and list(warc.parse(b"")) == []


TURNS = "conv_id long, turn long, role string, text string, key string, part string, roles string"


def conversations(n, seed=0):
    r = random.Random(seed)
    for c in range(n):
        roles = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randrange(1, 4)
        for t, role in enumerate(roles):
            size = r.randrange(3, 15) if role == "user" else r.randrange(15, 60)
            text = "\n".join(prose(r.random(), size) for _ in range(1 if role == "user" else r.randrange(1, 4)))
            yield (c + 1000 * seed, t, role, text + ("?" if role == "user" else ""), "k", "p", "r")


def test_transcripts_held_out(spark):
    model = transcripts.train(transcripts.plain_transcripts(frame(spark, list(conversations(150)), TURNS)))
    test = list(conversations(60, 1))
    raw = transcripts.plain_transcripts(frame(spark, test, TURNS))
    got = {(int(x["key"]), x["turn"]): (x["role"], x["text"]) for x in transcripts.parse(raw, model).collect()}
    right = sum(got.get((c, t), ("",))[0] == role for c, t, role, *_ in test)
    assert right >= 0.9 * len(test)
    assert sum(got.get((c, t)) == (role, text) for c, t, role, text, *_ in test) >= 0.85 * len(test)
    # No state sequence is more probable, by trying all on a short text.
    lines = ["User: x y?", "", "Assistant: z"]
    path, n = model.decode(lines), 2 * len(model.roles)
    f = transcripts.features(lines)
    score = lambda p: model.start[p[0]] + sum(model.moves[a, b] for a, b in zip(p, p[1:])) + sum(e[f[i, k], s] for i, s in enumerate(p) for k, e in enumerate(model.emits))
    assert score(path) >= max(map(score, itertools.product(range(n), repeat=3))) - 1e-9


def test_transcripts_awkward(spark):
    rows = [(1, 0, "user", None, "k", "p", "r"), (1, 1, None, "a\r\nb", "k", "p", "r"), (None, None, "user", "hi", "k", "p", "r"), (2, 0, "tool", "", "k", "p", "r"), (3, 300, "user", "x", "k", "p", "r"), (3, 0, "user", "y", "k", "p", "r")] * 2
    raw = transcripts.plain_transcripts(frame(spark, rows, TURNS))
    model = transcripts.train(raw)
    got = transcripts.parse(raw, model).collect()
    assert {x["key"] for x in got} >= {"1", "2", "3"} and {x["part"] for x in got if x["key"] == "3"} == {0, 1}
    assert all(x["chat"] == transcripts.render(x["role"], x["text"]) for x in got)
    none = transcripts.train(transcripts.plain_transcripts(frame(spark, [], TURNS)))
    assert none.roles == [] and transcripts.parse(raw, none).collect() == []
    nothing = frame(spark, [("k", 0, None), ("e", 0, "")], "key string, part long, text string")
    assert [x["key"] for x in transcripts.parse(nothing, model).collect()] == ["e"]
