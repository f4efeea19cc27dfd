"""Quality rules and mixing: awkward rows against plain versions."""

import collections

from helpers import frame, prose, words

from shoplens.llm import line_quality, mixing

SCHEMA = "doc_id long, text string, source string, kept string, h long, `row` string, size string"


def figures(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_figures(spark):
    texts = [
        None, "", "\n\n", "a", "a b c", "a b c a b c", "x x x x x", "a b c\na b c\n \na b c ", "# * $ % & | < > é ü 😀", "a\x0bb\x0cc\rd\te", prose(1, 300),
        (prose(2, 30) + "\n") * 9, "a " * 5000, "é" * 40_000, prose(3, 20_000, 50),
    ]
    rows = [(i, t, "s" if i % 2 else None, "k", 1, "r", "z") for i, t in enumerate(texts)] * 2
    got = line_quality.line_quality(frame(spark, rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = figures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert line_quality.line_quality(frame(spark, [], SCHEMA)).collect() == []


def test_frequent_lines_deplete(spark):
    common = prose(9, 40)
    rows = [(i, f"{common.upper()}  x\n{prose(i + 50, 20)}", "h") for i in range(8)]
    rows += [(100 + i, prose(200 + i, 80), "h") for i in range(8)]
    rows += [(200, f"{common} x\n{prose(999, 70)}", "h"), (300, f"{common} x\n{prose(5, 30)}", "other")]
    rows += [(400 + i, prose(777, 90), "h") for i in range(30)]  # copies count once
    got = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in line_quality.line_quality(frame(spark, rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (41, False) for i in range(8))
    assert all(got[100 + i] == (0, True) for i in range(8))
    assert got[200] == (41, True) and got[300] == (0, True)
    assert all(got[400 + i] == (0, True) for i in range(30))


def test_frequent_lines_are_taken_out_of_the_text(spark):
    common = prose(9, 40)
    rows = [(i, f"{common.upper()}  x\n\n{prose(i + 50, 70)}", "h") for i in range(8)]
    rows += [(200, f"{prose(1, 9)}\n {common} x\n{prose(999, 70)}", "h"), (300, f"{common} x\n{prose(5, 30)}", "other"), (400, None, "h"), (401, "", None)] * 2
    got = line_quality.line_quality(frame(spark, rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    want = {i: f"\n{prose(i + 50, 70)}" for i in range(8)} | {200: f"{prose(1, 9)}\n{prose(999, 70)}", 300: rows[9][1], 400: None, 401: ""}
    assert all(r["text"] == want[r["doc_id"]] for r in got)
    assert all(len(words(t)) - len(words(r["text"])) == r["removed_words"] for r in got for i, t, s in rows if i == r["doc_id"])


def test_targets_fill_like_water(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 0, "e": 5, "\U00010000": 40, None: 300}
    got = {r["source"]: r["target"] for r in mixing.targets(frame(spark, list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, rest = set(), {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(w for s, w in weight.items() if s not in full)
        rest = {s: left * w / total for s, w in weight.items() if s not in full}
        new = {s for s, t in rest.items() if t > 2 * sizes[s]}
        if not new:
            break
        full |= new
    for s in sizes:
        assert abs(got[s] - (2 * sizes[s] if s in full else rest[s])) < 1e-6


def test_permutation(spark):
    for n in (1, 2, 3, 7, 10, 97, 1000, 4096):
        df = spark.range(n).withColumn("n", mixing.F.lit(n).cast("long"))
        out = [r["y"] for r in mixing._permuted(df, "id", "n", "y", mixing.F.lit(3)).orderBy("id").collect()]
        assert sorted(out) == list(range(n))
    assert out != sorted(out)


def test_plan_of_the_draw_stays_small(spark):
    """Planning takes the driver's memory: 153,000 characters before, in four written steps of nested lambdas a permutation."""
    rows = [(i, prose(i, 300), "ab"[i % 2]) for i in range(9)]
    _, slots = mixing.mix(frame(spark, rows, "doc_id long, text string, source string"), block=4)
    assert len(slots._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_mix(spark):
    rows = [(i, prose(i, 5 + (i * 37) % 400), ("a", "b", None, "c")[min(3, i % 9)], "k", 1, "r", "z") for i in range(200)]
    rows += [(900, None, "a", "k", 1, "r", "z"), (901, "", "d", "k", 1, "r", "z"), (902, prose(5, 50), "b", "k", 1, "r", "z"), (902, prose(5, 50), "b", "k", 1, "r", "z"), (None, prose(6, 60), "c", None, None, None, None)]

    def result():
        found = mixing.taken(*mixing.mix(frame(spark, rows, SCHEMA), block=16), block=16)
        return sorted([(r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in found.collect()], key=str)

    first = result()
    assert first == result() and len(first) == len(rows)
    totals = collections.defaultdict(lambda: [0, 0])
    for doc, source, size, source_size, target, taken in first:
        assert 0 <= taken <= 2 * size
        totals[source, source_size, target][0] += size
        totals[source, source_size, target][1] += taken
    for (_, source_size, target), (size, taken) in totals.items():
        assert size == source_size and abs(taken - target) <= 32
    empty = mixing.taken(*mixing.mix(frame(spark, [], SCHEMA)))
    assert empty.collect() == []


def test_taken_recomputed_and_draws_spread(spark):
    """Words of the slots' blocks counted plainly; counts per shard vary as multinomial draws with fixed totals do."""
    rows = [(i, prose(i, 20 + (i * 37) % 300), "abc"[(i % 7 > 3) + (i % 7 > 5)]) for i in range(150)]
    places, slots = mixing.mix(frame(spark, rows, "doc_id long, text string, source string"), block=4, slots_per_shard=32, slots_per_task=900)
    places, drawn = [mixing.stored(x, "x") for x in (places, slots)]
    got = {r["doc_id"]: r["taken"] for r in mixing.taken(places, drawn, 4).collect()}
    queue, slots = collections.defaultdict(dict), drawn.collect()
    for r in places.collect():
        for k in range(r["size"]):
            queue[r["source"]][r["at"] + k] = r["doc_id"]
    assert all(sorted(q) == list(range(len(q))) for q in queue.values())
    want = collections.Counter()
    for s in slots:
        want.update(queue[s["source"]][k] for k in range(s["block"] * 4, s["block"] * 4 + 4) if k in queue[s["source"]])
    assert got == {i: want[i] for i, _, _ in rows}
    assert sorted(s["slot"] for s in slots) == list(range(len(slots)))
    shards, totals = collections.Counter((s["shard"], s["source"]) for s in slots), collections.Counter(s["source"] for s in slots)
    full, n = len(slots) // 32, len(slots)
    spread = sum((shards[k, s] - 32 * t / n) ** 2 / (32 * t / n) for k in range(full) for s, t in totals.items())
    assert full > 100 and 0.7 < spread / (full * (len(totals) - 1) * (1 - 32 / n)) < 1.3
