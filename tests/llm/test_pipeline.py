"""The pipeline's stages on awkward rows and on the small test tables."""

import collections

import pytest
from helpers import component_of, frame, prose, shingles, words
from test_jaccard_join import changed
from test_packing import plain_ids
from test_secrets_and_language import plain_base

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, base array<string>, component_id string, `odd name` string, ids binary, lang_pred string, clean string, size int"
EXTRA = ("r", ["b"], "c", "o", b"i", "p", "c", 3)


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(40):
        text = prose(i, 60 + i) + (f" password=abcdef{i:08d}" if i % 5 == 0 else "")
        out.append((i, text, "en", ("a", "b", None)[i % 3], len(text), *EXTRA))
    base = out[3][1]
    more = [base, base, changed(base, 1, 1), changed(base, 2, 2), None, "", "12 34", "  \n "]
    out += [(100 + i, t, "en" if i else None, "a", 1, *EXTRA) for i, t in enumerate(more)]
    out += [(200, prose(77, 90), "en", "b", 1, *EXTRA)] * 3 + [(None, prose(78, 90), "en", "b", 1, *EXTRA)]
    return out


def stage(spark, name, df, folder="/nowhere"):
    return dict(pipeline.STAGES)[name](spark, df, folder)


def test_stages(spark, rows):
    docs = frame(spark, rows, SCHEMA)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mixture", "packing"]

    known = stage(spark, "language_id", docs)
    assert known.schema.simpleString() == docs.schema.simpleString()
    kept = known.collect()
    assert collections.Counter(r["text"] for r in kept) == collections.Counter(r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1]))

    near = stage(spark, "near_duplicates", docs)
    assert near.schema.simpleString() == docs.schema.simpleString()
    sets = {r[0]: shingles(r[1], 5) for r in rows if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    first = component_of(sets, links)
    got = [r["doc_id"] for r in near.collect()]
    assert sorted(x for x in got if x is not None) == sorted(set(first.values())) and got.count(None) == 1

    clean = stage(spark, "secrets", docs)
    assert clean.schema.simpleString() == docs.schema.simpleString()
    for r in clean.collect():
        assert not r["text"] or (plain_base(r["text"]) == [] and r["n_chars"] == len(r["text"]))
    assert clean.count() == len(rows)

    mixed = stage(spark, "mixture", docs)
    assert mixed.schema.simpleString() == docs.schema.simpleString()
    taken = collections.Counter()
    texts = {r[0]: words(r[1]) for r in rows}
    for r in mixed.collect():
        own = words(r["text"])
        assert own and set(own) <= set(texts[r["doc_id"]]) and len(own) <= len(texts[r["doc_id"]])
        taken[r["source"]] += len(own)
    assert abs(sum(taken.values()) - 1.5 * sum(len(words(r[1])) for r in rows)) < 4 * pipeline.BLOCK

    pieces = stage(spark, "packing", docs).collect()
    assert sum(p["length"] for p in pieces) == sum(len(plain_ids(r[1])) for r in rows)


def test_empty_and_unlabelled(spark):
    empty = frame(spark, [], SCHEMA)
    for name, function in pipeline.STAGES:
        assert function(spark, empty, "/nowhere").collect() == [], name
    bare = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    for name, function in pipeline.STAGES[:3]:
        assert [tuple(r) for r in function(spark, bare, "/nowhere").collect()] == [(1, "some text here")], name


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    pieces = pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert pieces and {p["doc_id"] for p in pieces} <= ids
    fill = collections.Counter()
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
    assert all(n == 1024 for s, n in fill.items() if s != max(fill))
