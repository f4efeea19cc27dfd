"""Disguises, the lattice against all its paths, and held-out accuracy."""

import itertools
import random
from math import log

import numpy as np
import pytest
from helpers import frame

from shoplens.llm import toxicity
from shoplens.llm.toxicity import BITS, Restorer, assess, features, letter_counts, train

SCHEMA = "doc_id long, text string, restored string, score string, evidence int, toxic long, lang string"
BAD = ["grobble", "snitzer", "plomkin", "wartoad"]
PLAIN = "the river runs slowly under stone bridges while people carry bread home before evening rain and nobody minds little noise".split()


def corpus(seed, n=400, mark=lambda w: w):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(PLAIN) for _ in range(r.randrange(3, 60))]
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words) + 1), mark(r.choice(BAD)))
        docs.append((i, " ".join(words), "r", "s", 1, 5, "xx"))
        labels.append((i, int(bad), 1))
    return docs, labels


@pytest.fixture(scope="module")
def restorer():
    docs, _ = corpus(1, 2000)
    return Restorer(letter_counts("\n".join(d[1] for d in docs)))


def test_letter_counts_do_not_depend_on_chunks():
    text = "Añb, c. " * 50 + "x" * 7 + " İstanbul ß é"
    whole = letter_counts(text)
    assert whole.sum() == 4 * (sum(map(len, toxicity._WORD.findall(text.lower().replace("i̇", "i")))) + len(text.split()))
    assert all(np.array_equal(whole, letter_counts(text, n)) for n in (1 << 10, 7, 3))
    assert len(whole) == 1 << BITS and letter_counts("").sum() == 0 and letter_counts("12 .,").sum() == 0


def test_disguises_are_undone(restorer):
    for shown, meant in {
        "gr0bble": "grobble", "sn1tz3r": "snitzer", "p.l.o.m.k.i.n": "plomkin", "w a r t o a d": "wartoad", "grooobbble": "grobble", "$nitzer": "snitzer",
        "w-a-r-t-o-@-d": "wartoad", "GR0BBLE!!!": "grobble", "pl0mk1nnnn": "plomkin", "w a r t o 4 d, yes": "wartoad, yes",
    }.items():
        assert restorer.text(shown) == meant


def test_undisguised_text_stays(restorer):
    for text in ("the river runs", "bread, rain. (noise) well-known don't http", "2024 12.5 -- !!", "a b", ""):
        assert restorer.text(text) == text
    assert restorer.text(None) == ""


def test_viterbi_equals_all_paths(restorer):
    def value(path):
        total, a, b = 0.0, "", ""
        for letters, price in path:
            total += price
            for c in letters:
                if c == " ":
                    if not b:
                        total += toxicity.DROPPED - toxicity.AS_END
                        continue
                    total += restorer.log(a, b, "")
                    a, b = "", ""
                else:
                    total += restorer.log(a, b, c)
                    a, b = b, c
        return total + (restorer.log(a, b, "") if b else 0.0)

    for shown in ("gr0b", "sn1tz3", "w-@-r", "pl0mk1", "oo0o", "s t 0 n e", "1!|a", "$$a"):
        paths = list(itertools.product(*restorer.lattice(shown)))
        best = max(map(value, paths))
        read = [" ".join("".join(x for x, _ in p).split()) for p in paths if value(p) > best - 1e-9]
        assert restorer.decode(shown) in read, shown


def test_log_is_a_probability(restorer):
    letters = "abcdefghijklmnopqrstuvwxyz"
    for a, b in (("", ""), ("", "t"), ("t", "h"), ("b", "b")):
        total = sum(np.exp(restorer.log(a, b, c)) for c in [*letters, *([""] if b else [])])
        assert 0.9 < total < 1.6  # unseen letters share what is left; cells may be shared


def test_long_tokens_take_linear_time(restorer):
    for token in ("." * 100_000 + "a", "a" + "$%" * 50_000 + "b", "!!!" * 30_000 + "x1y", "a1" * 20_000, "a-" * 50_000):
        restorer.text(token)
    assert toxicity._core("((so$$$!!!%%%...") == "so" and toxicity._core("a$$!") == "a$$" and toxicity._core("...") == ""


def test_features():
    assert features("ab abcd abcdefgh") == {"abcd", "abcd*", "abcdefgh", "abcde*"}


def learned(spark, docs, labels, **kw):
    d = frame(spark, docs, SCHEMA)
    return train(d, frame(spark, labels, "doc_id long, toxic int, quality int"), **kw), d


def test_held_out_accuracy_with_and_without_disguise(spark):
    docs, labels = corpus(2)
    model, _ = learned(spark, docs, labels)
    r = random.Random(5)

    def hide(w):
        kind = r.randrange(3)
        return w.replace("o", "0").replace("i", "1").replace("e", "3") if kind == 0 else " ".join(w) if kind == 1 else w.replace("o", "ooo")

    for mark, least in ((lambda w: w, 0.99), (hide, 0.95)):
        fresh, truth = corpus(3, 300, mark)
        got = {x["doc_id"]: x["score"] for x in assess(frame(spark, fresh, SCHEMA), model).collect()}
        assert np.mean([(got[i] >= 0.5) == bool(t) for i, t, _ in truth]) >= least


def test_runs_agree_and_a_part_is_enough(spark):
    docs, labels = corpus(4)
    one, d = learned(spark, docs, labels)
    other, _ = learned(spark, docs[::-1], labels[::-1])
    assert one.prior == other.prior and one.weights == other.weights
    few, _ = learned(spark, docs, labels, sample=150, most=3)
    assert 0 < len(few.weights) <= 3


def test_awkward_rows(spark):
    docs, labels = corpus(6, 120)
    long = " ".join(PLAIN) * 20_000
    docs += [(None, "grobble", "r", "s", 1, 1, "x"), (900, None, "r", "s", 1, 1, "x"), (901, "", "r", "s", 1, 1, "x"), (902, long, "r", "s", 1, 1, "x"), (903, long + " gr0bble", "r", "s", 1, 1, "x")]
    docs += docs[:5] * 2
    labels += [(900, 0, 1), (901, None, 1), (None, 1, 1), *labels[:5]]
    model, d = learned(spark, docs, labels)
    out = assess(d, model)
    assert out.columns == ["doc_id", "text", "toxic", "lang", "score", "evidence", "restored"]
    plain = {(x["doc_id"], x["text"]): (x["score"], x["evidence"]) for x in assess(d, model, restored=False).collect()}
    rows = out.collect()
    assert len(rows) == len(docs) and all(0 <= x["score"] <= 1 for x in rows)
    for x in rows:
        assert x["evidence"] == sorted(model.names & features(x["restored"]))
        assert plain[x["doc_id"], x["text"]] == (x["score"], x["evidence"])
    by = {x["doc_id"]: x for x in rows}
    assert by[None]["score"] > 0.5 and by[903]["score"] > 0.5 and by[902]["score"] < 0.5
    assert by[900]["restored"] == by[901]["restored"] == "" and by[900]["score"] == by[901]["score"] < 0.5
    assert len(by[903]["restored"]) == len(long) + 8


def test_without_labels_or_texts(spark):
    docs, labels = corpus(7, 30)
    for d, marks in ((docs, []), (docs, [(i, 0, 1) for i in range(30)]), ([], labels), ([], [])):
        model, df = learned(spark, d, marks)
        assert not model.weights
        assert all(0 <= x["score"] < 0.5 for x in assess(df, model).collect())
    assert toxicity.Model(np.zeros(1 << BITS, np.int64), log(0.5 / 1.5)).score([]) == pytest.approx(0.25)


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, note string")
    model = train(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert not model.weights
