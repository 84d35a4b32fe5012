"""Language ID: the sums against listed segmentations, training against plain counting, accuracy on held-out documents."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import language_id as L
from conftest import SF_CHECK

PIECES = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "é", "abab"]


def cuts(word, pieces, unknown):
    """Every segmentation of a word as piece numbers; a character that is no piece is unknown."""
    if not word:
        yield ()
        return
    for i, p in enumerate(pieces):
        if word.startswith(p):
            for rest in cuts(word[len(p):], pieces, unknown):
                yield (i, *rest)
    if word[0] not in pieces:
        for rest in cuts(word[1:], pieces, unknown):
            yield (unknown, *rest)


def test_sums_over_all_segmentations():
    draw = random.Random(3)
    trie = L.Vocabulary(PIECES)
    weights = np.log(np.random.default_rng(1).dirichlet(np.ones(trie.size), size=3).T)
    words = ["▁" + "".join(draw.choice("aabbéx") for _ in range(draw.randint(0, 9))) for _ in range(200)]
    got = L.log_probabilities(trie, words, weights)
    times = np.arange(1.0, 201.0)
    counts = L.expected_counts(trie, words, times, weights[:, 0])
    want = np.zeros(trie.size)
    for w, row, n in zip(words, got, times):
        paths = list(cuts(w, PIECES, trie.unknown))
        p = np.array([[math.exp(sum(weights[i, k] for i in path)) for path in paths] for k in range(3)])
        assert np.allclose(row, np.log(p.sum(axis=1)))
        for path, share in zip(paths, p[0] / p[0].sum()):
            np.add.at(want, list(path), share * n)
    assert np.allclose(counts, want)
    assert L.log_probabilities(trie, [], weights).shape == (0, 3)


def test_long_words_do_not_underflow():
    trie = L.Vocabulary(PIECES)
    weights = np.full((trie.size, 2), -20.0)
    weights[:, 1] = -1.0
    got = L.log_probabilities(trie, ["▁" + "ab" * 3000, "▁" + "é" * 5000, "▁" + "x" * 5000], weights)
    assert np.isfinite(got).all() and np.allclose(got[1:, 0], -20.0 * 5001)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' AS lang_pred", "2 AS score", "'s' AS source")


def test_corner_cases(spark):
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [i for i in range(200) if i not in learn]
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der hund und die katze " * 3, "en" if i % 2 else "de") for i in learn]
    rows += [(held[0], "the dog", "de"), (held[1], "und die", None), (held[2], None, "en"), (held[3], "", "en"), (held[4], "12 | 3.4 🙂 –", "en"),
             (held[5], "THE CAT", "zz"), (None, "the dog", "fr"), (None, "the dog", "fr"), (1000003, "der", None), (held[6], "the " * 300_000, "xx"),
             (held[7], "thecat" * 20_000, "xx")]
    got = L.report(frame(spark, rows))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in got.collect()}
    assert got.count() == len(rows) and {v[0] for v in found.values()} == {"en", "de", "und"}  # held-out and null rows teach no language
    for k, want in enumerate(["en", "de", "und", "und", "und", "en"]):
        assert found[held[k], True][0] == want
    assert found[held[2], True] == ("und", 0.0) and found[None, False][0] == "en" and found[held[6], True][0] == found[held[7], True][0] == "en"
    assert all(0 <= s <= 1 for _, s in found.values()) and all(k[1] == (k[0] in held) for k in found if k[0] is not None and k[0] < 200)
    assert L.report(frame(spark, rows).limit(0)).count() == 0
    nothing = L.report(frame(spark, [(1, "the dog", None), (2, "x", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)] * 2


def test_bounded_sample_and_words(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} w", "en" if i % 3 else "fr") for i in range(300)] * 2
    found, words = L.training_words(frame(spark, rows), per_language=20)
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert found == [(x, sum(r[2] == x for r in learnt)) for x in ("en", "fr")]
    n = {r.language: r.n for r in words.where("word = 'w'").groupBy("language").agg(F.sum("n").alias("n")).collect()}
    assert 0 < n[0] <= 40 and 0 < n[1] <= 40  # repeated rows of a chosen document come together
    everything = L.training_words(frame(spark, rows), per_language=1000)[1]
    assert {r.language: r.n for r in everything.where("word = 'w'").collect()} == dict(enumerate(x[1] for x in found))


def test_rounds_raise_the_likelihood(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    trie = L.vocabulary(L.default_model())
    found, words = L.training_words(docs, 50)
    table = [r for r in words.collect() if r.language == 0]
    spelt, n = ["▁" + r.word for r in table], np.array([r.n for r in table])
    models = [L.train(docs, per_language=50, rounds=k, pooled=1e-9) for k in (1, 2, 3)]
    likelihood = [(L.log_probabilities(trie, spelt, m.weights[:, :1])[:, 0] * n).sum() for m in models]
    assert likelihood[0] < likelihood[1] < likelihood[2]
    assert all(np.allclose(np.exp(m.weights).sum(axis=0), 1) for m in models)


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    return docs, {r.doc_id: (r.lang_pred, r.held_out, r.score) for r in L.report(docs).collect()}


def test_held_out_accuracy(predicted):
    docs, got = predicted
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert {i for i, v in got.items() if v[1]} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [got[i][0] == truth[i] for i in got if got[i][1]]
    assert len(held) > 200 and np.mean(held) >= 0.98


def test_only_the_text_decides(spark, predicted):
    docs, got = predicted
    model = L.train(docs)
    swapped = docs.selectExpr("doc_id + 7 AS doc_id", "text", "'fr' AS lang", "'none' AS source")
    for r in L.scored(swapped.select("doc_id", "text"), model).collect():
        assert (r.lang_pred, round(r.score, 9)) == (got[r.doc_id - 7][0], round(got[r.doc_id - 7][2], 9))
