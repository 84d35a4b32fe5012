"""The codec against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from cohortlab.llm import piece_codec as P

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, doc_id, text):
    ids = library.encode(text or "")
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_whole_small_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = [expected(library, r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, P.digests(docs).collect())) == sorted(want)


def test_random_texts(library):
    rng, codec = random.Random(1), P.codec(P.default_model())
    parts = list("aab  e\n\t▁éß́　中文字😀\x00 ..,,--==''()thinger012") + ["the ", "  ", "\r\n", "<0x0A>", "</s>", "%%%", "!!"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))
        ids = library.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
        assert codec.digest(text) == expected(library, 0, text)[1:]


def test_corner_cases(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "x\ny"), (4, "ab" * 150_000), (5, "=" * 70_000), (6, "é " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'x' AS ids_sha256")
    assert sorted(map(tuple, P.digests(df).collect()), key=str) == sorted((expected(library, *r) for r in rows), key=str)
    got = {(r.doc_id, r.decoded) for r in P.encoded(df.where("doc_id < 4")).collect()}
    assert got == {(1, ""), (2, ""), (3, " ")}
    assert P.digests(df.limit(0)).count() == 0


def test_steps_back_where_the_longest_piece_is_wrong(library):
    codec = P.codec(P.default_model())
    walked = 0
    for piece in sorted(codec.whole)[::37]:
        for tail in ("ing", "er", "th", "tion"):
            text = piece.replace(P.SPACE, " ") + tail
            assert codec.encode(text) == library.encode(text)
            walked += [p for _, (_, p) in codec.trie.iter_long(P.SPACE + text)] != [codec.pieces[i] for i in codec.encode(text)]
    assert walked > 50
