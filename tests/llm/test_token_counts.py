"""Token attribution: sums, rules, agreement with encoding and with a plain version."""

from __future__ import annotations

import numpy as np
import pytest

from cohortlab.llm import token_counts as T

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def encoding():
    return T.encoder(T.default_ranks())[0]


def plain(encoding, text):
    """Byte by byte: which line each byte and which token each byte belongs to."""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    line_of = [i for i, x in enumerate(lines) for _ in x.encode()]
    counts, crossing, at = [0] * len(lines), 0, 0
    ids = encoding.encode_ordinary(text)
    for i in ids:
        own = line_of[at:at + len(encoding.decode_single_token_bytes(i))]
        counts[max(dict.fromkeys(own), key=own.count)] += 1
        crossing += len(set(own)) > 1
        at += len(own)
    starts = np.cumsum([0] + [len(x) for x in lines])[:-1].tolist()
    return len(ids), len(lines), crossing, ",".join(f"{int(s)}:{c}" for s, c in zip(starts, counts))


def test_whole_small_table(spark, encoding):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted((r.doc_id, *plain(encoding, r.text)) for r in docs.collect())
    assert sorted(map(tuple, T.report(docs).collect())) == want


def test_corner_cases(spark, encoding):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n\na\n\n \n\nb"), (None, "é😀\n中\r\n\tx"), (5, "word " * 50_000), (5, "x"), (6, "\n" * 3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS counts", "2 AS n_tokens")
    got = sorted(map(tuple, T.report(docs).collect()), key=str)
    assert got == sorted(((d, *plain(encoding, t or "")) for d, t in rows), key=str)
    assert any(r[3] for r in got) and T.report(docs.limit(0)).count() == 0


def test_rules_on_a_crossing_token():
    ends, sizes, sections = np.array([2, 5, 9]), np.array([2, 3, 4]), np.array([3, 3, 6, 9])
    assert [x.tolist() for x in T.attribute(ends, sizes, sections, "most")] == [[1, 0, 1, 1], [1, 0, 1, 0]]
    assert T.attribute(ends, sizes, sections, "start")[0].tolist() == [2, 0, 1, 0]
    assert T.attribute(ends, sizes, sections, "end")[0].tolist() == [1, 0, 1, 1]
    tie = T.attribute(np.array([4]), np.array([4]), np.array([2, 4]), "most")
    assert tie[0].tolist() == [1, 0]


def test_fields_add_up(spark, encoding):
    rows = spark.createDataFrame([(1, "user", "Hello there"), (2, None, "x"), (3, "", None)], "id long, role string, text string")
    got = {r.id: r for r in T.count_fields(rows, "id", ["role", "text"]).collect()}
    assert got[1].n_tokens == len(encoding.encode_ordinary("user\n\nHello there")) == got[1].n_role + got[1].n_text
    assert got[3].n_text == 0 and got[2].n_role + got[2].n_text == got[2].n_tokens


LONG = [" " * 1_000_000, "a" + " " * 1_000_000 + "b", "\n" * 70_001 + "x y", "x" * 50_000 + " tail's end", "ab " * 3 + "!" * 9_000 + "　" * 5_000 + "é",
        "\r\n" * 6_000, " \n" * 5_000 + "\t" * 4_096, "word " * 2_000 + "7" * 5_000 + " \n" + "日本" * 3_000]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_long_stretches_against_the_other_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert T.encode_text(T.default_ranks(), text) == whole.encode(text, add_special_tokens=False).ids


def test_five_million_characters_of_one_kind(spark):
    rows = [(i, c * 5_000_000) for i, c in enumerate(" x\n")]
    got = {r.doc_id: r for r in T.report(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_tokens", "n_sections").collect()}
    assert got[0].n_tokens == 5_000_000 and got[1].n_tokens == 625_000 and got[2].n_tokens == 2_500_000
    assert [got[i].n_sections for i in range(3)] == [1, 1, 5_000_000]
