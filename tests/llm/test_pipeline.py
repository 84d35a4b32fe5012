"""The pipeline against a brute-force version, stage by stage."""

from __future__ import annotations

import hashlib
import re

import sentencepiece

import corpus_pipeline as C
from cohortlab.llm import piece_codec, quality

import test_decontaminate
import test_ngram_jaccard
from conftest import SF_SMALL

FOLD = test_ngram_jaccard.FOLD


def dedup_lines(rows):
    """Keys of 20 code points or more in 3 documents or more stay in the largest doc_id only."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(d)
    return [(d, "\n".join(x for x in (t or "").split("\n") if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != d)))
            for d, t in rows]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.report(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in good]
    assert 0 < len(rows) < docs.count()
    rows = dedup_lines(rows)
    group = {d: c for d, _, c in test_ngram_jaccard.brute(rows)}
    rows = [(d, t) for d, t in rows if group[d] == d]
    bad = {r[0] for r in test_decontaminate.brute(rows, items) if r[-1]}
    rows = [(d, t) for d, t in rows if d not in bad]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(d, len(i), sha(",".join(map(str, i))), sha(sp.decode(i))) for d, t in rows for i in [sp.encode(t)]]
    assert sorted(map(tuple, C.run(spark, SF_SMALL).collect())) == sorted(want)


def test_stages_keep_the_columns_and_survive_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, score int, row int"
    odd = [(1, None, None, None, None, None, None, None), (None, "a b", "en", "s", 3, "k", 1, 2), (2, "", "en", None, 0, "k", 1, 2),
           (3, "same words here " * 9, "en", "s", None, None, None, None), (4, "Same words here " * 9, "en", "s", 1, None, None, None),
           (4, "Same words here " * 9, "en", "s", 1, None, None, None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, SF_SMALL)
            assert docs.columns == [f.split()[0] for f in re.split(", ", schema)]
        assert C.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
