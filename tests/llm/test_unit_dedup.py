"""Substring dedup against a plain version, planted passages, corner cases."""

from __future__ import annotations

import random
import re

from cohortlab.llm import unit_dedup as U

from conftest import SF_CHECK, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def units(text, unit_words):
    """(words, start, stop, places of the words) of lines and sentences."""
    out, at, seen = set(), 0, 0
    for line in text.split("\n"):
        words = [(m.group(), at + m.start(), at + m.end(), seen + i) for i, m in enumerate(WORD.finditer(line))]
        groups, own = [words], []
        for w in words:
            own.append(w)
            if w[0][-1] in ".!?":
                groups.append(own)
                own = []
        groups.append(own)
        for g in groups:
            if len(g) >= unit_words:
                out.add((tuple(w[0].translate(FOLD) for w in g), g[0][1], g[-1][2], range(g[0][3], g[-1][3] + 1)))
        at, seen = at + len(line) + 1, seen + len(words)
    return out


def brute(rows, unit_words=5, min_words=25):
    """Only for distinct doc_ids or equal rows."""
    first = {}
    for d, t in rows:
        for w, a, _, _ in units(t or "", unit_words):
            first[w] = min(first.get(w, (d, a)), (d, a))
    out = []
    for d, t in rows:
        t = t or ""
        again = [(a, z, p) for w, a, z, p in units(t, unit_words) if first[w] != (d, a)]
        places, runs = sorted({i for _, _, p in again for i in p}), []
        for i in places:   # runs of repeated words
            if runs and i - runs[-1][-1] <= unit_words:
                runs[-1].append(i)
            else:
                runs.append([i])
        enough = {i for r in runs if len(r) >= min_words for i in r}
        gone = sorted((a, z) for a, z, p in again if p[0] in enough)
        spans = U.merged([{"start": a, "stop": z} for a, z in gone])
        kept, at = "", 0
        for a, z in spans:
            kept, at = kept + t[at:a], z
        out.append((d, len(t), len(spans), sum(z - a for a, z in spans), ",".join(f"{a}:{z}" for a, z in spans), kept + t[at:]))
    return sorted(out)


def got(docs, **kw):
    return sorted(tuple(r) for r in U.report(docs, **kw).collect())


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows)
    assert got(docs, min_words=5) == brute(rows, min_words=5)


def test_short_repeats_are_no_evidence(spark):
    """Repeated sentences and lines of 8 words stay by themselves; 25 words of them in a row go, short sentences between them stay."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"u{rng.randrange(10 ** 7)}" for _ in range(n))
    known = [say(8) + "." for _ in range(6)]
    rows = [(0, "\n".join(known)), (1, f"{known[0]} {say(9)}. {known[1]}\n{known[2]}\n{say(30)}"),
            (2, f"{say(7)}. {known[0]} {known[1]} Yes. {known[2]}\n{known[4]} {say(6)}."), (3, f"{known[0]}\n{known[1]}\n{known[2]}"),
            (4, f"{known[0]} {known[1]} {say(3)}\n{say(2)} {known[3]} {known[4]}")]
    out = {r[0]: r for r in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert [out[d][2] > 0 for d in range(5)] == [False, False, True, False, False]
    assert "Yes." in out[2][5] and not any(k in out[2][5] for k in known)
    assert sorted(out.values()) == brute(rows)


def test_clean_documents_are_left_alone_and_passages_found(spark):
    """sf0.01 with passages of 51 to 80 words set into every 20th document, at any word: recall, and documents without that lose nothing."""
    rng = random.Random(21)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect() if r.text]
    sizes = [[rng.randrange(8, 15) for _ in range(6)] for _ in range(4)]
    passages = [" ".join(" ".join(f"p{k}x{rng.randrange(10 ** 6)}" for _ in range(n)) + "." for n in ns) for k, ns in enumerate(sizes)]
    rows, planted = [], {}
    for i, (d, t) in enumerate(sorted(docs)):
        if i % 20 == 0:
            at = rng.choice([m.start() for m in re.finditer(r"\b\w", t)] or [0])
            t = t[:at] + passages[len(planted) % 4] + " " + t[at:]
            planted[d] = passages[len(planted) % 4]
        rows.append((d, t))
    out = {r[0]: r for r in got(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))}
    later = sorted(planted)[4:]
    assert sum(out[d][3] >= 0.5 * len(planted[d]) for d in later) >= 0.95 * len(later)
    shingles = lambda t: {tuple(w[i:i + 25]) for w in [WORD.findall(t.translate(FOLD))] for i in range(len(w) - 24)}
    seen, clean = set(), []
    for d, t in sorted(rows):
        own = shingles(t)
        if d not in planted and not own & seen:
            clean.append(d)
        seen |= own
    assert len(clean) > 500 and sum(out[d][2] == 0 for d in clean) >= 0.95 * len(clean)


def test_passage_set_into_lines(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    passage = f"{say(9)}. {say(3)}. {say(14)}! {say(12)}. {say(15)}."
    rows = [(i, f"{say(6)}. {say(4)} {passage if i % 3 == 0 else ''} {say(7)}\n{say(20)}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r[0]: r for r in got(docs)}
    assert [d for d, r in out.items() if r[2]] == list(range(3, 30, 3))
    for d in range(3, 30, 3):
        assert out[d][3] > 0.6 * len(passage)
        assert all(not out[d][5].count(s) for s in passage.split(". ")[2:4])
    assert got(docs) == brute(rows)


def test_corner_cases(spark):
    five = "One two  three\tfour FIVE"
    rows = [(1, None), (2, ""), (3, five), (4, five.lower() + "\n" + five), (5, "É " + five), (6, "é one two three four five"),
            (7, "x " * 60_000), (8, " ".join(["z"] * 60_000)), (9, "a b c d. a b c d."), (10, "...\n! ? ! ? !")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS spans", "3 AS h1", "4 AS rid")
    for least in (5, 25):
        assert got(docs, min_words=least) == brute(rows, min_words=least)
    assert got(docs.limit(0)) == []
    twice = spark.createDataFrame([(1, five), (1, five), (None, five), (2, "q")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in U.report(twice, min_words=5).collect()) == [(0, ""), (1, five), (1, five), (2, "q")]
