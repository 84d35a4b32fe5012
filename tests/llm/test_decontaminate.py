"""The positional index against brute force."""

from __future__ import annotations

import hashlib
import random
import re

from cohortlab.llm import decontaminate as D

from conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(rows, items, size=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[s:s + size]), set()).add(item_id)
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                got = windows.get(tuple(w[i:i + k]))
                if got:
                    hit.update(range(i, i + k))
                    found |= got
        names = sorted(str(f) for f in found if f is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(docs, items):
    return sorted((tuple(r) for r in D.report(docs, items).drop("rid").collect()), key=str)


def frames(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


def test_random_texts_with_planted_windows(spark):
    rng = random.Random(2)
    say = lambda n: [f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(n)]
    items = [(f"b{i}", " ".join(say(rng.choice([3, 9, 10, 11, 25, 60])))) for i in range(25)]
    rows = []
    for d in range(80):
        w = say(rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 4)):
            item = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(item))
            at = rng.randrange(len(w) + 1)
            w[at:at] = item[a:a + rng.randrange(1, 30)]
        rows.append((d, " ".join(w)))
    docs, bench = frames(spark, rows, items)
    assert got(docs, bench) == brute(rows, items)


def test_corner_cases(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = [("a", passage), ("a", passage), ("b", "Short ITEM"), ("c", None), ("d", ""), ("e", "...!"), (None, "nameless words here"), ("f", "é É ü")]
    rows = [(1, None), (2, ""), (3, passage.upper() + "; short-item"), (3, passage.upper() + "; short-item"), (3, "short item"),
            (None, "x " + passage), (4, "nameless words here"), (5, "p0 p1 " * 30000 + passage), (6, "É é ü é É ü"), (7, "--- ...")]
    docs, bench = frames(spark, rows, items)
    assert got(docs, bench) == brute(rows, items)
    named = docs.selectExpr("*", "1 AS term", "2 AS rid", "'x' AS n_words", "'y' AS positions")
    assert got(named, bench.selectExpr("*", "1 AS terms")) == brute(rows, items)
    clean = D.drop_contaminated(named, bench)
    assert clean.columns == named.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 7]
    assert got(docs.limit(0), bench) == [] and got(docs, bench.limit(0)) == brute(rows, [])


def test_proximity(spark):
    item = [f"q{i}" for i in range(10)]
    shuffled = " ".join(reversed(item))
    docs, bench = frames(spark, [(1, "a b " + shuffled), (2, " ".join(item[:9])), (3, " z z z ".join(item))], [("i", " ".join(item))])
    assert [r.doc_id for r in D.PositionalIndex(docs, bench, reach=20).proximity_matches().collect()] == [1]
    exact = D.PositionalIndex(docs, bench).phrase_matches().collect()
    assert exact == []


def test_whole_small_table(spark):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in bench.collect()])
    assert got(docs, bench) == want and sum(w[-1] for w in want) > 0
