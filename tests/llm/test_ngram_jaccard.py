"""The Jaccard join against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pyarrow as pa

from cohortlab.llm import ngram_jaccard as J

from conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id) by comparing every pair."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def variants(seed=5):
    """Chains of edits at and around the threshold, of many sizes."""
    rng, rows = random.Random(seed), []
    for size in (1, 2, 4, 5, 6, 8, 9, 10, 14, 30, 60, 200, 700):
        for _ in range(3):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for _ in range(6):
                rows.append(" ".join(words))
                words = list(words)
                for _ in range(max(1, int(size * rng.choice([0.005, 0.02, 0.04])))):
                    at = rng.randrange(len(words))
                    if rng.random() < 0.5:
                        words[at] = f"v{rng.randrange(10 ** 6)}"
                    else:
                        words.insert(at, f"v{rng.randrange(10 ** 6)}")
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(spark, rows):
    return sorted((tuple(r) for r in J.report(frame(spark, rows)).collect()), key=str)


def test_edits_around_the_threshold(spark):
    rows = list(enumerate(variants()))
    random.Random(1).shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_corner_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"), (None, "one two"),
            (None, "lonely"), (6, "É a b c d e"), (7, "é a b c d e"), (7, "x " * 50000), (9, "x " * 40000 + "y")]
    assert got(spark, rows) == brute(rows)
    kept = J.keep_one(frame(spark, rows))
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect()) == sorted(
        [("1", 0), ("2", 0), ("3", 3), ("4", 7), ("None", 7), ("None", 6), ("6", 11), ("7", 11), ("7", 100000), ("9", 80001)])


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    df = frame(spark, [(1, "a b"), (2, "A b")]).selectExpr("*", "'x' AS node", "'y' AS sig", "1 AS rid", "2 AS component_id")
    assert sorted(map(tuple, J.report(df).collect())) == [(1, 1, 1), (2, 1, 1)]
    assert J.keep_one(df).columns == df.columns and J.keep_one(df).count() == 1


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in J.report(docs).collect()), key=str) == brute(rows)


def test_lists_do_not_depend_on_batches(monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 40) if i % 3 else words[:50]) + f" t{i % 7}" for i in range(40)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(100, 140)), pa.array([i % 4 for i in range(40)], pa.int32()), pa.array(texts)],
                                      ["node", "weight", "text"])

    def run(step, flush, parts):
        monkeypatch.setattr(J, "_FLUSH", flush)
        blocks = [b for i in range(0, 40, step) for b in J._signature_blocks(parts)([rows.slice(i, step)])]
        out = [tuple(x.values()) for b in J._lists(blocks) for x in b.to_pylist()]
        near = {}
        for sig, node, _, centre in out:
            near.setdefault(sig, set()).update((node, centre))
        return {sig: frozenset(n) for sig, n in near.items() if len(n) > 1}

    want = run(40, 10 ** 9, 1)
    assert len(want) > 20 and any(len(n) > 5 for n in want.values())
    assert run(40, 10 ** 9, 7) == run(8, 1, 3) == run(1, 10 ** 9, 5) == want


def test_dear_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(J, "_DEAR", 2)
    rows = list(enumerate(variants(9)))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(1000 + i, common + " " + t) for i, (_, t) in enumerate(rows[::2])]
    assert got(spark, rows) == brute(rows)


def test_equal_long_words_are_linked(spark):
    """600 KB without white space: followed by a short row, and by another long word."""
    long, other = "ab" * 300_000, "cd" * 300_000
    rows = [(1, long), (2, "short"), (3, long), (4, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in J.report(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_large_group_of_near_copies_and_texts_just_under_the_threshold(spark, monkeypatch):
    """Members of one family in many components: compared in several blocks, and no link is lost."""
    monkeypatch.setattr(J, "_CELL", 16)
    rng = random.Random(12)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    assert 1 < len({c for _, _, c in brute(rows)}) < 250
    assert got(spark, rows) == brute(rows)


def test_close_pairs_of_two_blocks():
    """The bound in blocks keeps every pair that may link, and each pair of a block with itself once."""
    texts = [t for t in variants(4)[:120] if t]
    sketch = next(J._sketches([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["node", "text"])]))
    member = [{"node": r["node"], "comp": r["node"] // 2, "n": r["n"], "bins": r["bins"]} for r in sketch.to_pylist()]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("bins", pa.binary())]))
    block = lambda ms: pa.array([[], ms], kind)
    cut = len(member) // 2
    parts = [(True, member[:cut], member[:cut]), (False, member[cut:], member[:cut]), (True, member[cut:], member[cut:])]
    found = []
    for same, one, two in parts:
        rows = pa.RecordBatch.from_arrays([pa.array([False, same]), block(one), block(two)], ["same", "one", "two"])
        found += [tuple(x.values()) for b in J._close_pairs([rows.slice(1)]) for x in b.to_pylist()]
    sets = [shingle_set(t) for t in texts]
    links = {(i, j) for j in range(len(sets)) for i in range(j)
             if i // 2 != j // 2 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links and links <= set(found) and len(found) == len(set(found)) and all(a < b and a // 2 != b // 2 for a, b in found)
