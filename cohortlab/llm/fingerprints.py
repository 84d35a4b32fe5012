"""Merkle fingerprints of documents (operator 4).

A text is cut into paragraphs (lines) and these into leaves of four words with the white
space around them; the leaves' 64-bit hashes make the paragraph's digest, consecutive
paragraphs make a section (a paragraph whose digest ends in three zero bits closes it, so
sections re-align behind an edit), and the sections' digests make the root. Equal roots:
equal texts. Unequal ones are compared branch by branch; ``likeness`` is the share of
leaves in common (2 x common / all, with multiplicity), ``locate_edits`` lists the
paragraphs that differ.

``report`` needs each document's successor by doc_id. The id range is cut into buckets by
a histogram of ids (a bounded number of cells), each bucket's rows are sorted and streamed
through one task, and the first row of a bucket is also sent to the bucket before it.

Defined results: null text is empty; the empty text's fingerprint is that of one empty
paragraph. Rows without doc_id come before all others; rows with equal doc_id are ordered
by the text's hash. A single row is its own successor. Likeness of two empty texts is 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import row_hash, text_or_empty

LEAF_WORDS = 4
_CELLS = 16_384
_BUCKET_ROWS = 4_000
_MOST_BUCKETS = 8_192


class Tree:
    """``root``, and by level ``sections`` (digest, first paragraph, end), ``paragraphs``, ``leaves``."""

    __slots__ = ("root", "sections", "paragraphs", "leaves")

    def __init__(self, leaves: np.ndarray, cuts: list[int]):
        self.leaves, raw = leaves, leaves.tobytes()
        self.paragraphs = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:])]
        self.sections, first = [], 0
        for i, p in enumerate(self.paragraphs):
            if p[-1] & 7 == 0 or i == len(self.paragraphs) - 1:
                self.sections.append((hashlib.blake2b(b"".join(self.paragraphs[first:i + 1]), digest_size=16).digest(), first, i + 1))
                first = i + 1
        self.root = hashlib.sha256(b"".join(s[0] for s in self.sections)).hexdigest()


def trees(texts: list[bytes]) -> list[Tree]:
    """The trees of UTF-8 texts, hashed together."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    breaks = np.flatnonzero(data == 10) + 1
    # paragraph starts: text starts and behind each line feed (a text that ends in one has an empty last paragraph)
    text_of = np.concatenate((np.arange(len(texts)), np.searchsorted(offsets[1:], breaks - 1, "right")))
    start = np.concatenate((offsets[:-1], breaks))
    order = np.lexsort((start, text_of))
    text_of, start = text_of[order], start[order]
    words, _, _ = bk.find_words(data, np.concatenate((start, [data.size])), bk.NON_SPACE)
    at = np.searchsorted(start, words, "right") - 1     # the paragraph of each word (empty ones share a start)
    nth = np.arange(words.size) - np.searchsorted(words, start[at])
    own = start[np.append(start[1:], data.size) > start]  # paragraphs that have bytes
    heads = np.union1d(own, words[(nth % LEAF_WORDS == 0) & (nth > 0)])
    leaves = bk.hash_spans(data, heads, np.append(heads[1:], data.size), fold=False)
    ends = np.append(start[1:], data.size)
    lo, hi = np.searchsorted(heads, start), np.searchsorted(heads, ends)
    first = np.searchsorted(text_of, np.arange(len(texts) + 1))
    return [Tree(leaves[lo[a]:hi[b - 1]], [lo[a] - lo[a], *(hi[a:b] - lo[a]).tolist()]) for a, b in zip(first[:-1], first[1:])]


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    x, n = np.unique(a.leaves, return_counts=True)
    y, m = np.unique(b.leaves, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2.0 * float(np.minimum(n[i], m[j]).sum()) / max(1, a.leaves.size + b.leaves.size)


def locate_edits(a: Tree, b: Tree) -> tuple[list[int], list[int]]:
    """Paragraphs of a and of b that the other lacks; equal branches are passed over whole."""
    if a.root == b.root:
        return [], []

    def lacking(one: Tree, other: Tree) -> list[int]:
        sections, out = {s[0] for s in other.sections}, []
        paragraphs = set(other.paragraphs)
        for digest, first, end in one.sections:
            if digest not in sections:
                out += [i for i in range(first, end) if one.paragraphs[i] not in paragraphs]
        return out

    return lacking(a, b), lacking(b, a)


def edits(pairs: DataFrame) -> DataFrame:
    """``(id, equal, likeness, gone, new)`` for rows ``(id, text_a, text_b)``: differing paragraphs."""

    def run(batches):
        for b in (x.slice(i, 256) for x in batches for i in range(0, len(x), 256)):
            one, two = (trees([(t.as_py() or "").encode() for t in b.column(c)]) for c in ("text_a", "text_b"))
            found = [locate_edits(x, y) for x, y in zip(one, two)]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([x.root == y.root for x, y in zip(one, two)]), pa.array([likeness(x, y) for x, y in zip(one, two)]),
                pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int32()))],
                ["id", "equal", "likeness", "gone", "new"])

    return pairs.select(F.col("id").cast("long").alias("id"), "text_a", "text_b").mapInArrow(bk.tidy(run), "id long, equal boolean, likeness double, gone array<int>, new array<int>")


def _with_successors(batches):
    """Rows sorted by (bucket, sent from the next bucket, order): each row with the row behind it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    before = None
    for b in (x.slice(i, 256) for x in batches for i in range(0, len(x), 256)):
        texts = [t.as_py() for t in b.column("text")]
        own = trees([t.encode() for t in texts])
        rows = list(zip(b.column("bucket").to_pylist(), b.column("sent").to_pylist(), b.column("doc_id").to_pylist(), texts, own))
        pairs = []
        for row in rows:
            if before is not None and before[0] == row[0] and not before[1]:
                pairs.append((before, row))
            before = row
        edited = []
        for (_, _, _, text, _), (_, _, _, behind, _) in pairs:
            half = len(text) // 2
            edited.append((text[:len(text) - half] + behind[:half]).encode())
        changed = trees(edited) if edited else []
        out = [(x[2], len(x[3]), hashlib.sha256(e).hexdigest(), x[4].root, t.root, likeness(x[4], t), likeness(x[4], y[4]))
               for (x, y), e, t in zip(pairs, edited, changed)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint against its edited text and its successor."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], _OUT)
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, -(-(high - low + 1) // _CELLS))
    # rows without doc_id are in cell 0, the others behind it
    cell = F.when(F.col("id").isNull(), 0).otherwise(F.expr(f"cast((cast(id as decimal(20)) - {low}) div {width} as int) + 1"))
    # at most _CELLS + 1 rows of three numbers
    cells = {r.cell: r for r in ids.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("id").alias("least")).collect()}
    buckets = min(_MOST_BUCKETS, -(-n // _BUCKET_ROWS))
    bucket_of, firsts, seen = [], [], 0
    for c in range(max(cells) + 1):
        if c in cells:
            k = seen * buckets // n
            if not firsts or firsts[-1][0] < k:
                firsts.append((k, cells[c].least))
            seen += cells[c].n
        bucket_of.append(firsts[-1][0] if firsts else 0)
    before = {k: firsts[i - 1][0] for i, (k, _) in enumerate(firsts)}  # the first one's is the last
    least, sent_to = [None] * (firsts[-1][0] + 1), [0] * (firsts[-1][0] + 1)
    for k, first in firsts:
        least[k], sent_to[k] = first, before[k]
    array = lambda xs, kind: F.from_json(F.lit("[" + ",".join("null" if x is None else str(x) for x in xs) + "]"), f"array<{kind}>")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), row_hash().alias("rid"), text_or_empty().alias("text"))
    rows = rows.withColumn("own", F.get(array(bucket_of, "int"), cell))
    is_first = F.col("id").eqNullSafe(F.get(array(least, "long"), F.col("own")))
    places = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("sent")))
    with_sent = F.concat(places, F.array(F.struct(F.get(array(sent_to, "int"), F.col("own")).alias("bucket"), F.lit(True).alias("sent"))))
    placed = rows.select("id", "rid", "text", F.explode(F.when(is_first, with_sent).otherwise(places)).alias("to"))
    return (placed.select("to.bucket", "to.sent", F.col("id").alias("doc_id"), "rid", "text")
            .repartition("bucket").sortWithinPartitions("bucket", "sent", F.asc_nulls_first("doc_id"), "rid")
            .mapInArrow(bk.tidy(_with_successors), _OUT))
