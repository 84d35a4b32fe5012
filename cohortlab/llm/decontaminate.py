"""Benchmark decontamination by a distributed positional inverted index (operator 7).

1. Corpus frequency of every benchmark term (one row per term and batch is shuffled).
2. Each window of ``size`` consecutive item words (a shorter item: the item) takes its
   rarest term as anchor.
3. The index: postings ``(term, doc_id, rid, positions)`` of the benchmark's terms, as
   far as they lie within ``reach`` words (at least a window) of an anchor; no other
   token can be in a match. Written once, sorted by term.
4. Anchor lists are joined with the windows: offset-adjusted, an occurrence of anchor at
   document position p and item position q lies on diagonal p - q. The lists of the
   item's other terms, rarest first, are then intersected on those diagonals; a run of
   ``size`` consecutive matches is an occurrence of a window.

``phrase_matches`` returns exact matches with their positions, ``proximity_matches`` the
documents holding all terms of an item's window within a span of ``reach`` words, in any order.

Defined results: null or empty texts have no words; rows without words are clean. Items
without words match nothing; equal items are each reported; items without item_id match
but are left out of ``items_sha256`` and ``n_items``. Rows are told apart by doc_id and
text hash, so repeated rows get equal results; doc_id may be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import row_hash, text_or_empty, written

WINDOW = 10
MAX_TERMS = 4_000_000  # a larger benchmark vocabulary (over 32 MB) is refused, not broadcast


def _terms(texts):
    """Blocks of rows: ``(lo, hi, term hashes, first word of each row)``."""
    data, offsets = bk.string_bytes(texts)
    for lo, hi in bk.blocks(offsets):
        part, offs = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, first = bk.find_words(part, offs, bk.ALNUM)
        yield lo, hi, bk.hash_spans(part, starts, ends).view(np.int64), first


class Vocabulary:
    """Exact lookup of term hashes: a table by the low bits, then a comparison."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms)
        bits = max(16, int(self.terms.size * 64).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        slots = self.terms & self.mask
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[slots] = np.arange(self.terms.size, dtype=np.int32)
        lost = self.terms[self.terms[self.table[slots]] != self.terms] if self.terms.size else self.terms
        self.rest = np.sort(lost)
        self.rest_at = np.searchsorted(self.terms, self.rest)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the sorted terms, or -1."""
        if not self.terms.size:
            return np.full(h.size, -1, np.int32)
        at = self.table[h & self.mask]
        at[self.terms[at] != h] = -1
        if self.rest.size:
            k = np.minimum(np.searchsorted(self.rest, h), self.rest.size - 1)
            hit = self.rest[k] == h
            at[hit] = self.rest_at[k[hit]]
        return at


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, terms)``: a number and the term hashes of each item that has words."""

    def hashed(batches):
        for b in batches:
            out = [h[x:y] for _, _, h, first in _terms(b.column("text")) for x, y in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(out, pa.list_(pa.int64()))], ["item_id", "terms"])

    return (items.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
            .mapInArrow(bk.tidy(hashed), "item_id string, terms array<long>").where(F.size("terms") > 0).distinct()
            .select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"))


def frequencies(docs: DataFrame, vocabulary) -> DataFrame:
    """``(term, n)``: occurrences of the benchmark's terms in the whole corpus."""

    def counted(batches):
        v = vocabulary.value
        for b in batches:
            total = np.zeros(v.terms.size + 1, np.int64)
            for _, _, h, _ in _terms(b.column("text")):
                total += np.bincount(v.find(h) + 1, minlength=total.size)
            has = np.flatnonzero(total[1:])
            yield pa.RecordBatch.from_arrays([pa.array(v.terms[has]), pa.array(total[1:][has])], ["term", "n"])

    return docs.select("text").mapInArrow(bk.tidy(counted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def anchors(items: DataFrame, freq: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(term, item, places)``: the item positions at which ``term`` anchors a window."""
    word = items.select("item", "terms", F.posexplode("terms").alias("at", "term")).join(freq, "term", "left")
    ranked = word.groupBy("item", "terms").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    best = F.transform(starts, lambda s: F.array_min(F.transform(F.slice("w", s + 1, size), lambda x: F.struct(x["n"], x["at"]))))
    picked = ranked.select("item", "terms", F.explode(F.array_distinct(best)).alias("b")).where("b.n > 0")
    return (picked.select("item", F.col("b.at").alias("at"), F.get("terms", F.col("b.at")).alias("term"))
            .groupBy("term", "item").agg(F.array_sort(F.collect_list("at")).alias("places")))


def _index(vocabulary, anchor_terms, reach):
    """Postings near anchors, and one row of counts for every row of the input."""

    def posted(batches):
        v, lead = vocabulary.value, anchor_terms.value
        is_anchor = np.append(np.isin(v.terms, lead), False)  # the last one is for "not a term"
        for b in batches:
            ids, rids = b.column("doc_id"), b.column("rid")
            for lo, hi, h, first in _terms(b.column("text")):
                at = v.find(h)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                spots = np.flatnonzero((at >= 0) & is_anchor[at])
                near = np.zeros(h.size + 1, np.int32)
                np.add.at(near, np.maximum(spots - reach, first[row[spots]]), 1)
                np.add.at(near, np.minimum(spots + reach + 1, first[row[spots] + 1]), -1)
                keep = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (at >= 0))
                keep = keep[np.lexsort((keep, at[keep], row[keep]))]
                r, t, pos = row[keep], at[keep], keep - first[row[keep]]
                head = np.ones(keep.size, bool)
                head[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
                cut = np.flatnonzero(head)
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, keep.size), pa.int32()), pa.array(pos, pa.int32()))
                rows = np.concatenate((np.arange(hi - lo), r[cut])) + lo
                none = hi - lo
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((np.zeros(none, np.int64), v.terms[t[cut]])), mask=np.arange(rows.size) < none),
                    ids.take(pa.array(rows)), rids.take(pa.array(rows)),
                    pa.concat_arrays([pa.nulls(none, pa.list_(pa.int32())), lists]),
                    pa.array(np.concatenate((np.diff(first), np.zeros(cut.size, np.int64))))],
                    ["term", "doc_id", "rid", "positions", "n_words"])

    return posted


_MATCH = "doc_id long, rid long, item_id string, at array<int>, places array<int>"


class Items:
    """The items' terms, one behind the other, for the tasks."""

    def __init__(self, rows):
        self.number = np.array([r.item for r in rows], np.int64)
        self.ids = [r.item_id for r in rows]
        self.size = np.array([len(r.terms) for r in rows], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.terms = np.array([t for r in rows for t in r.terms], np.int64)


def _nested(col):
    """Of a list column: rows, and the fields of its structs, the last of which is a list."""
    bounds = col.offsets.to_numpy()
    inner = col.values.slice(bounds[0], bounds[-1] - bounds[0])
    one, many = inner.field(0), inner.field(1)
    cuts = many.offsets.to_numpy()
    sizes = np.diff(cuts)
    row = np.repeat(np.arange(len(col)), np.diff(bounds))
    return np.repeat(row, sizes), np.repeat(one.to_numpy(), sizes), many.values.to_numpy()[cuts[0]:cuts[-1]].astype(np.int64)


def _intersect(items, size):
    """A row for each document: its postings, and the diagonals on which an anchor lies, by item.

    On each diagonal the item's other lists must meet the document's at the adjusted
    offsets. ``at``/``places``: document and item position of each word of an occurring window.
    """

    def matched(batches):
        known = items.value
        for b in batches:
            row, term, pos = _nested(b.column("post"))
            key = (row << 33) + pos
            order = np.argsort(key)
            key, term = key[order], term[order]
            c_row, c_item, c_diag = _nested(b.column("spots"))
            c_item = np.searchsorted(known.number, c_item)
            found: dict[tuple[int, int], set[tuple[int, int]]] = {}
            ends = np.cumsum(known.size[c_item])
            lo = 0
            while lo < c_row.size:   # about a million list entries at once
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000)))
                rows, which, diag = c_row[lo:hi], c_item[lo:hi], c_diag[lo:hi]
                n = known.size[which]
                first = np.concatenate(([0], np.cumsum(n)))
                cand = np.repeat(np.arange(n.size), n)
                q = np.arange(first[-1]) - first[cand]
                p = diag[cand] + q
                want = (rows[cand] << 33) + np.maximum(p, 0)
                at = np.minimum(np.searchsorted(key, want), max(0, key.size - 1))
                hit = (p >= 0) & (key[at] == want) & (term[at] == known.terms[known.first[which[cand]] + q])
                edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
                cuts = first[1:-1]     # a run ends with its candidate
                begin = np.union1d(np.flatnonzero(edge == 1), cuts[hit[cuts] & hit[cuts - 1]] if cuts.size else cuts)
                stop = np.union1d(np.flatnonzero(edge == -1), cuts[hit[cuts] & hit[cuts - 1]] if cuts.size else cuts)
                full = stop - begin >= np.minimum(size, n[cand[begin]]) if begin.size else np.zeros(0, bool)
                for x, y in zip(begin[full].tolist(), stop[full].tolist()):
                    found.setdefault((int(rows[cand[x]]), int(which[cand[x]])), set()).update(zip(p[x:y].tolist(), q[x:y].tolist()))
                lo = hi
            names = sorted(found)
            hits = [sorted(found[k]) for k in names]
            take = pa.array([r for r, _ in names], pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(take), b.column("rid").take(take), pa.array([known.ids[i] for _, i in names], pa.string()),
                pa.array([[p for p, _ in h] for h in hits], pa.list_(pa.int32())), pa.array([[q for _, q in h] for h in hits], pa.list_(pa.int32()))],
                ["doc_id", "rid", "item_id", "at", "places"])

    return matched


class PositionalIndex:
    """The positional index of ``docs`` for the terms of ``items``."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = WINDOW, reach: int = 0):
        spark, self.size, self.reach = docs.sparkSession, size, max(size, reach)
        self.items = written(item_terms(items), "bench-items")
        known = self.items.select(F.explode("terms").alias("t")).distinct().limit(MAX_TERMS + 1).toPandas()["t"].to_numpy(np.int64)
        if known.size > MAX_TERMS:
            raise ValueError(f"the benchmark has over {MAX_TERMS} different terms; split it into parts")
        vocabulary = spark.sparkContext.broadcast(Vocabulary(known))
        if (self.items.agg(F.sum(F.size("terms"))).first()[0] or 0) > 4 * MAX_TERMS:
            raise ValueError(f"the benchmark has over {4 * MAX_TERMS} words; split it into parts")
        self.held = spark.sparkContext.broadcast(Items(self.items.orderBy("item").collect()))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rid"), text_or_empty().alias("text"))
        freq = written(frequencies(rows, vocabulary), "bench-frequencies")
        self.anchors = written(anchors(self.items, freq, size), "bench-anchors")
        lead = self.anchors.select("term").distinct().toPandas()["term"].to_numpy(np.int64)  # at most the vocabulary
        posted = written(rows.mapInArrow(bk.tidy(_index(vocabulary, spark.sparkContext.broadcast(lead), self.reach)),
                                         "term long, doc_id long, rid long, positions array<int>, n_words long")
                         .sortWithinPartitions("term"), "bench-postings")
        self.rows = posted.where("term IS NULL").select("doc_id", "rid", "n_words")
        self.postings = posted.where("term IS NOT NULL").select("term", "doc_id", "rid", "positions")

    def phrase_matches(self) -> DataFrame:
        """``(doc_id, rid, item_id, at, places)`` for each document and item with occurring windows."""
        spots = (self.postings.join(self.anchors, "term")
                 .select("doc_id", "rid", "item",
                         F.array_distinct(F.flatten(F.transform("positions", lambda p: F.transform("places", lambda q: p - q)))).alias("d")))
        lines = (spots.groupBy("doc_id", "rid", "item").agg(F.array_distinct(F.flatten(F.collect_set("d"))).alias("d"))
                 .groupBy("doc_id", "rid").agg(F.collect_list(F.struct("item", "d")).alias("spots")))
        lists = self.postings.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("term", "positions")).alias("post"))
        both = lines.join(lists, lines.doc_id.eqNullSafe(lists.doc_id) & (lines.rid == lists.rid)).select(
            lines.doc_id, lines.rid, "spots", "post")
        return both.mapInArrow(bk.tidy(_intersect(self.held, self.size)), _MATCH)

    def proximity_matches(self) -> DataFrame:
        """``(doc_id, rid, item_id, start)``: a window's anchor at ``start`` and all its terms within ``reach`` words."""
        reach = self.reach
        near = (self.postings.select("doc_id", "rid", "term", F.explode("positions").alias("p")))
        windows = (self.items.select("item", "item_id", "terms", F.explode(F.sequence(F.lit(0), F.greatest(F.size("terms") - self.size, F.lit(0)))).alias("s"))
                   .select("item", "item_id", "s", F.array_distinct(F.slice("terms", F.col("s") + 1, self.size)).alias("w")))
        lead = (self.anchors.select("term", "item", F.explode("places").alias("q"))
                .join(windows, "item").where((F.col("q") >= F.col("s")) & (F.col("q") < F.col("s") + self.size)))
        spots = lead.join(near, "term").select("item_id", "s", "w", "doc_id", "rid", F.col("p").alias("start"))
        all_terms = spots.select("*", F.explode("w").alias("term"))
        other = near.select(F.col("doc_id").alias("d2"), F.col("rid").alias("r2"), "term", F.col("p").alias("p2"))
        hit = all_terms.join(other, (all_terms.term == other.term) & all_terms.doc_id.eqNullSafe(other.d2) & (F.col("rid") == F.col("r2"))
                             & (F.abs(F.col("p2") - F.col("start")) <= reach)).drop(other.term)
        return (hit.groupBy("doc_id", "rid", "item_id", "s", "start", F.size("w").alias("k")).agg(F.countDistinct(all_terms.term).alias("n"))
                .where("n = k").select("doc_id", "rid", "item_id", "start").distinct())


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` with the query's digest columns."""
    index = PositionalIndex(docs.select("doc_id", "text"), items, size)
    found = (index.phrase_matches().groupBy("doc_id", "rid")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hit"),
                  F.array_sort(F.collect_set("item_id")).alias("items")))
    rows = index.rows.alias("r")
    out = rows.join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.rid") == F.col("f.rid")), "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("r.doc_id", "r.rid", "n_words", hit.alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs."""
    index = PositionalIndex(docs.select("doc_id", "text"), items, size)
    found = index.phrase_matches().select(F.col("doc_id").alias("bad_id"), F.col("rid").alias("bad_rid")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash().alias("rid"))
    return rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.col("rid") == F.col("bad_rid")), "left_anti").select("row.*")
