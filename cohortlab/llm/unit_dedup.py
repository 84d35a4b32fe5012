"""Substring dedup by hashing lines and sentences (operator 5).

Units are lines (paragraphs) and the sentences in them, so that a passage set into the
middle of a line is found by the sentences it brings along. A unit's words are normalised
(A-Z lower-cased, white space ignored) and hashed to 128 bits, if it has ``unit_words`` words or
more. Digests are grouped over the whole corpus and combined in every task before the
shuffle; of each digest the occurrence that ranks first (smallest doc_id, then text hash, then
offset) stays, the others are repeats. A short sentence may be repeated by chance, so it is no evidence by
itself: repeats of one document that follow each other (with fewer than ``unit_words`` words between them, which no
unit covers) make a run, and a run goes if its repeats hold ``min_words`` words or more. The spans to
remove keep their offsets in the original text (code points, end exclusive).

Defined results: null and empty texts have no units and stay as they are. Rows equal in
doc_id and text are the same document: they get the same spans. Rows without doc_id rank
last. Overlapping spans of one document are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import row_hash, text_or_empty, written

_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True  # ! . ?
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_INVERSE = [np.uint64(pow(int(x), -1, 1 << 64)) for x in _ODD]


def _sequence_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the word runs lo..hi, the same wherever a run lies."""
    out = []
    for odd, inverse in zip(_ODD, _INVERSE):
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(h.size, odd, np.uint64), dtype=np.uint64)))
        back = np.concatenate(([np.uint64(1)], np.cumprod(np.full(h.size, inverse, np.uint64), dtype=np.uint64)))
        total = np.concatenate(([np.uint64(0)], np.cumsum(bk.mix(h + odd) * power[:-1], dtype=np.uint64)))
        out.append(bk.mix((total[hi] - total[lo]) * back[lo] + (hi - lo).astype(np.uint64)).view(np.int64))
    return out


def _units(unit_words):
    def run(batches):
        for b in batches:
            data, offsets = bk.string_bytes(b.column("text"))
            for lo, hi in bk.blocks(offsets):
                part, offs = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                starts, ends, first = bk.find_words(part, offs, bk.NON_SPACE)
                if not starts.size:
                    continue
                h = bk.hash_spans(part, starts, ends)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                feeds = np.concatenate(([0], np.cumsum(part == 10)))
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                line = feeds[starts]
                new_line = np.ones(h.size, bool)
                new_line[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
                new_unit = new_line.copy()
                new_unit[1:] |= _STOP[part[ends[:-1] - 1]]
                sentence, lines = np.flatnonzero(new_unit), np.flatnonzero(new_line)
                s_end, l_end = np.append(sentence[1:], h.size), np.append(lines[1:], h.size)
                several = np.searchsorted(sentence, l_end) - np.searchsorted(sentence, lines) > 1
                a, z = np.concatenate((sentence, lines[several])), np.concatenate((s_end, l_end[several]))
                long = z - a >= unit_words
                a, z = a[long], z[long]
                one, two = _sequence_hashes(h, a, z)
                base, word = chars[offs[row[a]]], first[row[a]]
                at = pa.array(row[a] + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), b.column("doc_id").take(at), b.column("rid").take(at),
                     pa.array((chars[starts[a]] - base).astype(np.int64)), pa.array((chars[ends[z - 1]] - base).astype(np.int64)),
                     pa.array((a - word).astype(np.int64)), pa.array((z - word).astype(np.int64))],
                    ["h1", "h2", "doc_id", "rid", "start", "stop", "word", "behind"])

    return run


def units(docs: DataFrame, unit_words: int = 5) -> DataFrame:
    """``(h1, h2, doc_id, rid, start, stop, word, behind)`` of every unit of ``unit_words`` words or more: its
    characters start..stop are the document's words word..behind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rid"), text_or_empty().alias("text"))
    return rows.mapInArrow(bk.tidy(_units(unit_words)),
                           "h1 long, h2 long, doc_id long, rid long, start long, stop long, word long, behind long")


def repeats(docs: DataFrame, unit_words: int = 5) -> DataFrame:
    """``(doc_id, rid, spans)``: each document's repeated units ``(start, stop, word, behind)``, in order (lines may hold sentences)."""
    found = written(units(docs, unit_words), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "start")
    often = (found.groupBy("h1", "h2").agg(F.min(place).alias("keep"), F.max(place).alias("top"))
             .where("keep <> top").select("h1", "h2", "keep"))
    gone = found.join(often, ["h1", "h2"]).where(place != F.col("keep")).select("doc_id", "rid", "start", "stop", "word", "behind")
    spans = F.array_sort(F.collect_set(F.struct("start", "stop", "word", "behind")))
    return gone.groupBy("doc_id", "rid").agg(spans.alias("spans"))


def evident(spans: list[dict], unit_words: int, min_words: int) -> list[dict]:
    """The repeats that lie in runs of ``min_words`` repeated words or more."""
    out, run, words, behind = [], [], 0, 0
    for s in spans:
        if run and s["word"] - behind >= unit_words:
            out += run if words >= min_words else []
            run, words = [], 0
        words += s["behind"] - max(s["word"], behind) if run and s["behind"] > behind else 0 if run else s["behind"] - s["word"]
        behind = max(behind, s["behind"]) if run else s["behind"]
        run.append(s)
    return out + (run if words >= min_words else [])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Ordered spans without overlaps."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["stop"])
        else:
            out.append((s["start"], s["stop"]))
    return out


def _cut(unit_words, min_words):
    """Merged spans, and the texts without them."""
    names = ["doc_id", "n_chars", "n_spans", "n_removed_chars", "spans", "kept"]

    def run(batches):
        for b in (x.slice(i, 512) for x in batches for i in range(0, len(x), 512)):
            yield cut(b)

    def cut(b):
        size, count, removed, shown, kept = [], [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            spans = merged(evident(spans or [], unit_words, min_words))
            cuts = [0, *(x for s in spans for x in s), len(text)]
            size.append(len(text)), count.append(len(spans)), removed.append(sum(y - x for x, y in spans))
            shown.append(",".join(f"{x}:{y}" for x, y in spans))
            kept.append("".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(count, pa.int64()),
                                          pa.array(removed, pa.int64()), pa.array(shown, pa.string()), pa.array(kept, pa.string())], names)

    return run


def report(docs: DataFrame, unit_words: int = 5, min_words: int = 25) -> DataFrame:
    """Per row: doc_id, how much is removed, the spans as ``start:stop`` joined by commas, and the kept text."""
    docs = docs.select("doc_id", "text")
    gone = repeats(docs, unit_words).alias("g")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rid"), text_or_empty().alias("text")).alias("r")
    both = rows.join(gone, F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.rid") == F.col("g.rid")), "left").select(
        "r.doc_id", "text", "spans")
    return both.mapInArrow(bk.tidy(_cut(unit_words, min_words)), "doc_id long, n_chars long, n_spans long, n_removed_chars long, spans string, kept string")
