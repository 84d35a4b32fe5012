"""Language identification by segmentation-marginalised unigrams (operator 12).

A language is a unigram distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the product of
the pieces' probabilities; a forward pass over the word's characters computes it. No piece crosses
a word, so a text's log probability is the sum of its words', whatever its length. The language
with the largest posterior is predicted.

Words are runs of ASCII letters and non-ASCII characters of the lower-cased text, with U+2581 in front; a
character that no piece matches is the unknown piece. All distinct words of a block of rows go through the
forward pass together, one numpy step for each place in the longest of them; a word is
cut first at the places that no piece spans, where the sum factorises. Each worker remembers the
log probabilities of a bounded number of words.

Training is expectation maximisation: a job per round computes the expected
piece counts of the training words by forward and backward sums, Spark adds them up, and
the driver normalises them (languages x vocabulary numbers, whatever the input). It reads at most ``per_language``
documents of each language that are not held out (documented bound, chosen by hash of doc_id); the languages'
shares are counted over all of them.

Defined results: ``und`` with score 0 if the text is null, has no letter, or no language was learnt. Rows without
``doc_id`` or ``lang`` are not learnt from; without doc_id a row is not held out. Equal posteriors: the first language in order
of its name. Rows are independent; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import text_or_empty, written

SPACE = "▁"
MAX_LANGUAGES = 256
UNDETERMINED = "und"
_MEMORY = 48 << 20  # bytes of remembered words in a worker
_CALL = 1 << 17     # characters of words that go through the sums together

WORD = np.zeros(256, bool)
WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Vocabulary:
    """The pieces as a trie in sorted arrays, searched from every character of many words at once."""

    def __init__(self, pieces: list[str]):
        self.size, self.unknown = len(pieces) + 1, len(pieces)
        chars = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.longest = max(map(len, pieces), default=1)
        edges: dict[int, int] = {}
        piece_of = {0: -1}
        for i, p in enumerate(pieces):
            node = 0
            for c in p:
                key = node * self.width + int(self.code[ord(c)])
                node = edges.setdefault(key, len(edges) + 1)
            piece_of[node] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.piece = np.full(len(edges) + 1, -1, np.int64)
        self.piece[list(piece_of)] = list(piece_of.values())

    def matches(self, words: list[str]):
        """``(first, start, end, piece)``: the words' first places and every occurrence of a piece in them, in places
        of the words put one behind the other (a place is a gap between characters, so a word has one more than characters)."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        code = self.code[text].astype(np.int64)
        word = np.repeat(np.arange(sizes.size), sizes)
        stop = np.cumsum(sizes)[word]  # the word's end, in characters
        at, node = np.arange(code.size), np.zeros(code.size, np.int64)
        starts, ends, pieces = [], [], []
        matched = np.zeros(code.size, bool)
        for step in range(self.longest):
            key = node * self.width + code[at + step]
            i = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            alive = self.keys[i] == key if self.keys.size else np.zeros(key.size, bool)
            at, node = at[alive], self.child[i[alive]]
            piece = self.piece[node]
            hit = piece >= 0
            starts.append(at[hit]), ends.append(at[hit] + step + 1), pieces.append(piece[hit])
            if step == 0:
                matched[at[hit]] = True
            inside = at + step + 1 < stop[at]
            at, node = at[inside], node[inside]
            if not at.size:
                break
        lone = np.flatnonzero(~matched)
        start = np.concatenate([*starts, lone])
        end = np.concatenate([*ends, lone + 1])
        piece = np.concatenate([*pieces, np.full(lone.size, self.unknown)])
        shift = word[start]  # places: one more per word
        return np.cumsum(sizes + 1) - sizes - 1, start + shift, end + shift, piece, int(sizes.sum() + sizes.size)


@dataclass
class Parts:
    """Matches by part: a part runs between two places that no piece spans, where a word's sum factorises."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    word: np.ndarray       # of each match
    low: np.ndarray        # first and last place of each match's part
    high: np.ndarray
    closes: np.ndarray     # last place of each part, and the word it belongs to
    owner: np.ndarray
    places: int


def cut_parts(vocabulary: Vocabulary, words: list[str]) -> Parts:
    first, start, end, piece, places = vocabulary.matches(words)
    spans = np.zeros(places + 1, np.int64)
    np.add.at(spans, start + 1, 1)
    np.add.at(spans, end, -1)
    free = np.flatnonzero(np.cumsum(spans)[:places] == 0)  # word ends are among them
    part = np.searchsorted(free, start, "right") - 1
    word = np.searchsorted(first, start, "right") - 1
    closes = np.unique(free[part + 1])
    return Parts(start, end, piece, word, free[part], free[part + 1], closes, np.searchsorted(first, closes, "right") - 1, places)


def path_sums(source: np.ndarray, target: np.ndarray, origin: np.ndarray, weight: np.ndarray, places: int) -> np.ndarray:
    """Log of the summed weights of all paths from each edge's part's ``origin`` to each place, for each column of ``weight``.

    Edges lead from ``source`` to ``target``, away from ``origin``. A place that ends one part and begins the next has the
    sum of the part it ends.
    """
    depth, begins = np.abs(target - origin), source == origin
    total = np.zeros((places, weight.shape[1]))
    order = np.lexsort((target, depth))
    source, target, depth, begins, weight = source[order], target[order], depth[order], begins[order], weight[order]
    heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))  # targets of equal depth differ
    levels = np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1]))) if depth.size else np.empty(0, np.int64)
    for lo, hi in zip(levels.tolist(), [*levels[1:].tolist(), depth.size]):
        mine = heads[np.searchsorted(heads, lo):np.searchsorted(heads, hi)] - lo
        value = weight[lo:hi] + np.where(begins[lo:hi, None], 0.0, total[source[lo:hi]])
        top = np.maximum.reduceat(value, mine, axis=0)
        value -= np.repeat(top, np.diff(np.append(mine, hi - lo)), axis=0)
        total[target[lo:hi][mine]] = top + np.log(np.add.reduceat(np.exp(value), mine, axis=0))
    return total


def log_probabilities(vocabulary: Vocabulary, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows) in each language; ``weights``: log probability by piece and language."""
    parts = cut_parts(vocabulary, words)
    forward = path_sums(parts.start, parts.end, parts.low, weights[parts.piece], parts.places)
    out = np.zeros((len(words), weights.shape[1]))
    np.add.at(out, parts.owner, forward[parts.closes])
    return out


def expected_counts(vocabulary: Vocabulary, words: list[str], times: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected number of each piece in ``words`` (each ``times`` times) under one language's ``weights``."""
    parts = cut_parts(vocabulary, words)
    weight = weights[parts.piece][:, None]
    forward = path_sums(parts.start, parts.end, parts.low, weight, parts.places)[:, 0]
    backward = path_sums(parts.end, parts.start, parts.high, weight, parts.places)[:, 0]
    inside = lambda total, at, edge: np.where(at == edge, 0.0, total[at])
    share = np.exp(inside(forward, parts.start, parts.low) + weight[:, 0] + inside(backward, parts.end, parts.high) - forward[parts.high])
    return np.bincount(parts.piece, share * times[parts.word], vocabulary.size)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    """One trie for a process and model file: its pieces without byte and control pieces."""
    if model_file not in _vocabularies:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        _vocabularies[model_file] = Vocabulary([
            sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])
    return _vocabularies[model_file]


def _words(texts):
    """Blocks of rows: ``(lo, hi, data, starts, ends, first)`` of the words of the lower-cased texts."""
    data, offsets = bk.string_bytes(pc.utf8_lower(texts))
    for lo, hi in bk.blocks(offsets):
        part, offs = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        yield lo, hi, part, *bk.find_words(part, offs, WORD)


def _chunks(words: list[str]):
    """Ranges of about _CALL characters."""
    lo = size = 0
    for i, w in enumerate(words):
        size += len(w)
        if size > _CALL:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(words):
        yield lo, len(words)


# --- training -------------------------------------------------------------------
@dataclass
class Model:
    """``weights``: log probability by piece and language; ``prior``: log share of each language."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    model_file: str


def _count_words(batches):
    for b in batches:
        seen: dict[tuple[int, bytes], int] = {}
        language = b.column("language").to_pylist()
        for lo, hi, part, starts, ends, first in _words(b.column("text")):
            raw = part.tobytes()
            starts, ends = starts.tolist(), ends.tolist()
            for row in range(lo, hi):
                for i in range(first[row - lo], first[row - lo + 1]):
                    key = (language[row], raw[starts[i]:ends[i]])
                    seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1].decode() for k in seen], pa.string()),
                                          pa.array(list(seen.values()), pa.int64())], ["language", "word", "n"])


def training_words(docs: DataFrame, per_language: int):
    """Languages with their numbers of documents, and ``(language, word, n)`` of at most ``per_language`` documents of each."""
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    share = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(share) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    languages = [r.lang for r in share]
    spark = docs.sparkSession
    if not languages:
        return [], spark.createDataFrame([], "language int, word string, n long")
    # a hash threshold leaves about twice the bound, whatever the table; the window then cuts exactly
    turns = spark.createDataFrame([(r.lang, i, min(1.0, 2 * per_language / r.n)) for i, r in enumerate(share)], "lang string, language int, cut double")
    turn = F.xxhash64("doc_id", F.lit("language"))
    chosen = (usable.select("doc_id", "lang", turn.alias("turn")).join(F.broadcast(turns), "lang")
              .where(F.pmod("turn", F.lit(1 << 30)) < F.col("cut") * (1 << 30))
              .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("turn", "doc_id"))).where(F.col("rank") <= per_language)
              .select("doc_id", "lang", "language").distinct())  # at most MAX_LANGUAGES * per_language rows of three values
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("language", "text")
    words = rows.mapInArrow(bk.tidy(_count_words), "language int, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))
    return [(r.lang, r.n) for r in share], written(words, "language-words")


def train(docs: DataFrame, per_language: int = 3_000, rounds: int = 3, pooled: float = 500.0, floor: float = 0.1,
          model_file: str | None = None) -> Model:
    """Piece probabilities of each language by ``rounds`` of expectation maximisation.

    A language's expected counts are smoothed by ``pooled`` counts that follow all languages together,
    and those by ``floor`` for each piece.
    """
    model_file = model_file or default_model()
    found, words = training_words(docs, per_language)
    languages, spark = [x[0] for x in found], docs.sparkSession
    size = vocabulary(model_file).size
    weights = np.full((size, len(languages)), -np.log(size))
    if not languages:
        return Model([], weights, np.zeros(0), model_file)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(weights)

        def expect(batches, held=held):
            trie, now = vocabulary(model_file), held.value
            total: dict[int, np.ndarray] = {}
            for b in batches:
                language = b.column("language").to_numpy()
                texts, times = b.column("word").to_pylist(), b.column("n").to_numpy()
                for code in np.unique(language).tolist():
                    mine = np.flatnonzero(language == code)
                    own = [SPACE + texts[i] for i in mine.tolist()]
                    for lo, hi in _chunks(own):
                        total[code] = total.get(code, 0) + expected_counts(trie, own[lo:hi], times[mine[lo:hi]], now[:, code])
            for code, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, code), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])],
                                                 ["language", "piece", "n"])

        counts = words.mapInArrow(bk.tidy(expect), "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros_like(weights)  # languages x vocabulary at most
        seen[counts.column("piece").to_numpy(), counts.column("language").to_numpy()] = counts.column("n").to_numpy()
        everyone = seen.sum(axis=1) + floor
        weights = np.log(seen + pooled * (everyone / everyone.sum())[:, None]) - np.log(seen.sum(axis=0) + pooled)
        held.unpersist()
    n = np.array([x[1] for x in found], float)
    return Model(languages, weights, np.log(n / n.sum()), model_file)


# --- prediction -----------------------------------------------------------------
class _Remembered:
    """Log probabilities of words by their hash, sorted; dropped when they outgrow the bound."""

    def __init__(self, model: Model, trie: Vocabulary):
        self.model, self.trie = model, trie
        self.clear()

    def clear(self):
        self.keys = np.empty(0, np.uint64)
        self.values = np.empty((0, len(self.model.languages)))

    def find(self, hashes: np.ndarray, words) -> np.ndarray:
        """Rows for ascending ``hashes``; ``words(places)`` spells those that are new."""
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(hashes.size, bool)
        inside = at < self.keys.size
        known[inside] = self.keys[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if new.size:
            spelt = [SPACE + w for w in words(new)]
            fresh = np.concatenate([log_probabilities(self.trie, spelt[lo:hi], self.model.weights) for lo, hi in _chunks(spelt)])
            keys = np.concatenate((self.keys, hashes[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], np.concatenate((self.values, fresh))[order]
            at = np.searchsorted(self.keys, hashes)
        found = self.values[at]
        if self.values.nbytes + self.keys.nbytes > _MEMORY:
            self.clear()
        return found


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (any columns, one of them ``text``, read as empty where null) with ``lang_pred`` and ``score``."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in rows.schema.fields if f.name != "text"]
    letters = r"\p{L}"

    def run(batches):
        m = held.value
        names = np.array([*m.languages, UNDETERMINED], object)
        memory = _Remembered(m, vocabulary(m.model_file))
        for b in batches:
            n = len(b)
            total = np.tile(m.prior, (n, 1))
            for lo, hi, part, starts, ends, first in _words(b.column("text")):
                hashes, at, back = np.unique(bk.hash_spans(part, starts, ends, fold=False), return_index=True, return_inverse=True)
                raw = part.tobytes()
                value = memory.find(hashes, lambda new: [raw[starts[i]:ends[i]].decode() for i in at[new]])
                sums = np.concatenate((np.zeros((1, value.shape[1])), np.cumsum(value[back], axis=0)))
                total[lo:hi] += sums[first[1:]] - sums[first[:-1]]
            best, score = np.full(n, len(m.languages)), np.zeros(n)
            sure = np.flatnonzero(pc.match_substring_regex(b.column("text"), letters).to_numpy(zero_copy_only=False).astype(bool))
            if m.languages and sure.size:
                mine = total[sure] - total[sure].max(axis=1, keepdims=True)
                best[sure] = mine.argmax(axis=1)
                score[sure] = 1 / np.exp(mine).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(names[best], pa.string()), pa.array(score)],
                                             [*[f.name for f in fields], "lang_pred", "score"])

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.withColumn("text", text_or_empty()).mapInArrow(bk.tidy(run), schema)


def report(docs: DataFrame, **params) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, train(docs, **params)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
