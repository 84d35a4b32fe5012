"""Alignment of two tokenizers' tokens by diagonal run skipping (operator 13).

Tokenizer A is a byte-level BPE (``tokenizers`` file), B a SentencePiece BPE with byte
fallback; both see the text with one space in front. Each token sequence becomes the ascending array of
its tokens' byte ends, and the two arrays are walked together at an index shift: as long as
``a[i + k] == b[i + shift + k]`` the tokens are one-to-one, and exponential probing (1, 2, 4, ...
ends compared at once, then halved back) jumps to the end of such a stretch. Where the ends
differ, the shorter side is advanced until both end together again; that irregular group changes
the shift, and probing goes on from there. Each common end closes a group and links the two tokens that end there.

Tokens that end together share their last bytes, so one's bytes are a suffix of the other's.
The id pairs that can ever be linked are thus bounded by the two vocabularies alone
(``pair_bound``: 324,299 for the default files), whatever the corpus. The corpus-wide
counts are summed by Spark from each document's distinct pairs; the table of at most that many rows
is broadcast, and every document's links are scored against it.

A worker encodes each unit once while it is in a bounded memory: a text is cut before single spaces and line feeds
whose neighbours are letters, digits or ASCII marks, where neither vocabulary has a token across. New units are put
together and encoded in one call by each library.

Defined results: texts that are null or empty, or whose tokens' bytes don't join up to space + text (a
text with U+2581, say), have no tokens: zeros and the empty string. Rows are independent;
extra columns are not read. Rows without doc_id are aligned and counted too.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import text_or_empty, written

_MEMORY = 300_000   # units remembered by a worker; about 75 MB
_UNIT = 64          # bytes; longer units are not remembered
_CALL = 512         # new units encoded in one call; more are slower, as the libraries' heaps outgrow the cache
_EDGE = r"!-~\w"    # never white space to either tokenizer
# Fixed value: the byte-level pre-tokenizer's pattern.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile("[\n -~\u00c0-\u024f]*")  # letters of every Unicode version since 3.2, so all libraries agree on them
_REGULAR = re.compile(rf"[{_EDGE}]++(?:[ \n][{_EDGE}]++)*+")
_CUT = re.compile(rf"(?<=[{_EDGE}])(?: (?=[{_EDGE}])|(?=\n[{_EDGE}]))")
_CLEAN = re.compile(rf"\n?[{_EDGE}](?:.*[{_EDGE}])?\Z", re.DOTALL)


def diagonal_runs(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Index pairs of the common values of two strictly ascending lists that end in the same value.

    One-to-one stretches are jumped by exponential probing at the present shift, irregular groups are resolved locally.
    """
    at_a: list[int] = []
    at_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        while x != y:  # an irregular group: the side that is behind goes on
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        at_a.append(i)
        at_b.append(j)
        i, j = i + 1, j + 1
        if i < n and a[i] == b[j]:  # a stretch begins at this shift
            start, k = i, 2
            i, j = i + 1, j + 1
            while i + k <= n and a[i:i + k] == b[j:j + k]:
                i, j, k = i + k, j + k, 2 * k
            while k > 1:
                k //= 2
                if i + k <= n and a[i:i + k] == b[j:j + k]:
                    i, j = i + k, j + k
            at_a.extend(range(start, i))
            at_b.extend(range(j - (i - start), j))
    return at_a, at_b


def units_of(text: str) -> list[str]:
    """The units of a text, a leading space left off: ``literal`` gives the whole unit."""
    if _REGULAR.fullmatch(text):
        return text.replace("\n", " \n").split(" ")
    units = _CUT.split(text)
    if units[0][0] in " \n":
        units[0] = " " + units[0]
    return units


def literal(unit: str) -> str:
    return unit if unit[0] in " \n" else " " + unit


class TokenPair:
    """The two tokenizers, their tokens' bytes, and a bounded memory of encoded units."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_file)
        self.bytes_a, self.bytes_b = _byte_level_tokens(a_file), _piece_tokens(self.b)
        self.ranks = _as_ranks(a_file, self.bytes_a)
        if any(" " in t.lstrip(b" ").decode("latin-1") for t in self.bytes_b):
            raise ValueError("a piece of B crosses a space")
        self.n_b = len(self.bytes_b)
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        shown = [[f"{i}{mark}" for i in range(len(t))] for t, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for mark in marks]
        self.shown = np.array(sum(shown, []), object)  # A inside, A last of its group, B inside, B last
        self.base = np.cumsum([0] + [len(s) for s in shown])[:4].tolist()
        self.units: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # ids of A and of B, as the bytes of an array
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def encode_run(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for ``text`` (which begins with a space) and of B for what is behind that space."""
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int32), np.array(self.b.encode(text[1:]), np.int32)

    def same_bytes(self, ids: np.ndarray, tokens: list[bytes], raw: bytes) -> bool:
        return b"".join([tokens[i] for i in ids.tolist()]) == raw

    def _checked(self, unit: str):
        text = literal(unit)
        if text[0] == "\n":  # the libraries see a word before the line feed
            found = self._checked(" a" + text)
            lone = self._checked(" a")
            return found and tuple(f[len(x):] for f, x in zip(found, lone))
        ids_a, ids_b = self.encode_run(text)
        raw = text.encode()
        if self.same_bytes(ids_a, self.bytes_a, raw) and self.same_bytes(ids_b, self.bytes_b, raw):
            return ids_a.tobytes(), ids_b.tobytes()
        return None

    def _encode_clean(self, units: list[str], lead: str) -> None:
        """Encode clean units, all led by a space or all by the line feed they begin with, in one call, and remember them."""
        text = " a" + lead + lead.join(units)  # the libraries see a word in front
        raw = text.encode()
        # the same ranks in tiktoken, where the pattern's classes are the same beyond doubt
        ids_a = (np.array(self.ranks.encode_ordinary(text), np.int32) if self.ranks and _LATIN.fullmatch(text) else
                 np.array(self.a.encode(text, add_special_tokens=False).ids, np.int32))
        ids_b = np.array(self.b.encode(text[1:]), np.int32)
        sizes = [len(u) for u in units] if len(raw) == len(text) else [len(u.encode()) for u in units]
        ends = np.cumsum([2, *sizes]) + len(lead) * np.arange(len(units) + 1)
        for known, ids, size, tokens in ((self.units[0], ids_a, self.size_a, self.bytes_a), (self.units[1], ids_b, self.size_b, self.bytes_b)):
            at = np.cumsum(size[ids])
            cut = np.searchsorted(at, ends)
            if not (self.same_bytes(ids, tokens, raw) and np.array_equal(at[cut], ends)):
                for unit in units:  # some unit's pieces lose bytes: each by itself, when it is met
                    self.units[0].pop(unit, None)
                return
            cuts, whole = ((cut + 1) * 4).tolist(), ids.tobytes()
            known.update(zip(units, [whole[x:y] for x, y in zip(cuts[:-1], cuts[1:])]))

    def learn(self, texts: list[list[str]]) -> None:
        """Encode those units of the texts that are not in the memory."""
        if len(self.units[0]) >= _MEMORY // 2:
            self.older, self.units = self.units, ({}, {})
        (a, b), (older_a, older_b) = self.units, self.older
        runs: dict[tuple[bool, str], list[str]] = {}
        for unit in set().union(*texts).difference(a):
            if unit in older_a:
                a[unit], b[unit] = older_a[unit], older_b[unit]
            elif len(unit) <= _UNIT and "▁" not in unit and _CLEAN.match(unit):
                runs.setdefault((_LATIN.fullmatch(unit) is not None, "" if unit[0] == "\n" else " "), []).append(unit)
        for (_, lead), new in runs.items():
            for i in range(0, len(new), _CALL):
                self._encode_clean(new[i:i + _CALL], lead)

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a whole text given its units, or None where the bytes don't join up to it."""
        a, b = (list(map(known.get, units)) for known in self.units)
        if None in a:  # not in the memory, or without tokens
            for i in [i for i, x in enumerate(a) if x is None]:
                found = self._checked(units[i])
                if found is None:
                    return None
                a[i], b[i] = found
        return tuple(np.frombuffer(b"".join(x), np.int32) for x in (a, b))

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray):
        """Places (in A and in B) of the tokens that close each group."""
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        at_a, at_b = diagonal_runs(ends_a.tolist(), ends_b.tolist())
        return np.array(at_a, np.int64), np.array(at_b, np.int64)

    def groups_text(self, ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups in order."""
        n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)  # tokens of each group
        code_a, code_b = ids_a + np.int64(self.base[0]), ids_b + np.int64(self.base[2])
        code_a[at_a] += self.base[1] - self.base[0]
        code_b[at_b] += self.base[3] - self.base[2]
        before_a = np.repeat(np.cumsum(n_b) - n_b, n_a)  # B tokens in earlier groups
        before_b = np.repeat(np.cumsum(n_a), n_b)        # A tokens up to this group
        code = np.empty(ids_a.size + ids_b.size, np.int64)
        code[np.arange(ids_a.size) + before_a] = code_a
        code[np.arange(ids_b.size) + before_b] = code_b
        return "".join(self.shown[code].tolist())[:-1]

    def pair_bound(self) -> int:
        """How many (A id, B id) pairs have one token's bytes as a suffix of the other's."""
        count_a, count_b = Counter(self.bytes_a), Counter(self.bytes_b)
        longer_a = sum(n * count_b[t[k:]] for t, n in count_a.items() for k in range(len(t)))
        return longer_a + sum(n * count_a[t[k:]] for t, n in count_b.items() for k in range(1, len(t)))


def _byte_level_tokens(file: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file."""
    with open(file, encoding="utf-8") as f:
        model = json.load(f)
    vocab = dict(model["model"]["vocab"]) | {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    # byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token)
    return out


def _as_ranks(file: str, tokens: list[bytes]):
    """The same BPE for tiktoken, or None if the file's merges or pattern are not those of plain ranks."""
    import tiktoken

    with open(file, encoding="utf-8") as f:
        model = json.load(f)
    pre, merges, vocab = model.get("pre_tokenizer") or {}, model["model"]["merges"], model["model"]["vocab"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("normalizer"):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    ranks = {t: i for i, t in enumerate(tokens) if i < 256 + len(pairs)}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(pairs) else None


def _piece_tokens(sp) -> list[bytes]:
    """The bytes of each id of a SentencePiece model; control and unknown pieces have none."""
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i)
            else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]


_pairs: dict[tuple[str, str], TokenPair] = {}


def token_pair(a_file: str, b_file: str) -> TokenPair:
    """One pair of tokenizers for a process."""
    if (a_file, b_file) not in _pairs:
        _pairs[a_file, b_file] = TokenPair(a_file, b_file)
    return _pairs[a_file, b_file]


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _rows(batches, files):
    """Slices of batches with the units of each text, encoded."""
    pair = token_pair(*files)
    for b in (x.slice(i, 128) for x in batches for i in range(0, len(x), 128)):
        units = [units_of(t) if t else [] for t in b.column("text").to_pylist()]
        pair.learn(units)
        yield pair, b, units


def aligned(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times)`` of every row.

    ``pairs`` are the distinct linked id pairs as ``a * vocabulary of B + b``, ``times`` how often each is linked in the row.
    """
    files = files or default_files()

    def run(batches):
        for pair, b, texts in _rows(batches, files):
            n_a, n_b, n_groups, digests, pairs, times = [], [], [], [], [], []
            for units in texts:
                ids = pair.ids(units) if units else None
                if ids is None:
                    found = (0, 0, 0, "", [], [])
                else:
                    at_a, at_b = pair.align(*ids)
                    shown = pair.groups_text(*ids, at_a, at_b)
                    keys, n = np.unique(ids[0][at_a].astype(np.int64) * pair.n_b + ids[1][at_b], return_counts=True)
                    found = (ids[0].size, ids[1].size, at_a.size, hashlib.sha256(shown.encode()).hexdigest(), keys, n)
                for column, value in zip((n_a, n_b, n_groups, digests, pairs, times), found):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)], pa.array(digests, pa.string()),
                 pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(bk.tidy(run), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>")


def groups(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """``(doc_id, groups)``: each group's A ids, B ids and the byte offset (in space + text) that closes it."""
    files = files or default_files()
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("ends", pa.int64())]))

    def run(batches):
        for pair, b, texts in _rows(batches, files):
            out = []
            for units in texts:
                ids = pair.ids(units) if units else None
                if ids is None:
                    out.append([])
                    continue
                at_a, at_b = pair.align(*ids)
                ends = np.cumsum(pair.size_a[ids[0]])[at_a].tolist()
                parts = zip(np.split(ids[0], at_a + 1), np.split(ids[1], at_b + 1), ends)
                out.append([{"a": x.tolist(), "b": y.tolist(), "ends": e} for x, y, e in parts])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(bk.tidy(run), "doc_id long, groups array<struct<a: array<int>, b: array<int>, ends: bigint>>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, n)`` of all links of ``aligned`` rows; combined before the shuffle to a bounded number of rows a task."""
    return (rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair"))
            .agg(F.sum("p.times").alias("n")))


def _scored(rows: DataFrame, files) -> DataFrame:
    """``rows`` with ``n_links``, ``n_best`` and ``count_sum`` instead of the pair arrays."""
    n_b = token_pair(*files).n_b
    counts = pair_counts(rows)
    best = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("top"))
    table = (counts.join(best, F.col("pair") % n_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
             .toArrow().sort_by("pair"))  # at most pair_bound() rows, whatever the corpus
    held = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        pairs, n, best = held.value
        for b in batches:
            lists, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            sizes = lists.value_lengths().to_numpy()
            at = np.searchsorted(pairs, lists.flatten().to_numpy())
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[cuts])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], *[pa.array(total(x), pa.int64()) for x in (
                    times, times * best[at], times * n[at])], b.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(bk.tidy(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def report(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """The query's columns; the aligned rows are written once, so no text is encoded twice."""
    files = files or default_files()
    return _scored(written(aligned(docs, files), "token-align", "zstd"), files)
