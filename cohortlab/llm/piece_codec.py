"""SentencePiece BPE encoding by backtracking, and decoding (operator 10).

A piece sequence is what merging by score gives if, and only if, every piece re-merges
to itself and every two neighbours re-merge to those two. So the encoder walks the text
with the longest piece at each place (Aho-Corasick), keeps it if it is compatible with
its neighbour, else tries the next shorter piece, and steps back when none is left; a
bitfield of the positions proven to have no continuation bounds the work.

The text is cut into units first where no piece can cross: before a run of spaces, and
between a letter and a character that no piece has behind a letter. Within a unit,
characters of no piece become byte pieces. Each unit is encoded once by a worker while it
is in a bounded memory. Normalisation is the model's: a space is put before a text that
is not empty, and each space becomes U+2581; models that ask for more are refused.

Defined results: null and empty texts have no ids and decode to the empty text. Rows
are independent; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import text_or_empty

SPACE = "▁"
_MEMORY = 240_000  # units remembered by a worker; about 80 MB


class PieceCodec:
    """Encoder and decoder for one model file (merge type with byte fallback, identity normaliser)."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else p.replace(SPACE, " ").encode()
                    for i, p in enumerate(self.pieces)]
        self.shown = [str(i) for i in range(n)]
        if len(self.bytes) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a merge-type model with byte fallback and without unused pieces is needed")
        if sp.normalize("a  ﬁé ") != f"{SPACE}a{SPACE}{SPACE}ﬁé{SPACE}":
            raise ValueError("the model must normalise by the identity with a space in front")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a space")
        self.alphabet = {c for p in self.ids for c in p}
        # pieces that re-merge to themselves: only those can be in an encoding
        self.whole = {p for p in self.ids if len(p) == 1 or _merge_by_score(p, self.score) == [p]}
        after = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        letters = {c for c in self.alphabet if c.isalpha()}
        ends = {b for a, b in after if a in letters}
        # what no piece has behind a letter: a unit may end there
        self.units_of = _unit_pattern(letters, self.alphabet - letters - ends - {SPACE, "\n"})
        self.trie = ahocorasick.Automaton()
        for p in self.whole:
            self.trie.add_word(p, (len(p) - 1, p))
        self.trie.make_automaton()
        # the next shorter piece that begins a piece
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), None) for p in self.whole}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    # --- encoding ---------------------------------------------------------------
    def compatible(self, a: str, b: str) -> bool:
        """Do the two pieces, written together, re-merge to these two?"""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            got = self.pairs[a, b] = _merge_by_score(a + b, self.score) == [a, b]
        return got

    def _walk(self, text: str) -> list[str]:
        """The pieces of a text whose characters all occur in pieces."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, (k, piece) in self.trie.iter(text):  # of one start, the longest ends last
            longest[end - k] = piece
        known, shorter = self.pairs.get, self.shorter
        dead = None  # a bitfield; bit i: no valid encoding passes a boundary at i
        out: list[str] = []
        at, piece, last = 0, longest[0], None
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if dead is None or not dead[end >> 3] >> (end & 7) & 1:
                    if last is None:
                        break
                    ok = known((last, piece))
                    if self.compatible(last, piece) if ok is None else ok:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                last, at = piece, end
                piece = longest[at] if at < n else None
            else:
                if dead is None:
                    dead = bytearray(n // 8 + 1)
                dead[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                last = out[-1] if out else None
                at -= len(piece)
                piece = shorter[piece]
        return out

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a unit: runs of known characters are walked, others become byte pieces."""
        ids = self.ids
        if self.alphabet.issuperset(unit):
            return [ids[p] for p in self._walk(unit)]
        out, known = [], []
        for c in unit:
            if c in self.alphabet:
                known.append(c)
                continue
            if known:
                out += [ids[p] for p in self._walk("".join(known))]
                known = []
            out += [self.bytes[x] for x in c.encode()]
        if known:
            out += [ids[p] for p in self._walk("".join(known))]
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of ids: U+2581 as space, byte pieces as they are, control pieces as nothing."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def _unit(self, unit: str) -> tuple[int, str, bytes]:
        got = self.units.get(unit)
        if got is None:
            got = self.older.pop(unit, None)
            if got is None:
                ids = self.encode_unit(unit)
                shown = self.shown
                got = (len(ids), ",".join([shown[i] for i in ids]), self.decode_bytes(ids))
            if len(unit) <= 64:
                if len(self.units) >= _MEMORY // 2:
                    self.older, self.units = self.units, {}
                self.units[unit] = got
        return got

    def split(self, text: str) -> list[str]:
        return self.units_of.findall((SPACE + text).replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for u in self.split(text) for i in self.encode_unit(u)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one leading space is the model's own and goes."""
        ids = list(ids)
        first = next((k for k, i in enumerate(ids) if i not in self.control), len(ids))
        raw = self.decode_bytes(ids[first:])
        if first < len(ids) and self.pieces[ids[first]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        n, sep, ids, decoded = 0, b"", hashlib.sha256(), hashlib.sha256()
        units = self.split(text)
        known = self.units.get
        for lo in range(0, len(units), 4096):
            part = [known(u) or self._unit(u) for u in units[lo:lo + 4096]]
            n += sum([p[0] for p in part])
            ids.update(sep + ",".join([p[1] for p in part]).encode())
            raw = b"".join([p[2] for p in part])
            decoded.update(raw if lo else raw[1:])
            sep = b","
        return n, ids.hexdigest(), decoded.hexdigest()


def _unit_pattern(letters: set[str], stops: set[str]) -> re.Pattern:
    """A run of spaces with what follows up to the next one, a line end, or a letter with a stop behind it."""
    cls = lambda chars: "".join(re.escape(c) for c in sorted(chars))
    ends = f"{SPACE}*[{cls(letters)}]++(?=[{cls(stops)}])|" if letters and stops else ""
    return re.compile(f"{ends}{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


def _merge_by_score(text: str, score: dict[str, float]) -> list[str]:
    """Merge neighbours to the best-scored piece, the leftmost first, until none is left."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            return parts
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for a process and model file."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row."""
    model_file = model_file or default_model()

    def run(batches):
        c = codec(model_file)
        for b in batches:
            rows = [c.digest(t.as_py()) for t in b.column("text")]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(bk.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids themselves, and the text they decode to."""
    model_file = model_file or default_model()

    def run(batches):
        c = codec(model_file)
        for b in (x.slice(i, 64) for x in batches for i in range(0, len(x), 64)):
            ids = [c.encode(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array([c.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(bk.tidy(run), "doc_id long, ids array<int>, decoded string")
