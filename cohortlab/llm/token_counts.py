"""Token counts of sections by offset-mapped attribution (operator 9).

Every document is encoded once, as a whole, with a byte-level BPE (tiktoken ranks); the
tokens' byte lengths give each token's span in the text. Sections (lines, with the line
feed that ends them) are spans too, and the two ordered lists are interval-joined by
binary search, in blocks of rows. A token that crosses a boundary belongs, by an explicit rule, to the
section that holds most of its bytes, on a tie to the earlier one (``rule="most"``), or
to the one it begins in (``"start"``) or ends in (``"end"``). So the sections' counts add up to the document's.

``count_fields`` does the same for a document put together from several columns.

A run of letters, marks or white space of thousands of characters is one stretch to the encoder's pattern, whose
library overflows its stack or merges in quadratic time there. Such texts are cut by the same pattern, and
their long stretches are merged by a second library with a heap (``single_piece``), which has the merges that the ranks imply.

Defined results: a null text is empty; the empty text has no sections and 0 tokens. An
empty last line (behind a final line feed) is no section. Rows are independent.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import text_or_empty

RULES = ("most", "start", "end")
_LONG = 4096  # characters of a stretch that the usual encoder doesn't get
_LONG_SPACE = re.compile(rf"\s{{{_LONG}}}")
_encoders: dict[str, tuple] = {}
_single: dict[str, object] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks_file: str):
    """The encoding of a ranks file and the byte length of each id; one for a process."""
    if ranks_file not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            length[i] = len(token)
        _encoders[ranks_file] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), length
    return _encoders[ranks_file]


def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens of lower rank that are merged to ``token`` last."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
        at = min(range(len(pairs)), key=pairs.__getitem__)
        if pairs[at] >= rank:
            raise ValueError("the ranks are not those of a byte-pair encoding")
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def single_piece(ranks_file: str):
    """Encoder of one stretch, whatever its length, by the merges that the ranks imply; one for a process."""
    if ranks_file not in _single:
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        letter = _byte_letters()
        shown = lambda token: "".join([letter[b] for b in token])
        merges = [tuple(map(shown, _halves(t, r, ranks))) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        whole = Tokenizer(models.BPE({shown(t): r for t, r in ranks.items()}, merges))
        whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        _single[ranks_file] = whole
    return _single[ranks_file]


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def encode_text(ranks_file: str, text: str) -> list[int]:
    """Ids of a whole text."""
    encoding, _ = encoder(ranks_file)
    if len(text) < _LONG or not (_LONG_SPACE.search(text) or max(map(len, text.split()), default=0) >= _LONG):
        return encoding.encode_ordinary(text)
    import public_tokenizers

    out, done = [], 0
    for stretch in regex.finditer(public_tokenizers.PATTERN, text):
        if stretch.end() - stretch.start() >= _LONG:  # a stretch's borders are borders of the text before it, too
            out += encoding.encode_ordinary(text[done:stretch.start()])
            out += single_piece(ranks_file).encode(stretch.group(), add_special_tokens=False).ids
            done = stretch.end()
    return out + encoding.encode_ordinary(text[done:])


def attribute(token_ends: np.ndarray, token_sizes: np.ndarray, section_ends: np.ndarray, rule: str = "most"):
    """Tokens of each section, and tokens that cross into the next one.

    All in bytes of one run of text: both lists of ends ascend and have the same last end.
    """
    begins = token_ends - token_sizes
    first = np.searchsorted(section_ends, begins, "right")     # the section of its first byte
    last = np.searchsorted(section_ends, token_ends - 1, "right")  # and of its last
    crossing = np.flatnonzero(first != last)
    owner = last.copy() if rule == "end" else first.copy()
    if rule == "most":
        for t in crossing.tolist():
            edges = np.clip(np.concatenate(([begins[t]], section_ends[first[t]:last[t] + 1])), begins[t], token_ends[t])
            owner[t] = first[t] + int(np.argmax(np.diff(edges)))  # argmax: the earlier of equals
    n = section_ends.size
    return np.bincount(owner, minlength=n)[:n], np.bincount(first[crossing], minlength=n)[:n]


def _encode(ranks_file, texts, sections, rule):
    """Per row ``(tokens, section sizes in code points, tokens, crossing)``; ``sections`` gives byte ends per row."""
    _, length = encoder(ranks_file)
    out = []
    for text, ends in zip(texts, sections):
        ids = np.array(encode_text(ranks_file, text), np.int64)
        if not ids.size:
            out.append((0, np.zeros(ends.size, np.int64), np.zeros(ends.size, np.int64)))
            continue
        sizes = length[ids]
        out.append((ids.size, *attribute(np.cumsum(sizes), sizes, ends, rule)))
    return out


def _line_ends(raw: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if not raw or raw.endswith(b"\n") else np.append(ends, len(raw))


def count_lines(docs: DataFrame, rule: str = "most", ranks_file: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, n_sections, n_crossing, starts, counts)``: code point start and tokens of each line."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks_file = ranks_file or default_ranks()

    def run(batches):
        for b in (x.slice(i, 512) for x in batches for i in range(0, len(x), 512)):
            data, offsets = bk.string_bytes(b.column("text"))
            raws = bk.text_array(data, offsets, 0, len(b))
            ends = [_line_ends(r) for r in raws]
            rows = _encode(ranks_file, [r.decode() for r in raws], ends, rule)
            starts = []
            for r, e in zip(raws, ends):
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(r, np.uint8) & 0xC0) != 0x80)))
                starts.append(chars[np.concatenate(([0], e[:-1]))] if e.size else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([e.size for e in ends], pa.int64()),
                pa.array([int(r[2].sum()) for r in rows], pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "starts", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(bk.tidy(run), "doc_id long, n_tokens long, n_sections long, n_crossing long, starts array<long>, counts array<long>")


def count_fields(rows: DataFrame, key: str, fields: list[str], glue: str = "\n\n", rule: str = "most",
                 ranks_file: str | None = None) -> DataFrame:
    """``(key, n_tokens, one column per field)``: fields joined by ``glue`` (which counts with the field before it), encoded as one text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks_file = ranks_file or default_ranks()
    names = [f"f{i}" for i in range(len(fields))]

    def run(batches):
        for b in (x.slice(i, 512) for x in batches for i in range(0, len(x), 512)):
            parts = [[(t or "") + (glue if i < len(fields) - 1 else "") for t in b.column(n).to_pylist()] for i, n in enumerate(names)]
            texts = ["".join(p) for p in zip(*parts)]
            ends = [np.cumsum([len(x.encode()) for x in p]) for p in zip(*parts)]
            got = _encode(ranks_file, texts, ends, rule)
            cols = [pa.array([int(g[1][i]) for g in got], pa.int64()) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([g[0] for g in got], pa.int64()), *cols], ["k", "n_tokens", *names])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("k"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names)]).mapInArrow(bk.tidy(run), f"k {kind}, n_tokens long, " + ", ".join(f"{n} long" for n in names))
    return out.select(F.col("k").alias(key), "n_tokens", *[F.col(n).alias(f"n_{f}") for f, n in zip(fields, names)])


def report(docs: DataFrame) -> DataFrame:
    """Per row: totals, and the lines as ``start:tokens`` joined by commas."""
    rows = count_lines(docs)
    lines = F.zip_with("starts", "counts", lambda s, n: F.concat_ws(":", s.cast("string"), n.cast("string")))
    return rows.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.array_join(lines, ",").alias("sections"))
