"""Word n-gram Jaccard self-join by universe partition and pigeonhole (operator 2).

Two sets with similarity 0.8 or more and sizes s <= l differ in at most (s + l) / 9
shingles. Sizes are cut into bands; the scheme of a band hashes the universe of shingles
into ``H + 1`` segments, H the most that a pair of that scheme can differ. Then one
segment is equal in both sets (pigeonhole). Each set is indexed by the subset it has in
each segment, under the scheme of its own band and, as the smaller partner, under the
next one; in the *flexible* segments also by its one-deletion neighbourhood (the subset
less one shingle each).

Allocation by cost: a set gives each segment 1 (equal subsets are looked up). A segment
whose list is long and joins sets that are not in one component yet (empty segments, a
passage that very many documents share) is dear: the set gives it 0 and a cheap flexible
segment 2 instead, which also finds subsets that differ by one shingle. The larger set of
a pair asks; it need not reach H + 1 but one more than what it can differ from smaller
sets, so no pair is lost. Where that doesn't suffice, the set keeps 1.

Sets of equal content are one class first. The class with most copies leads a list, as near
copies are mostly copies of it. Each set is first compared with the centres that lead most
of its lists, so a group of n near copies costs about n comparisons; lists whose members then still lie in different
components have their pairs looked at, as allocated. Sets that the same centre leads and that meet in very many lists are
a *family*; families and components that meet often are compared in blocks of sketches: a task takes two blocks of
some hundred members each and sends on only the pairs that the bound leaves, so a large group of texts just under the
threshold makes no row for each of its pairs.
The bound: the L1 distance of bucketed shingle counts never exceeds the real difference. What it leaves is
verified exactly on the shingles of the two texts.

Signatures travel in packed blocks; those that a task already holds twice send one row on
(its first member stands for the rest), so a hot signature doesn't gather in one task.

Shingles are identified by 64-bit hashes, classes by a 128-bit digest of the set;
signatures have 48 bits, as a clash only costs a comparison.

Defined results: no words (null, empty, white space): empty set, linked with nothing,
``component_id`` = its own doc_id. Repeated rows are members of one class; rows without
doc_id take part but never name a component (null if no other row does).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import connected_components, release, row_hash, text_or_empty, written

_FLEX_SHARE = 0.08
_FLUSH = 600_000   # signatures a task gathers before it sends blocks
_BLOCK = 500_000     # signatures a part of the index should have
_STARS = 3           # centres that a set is compared with at first
_DEAR = 12           # members from which a list of several components is dear
_ROW_COST = 8        # comparisons within blocks that cost no more than one row of a pair
_CELL, _CELL_BYTES = 256, 1 << 19   # members and bytes of sketches that a block should have
_NEXT, _FLEX, _LESS = 1, 2, 4   # bits of a row: next band's scheme, flexible segment, one shingle less; above: weight
_MOST_WEIGHT = 31


def bands(top: int, num: int = 4, den: int = 5) -> list[int]:
    """Band edges: each at least den/num times the one before, from 1 to past ``top``."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den // num)))
    return edges


def _scheme(edges: list[int], k: int) -> tuple[int, int]:
    """Segments of band k's scheme (the largest difference plus 1), and how many are flexible."""
    m = 2 * (edges[k + 1] - 1) // 9 + 1
    return m, min(m // 2, int(m * _FLEX_SHARE) + 5)


_EDGES = bands(1 << 34)


def _row_sets(batch_texts):
    """For blocks of rows: ``(lo, hi, values, bounds)``, the distinct shingle hashes of rows lo..hi."""
    data, offsets = bk.string_bytes(batch_texts)
    for lo, hi in bk.blocks(offsets):
        part, offs = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, first = bk.find_words(part, offs, bk.NON_SPACE)
        yield lo, hi, *bk.distinct_sorted(*bk.shingles(bk.hash_spans(part, starts, ends), first))


def _set_keys(batches):
    for b in batches:
        keys, sizes = [], []
        for _, _, values, bounds in _row_sets(b.column("text")):
            cuts = bounds.tolist()
            for x, y in zip(cuts[:-1], cuts[1:]):
                sizes.append(y - x)
                keys.append(hashlib.blake2b(values[x:y].tobytes(), digest_size=16).digest() if y > x else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())],
                                         ["doc_id", "rid", "set", "n_shingles"])


def _bands_of(sizes, shift):
    """Band (moved by ``shift``), segments and flexible segments of each size."""
    k = np.searchsorted(_EDGES, sizes, "right") - 1 + shift
    scheme = {int(x): _scheme(_EDGES, int(x)) for x in np.unique(k)}
    return k, np.array([scheme[int(x)][0] for x in k], np.int64), np.array([scheme[int(x)][1] for x in k], np.int64)


def _segment_rows(values, sizes, shift):
    """Signatures of a block of sets under the scheme of their own band (shift 0) or the next (1).

    Yields ``(set, signature, bits)``: the whole subset of each segment, then, for the
    flexible ones, the subset less one shingle.
    """
    k, m, flex = _bands_of(sizes, shift)
    base = np.concatenate(([0], np.cumsum(m)))
    row = np.repeat(np.arange(sizes.size), sizes)
    at = base[row] + (bk.mix(values ^ np.uint64(0xA5A5A5A5)) % m[row].astype(np.uint64)).astype(np.int64)
    code = bk.mix(values + np.uint64(0x51ED270B))
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, at, code)
    seg_row = np.repeat(np.arange(sizes.size), m)
    seg = np.arange(base[-1]) - base[seg_row]
    salt = bk.mix((k[seg_row].astype(np.uint64) << np.uint64(40)) + seg.astype(np.uint64))
    bits = np.where(seg < flex[seg_row], _FLEX, 0) + shift * _NEXT
    yield seg_row, bk.mix(total ^ salt), bits.astype(np.uint8)
    less = np.flatnonzero(seg[at] < flex[row])
    where = at[less]
    yield row[less], bk.mix((total[where] - code[less]) ^ salt[where]), np.full(less.size, _FLEX + _LESS + shift * _NEXT, np.uint8)


def _pack(sig, node, bits, centre=None):
    """One block: count, then the columns; nodes as offsets from the least."""
    least = int(node.min() if centre is None else min(node.min(), centre.min()))
    parts = [np.array([sig.size, least], np.int64), (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32),
             (node - least).astype(np.uint32), (sig >> np.uint64(32)).astype(np.uint16), bits]
    if centre is not None:
        parts.insert(3, (centre - least).astype(np.uint32))
    return b"".join(p.tobytes() for p in parts)


def _unpack(data, with_centre):
    n, least = np.frombuffer(data, np.int64, 2)
    at, cols = 16, []
    for kind in [np.uint32] * (2 + with_centre) + [np.uint16, np.uint8]:
        cols.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    sig = cols[0].astype(np.int64) + (cols[-2].astype(np.int64) << 32)
    return sig, cols[1] + least, cols[-1], (cols[2] + least if with_centre else None)


def _by_origin(batch):
    """The batch cut where the numbering (partition << 33 | row) passes to another partition:
    offsets between the nodes of a block then fit into 32 bits."""
    origin = batch.column("node").to_numpy() >> 33
    cuts = [0, *(np.flatnonzero(np.diff(origin)) + 1).tolist(), len(batch)]
    return [batch.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:]) if y > x]


def _signature_blocks(parts):
    """Blocks of signatures by part, and rows of lists that have two members here already."""

    def run(batches):
        held, size, turn, origin = [], 0, 0, None

        def flush():
            sig, node, bits = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((_MOST_WEIGHT - (bits >> 3), sig))  # the most copied text leads its lists
            sig, node, bits = sig[order], node[order], bits[order]
            new = np.ones(sig.size, bool)
            new[1:] = sig[1:] != sig[:-1]
            head = np.flatnonzero(new)
            lead = node[head][np.cumsum(new) - 1]
            twice = ~new & (node != lead)
            stands = np.zeros(sig.size, bool)
            stands[head[np.unique((np.cumsum(new) - 1)[twice])]] = True
            here = twice | stands
            out = [(-1 - turn, _pack(sig[here], node[here], bits[here], lead[here]))] if here.any() else []
            sig, node, bits = sig[head], node[head], bits[head]
            cuts = np.searchsorted(sig, (np.arange(parts + 1).astype(object) * (1 << 48) // parts).astype(np.uint64))
            out += [(p, _pack(sig[x:y], node[x:y], bits[x:y])) for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())],
                                              ["part", "data"])

        for b in (x for y in batches for x in _by_origin(y)):
            nodes = b.column("node").to_numpy()
            weights = (b.column("weight").to_numpy() << 3).astype(np.uint8)
            if size and nodes[0] >> 33 != origin:
                yield flush()
                held, size = [], 0
            turn, origin = int(nodes[0]), nodes[0] >> 33   # turn spreads the rows of lists over the parts
            for lo, hi, values, bounds in _row_sets(b.column("text")):
                sizes = np.diff(bounds)
                names, weight = nodes[lo:hi], weights[lo:hi]
                for shift in (0, 1):
                    for row, sig, bits in _segment_rows(values, sizes, shift):
                        held.append((sig & np.uint64((1 << 48) - 1), names[row], bits | weight[row]))
                        size += row.size
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _lists(batches):
    """All lists with two members or more: ``(sig, node, bits, centre)``, a row for each member."""
    names = ["sig", "node", "bits", "centre"]
    held = []
    for b in batches:
        for part, data in zip(b.column("part").to_pylist(), b.column("data")):
            sig, node, bits, centre = _unpack(data.as_buffer(), part < 0)
            if part < 0:
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(bits.astype(np.int32)), pa.array(centre)], names)
            else:
                held.append((sig, node, bits))
    if held:
        sig, node, bits = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((node, _MOST_WEIGHT - (bits >> 3), sig))
        sig, node, bits = sig[order], node[order], bits[order]
        same = np.zeros(sig.size + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        listed = same[1:] | same[:-1]
        sig, node, bits, new = sig[listed], node[listed], bits[listed], ~same[:-1][listed]
        if sig.size:
            head = np.flatnonzero(new)
            centre = node[head][np.cumsum(new) - 1]
            for x in range(0, sig.size, 100_000):
                part = slice(x, x + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(sig[part]), pa.array(node[part]), pa.array(bits[part].astype(np.int32)),
                                                  pa.array(centre[part])], names)


def _sketches(batches):
    """``(node, n, segments, flex, bins)``: size, segments and flexible segments of the band's scheme,
    and the counts of the set's shingles in 2^j buckets, about 4 a bucket, as bytes."""
    for b in batches:
        nodes, seen, sizes, bins = b.column("node").to_numpy(), [], [], []
        for lo, hi, values, bounds in _row_sets(b.column("text")):
            low = bk.mix(values + np.uint64(77))
            for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                width = 1 << max(4, (max(y - x, 1) // 4).bit_length())
                counts = np.bincount((low[x:y] & np.uint64(width - 1)).astype(np.int64), minlength=width)
                seen.append(nodes[lo + i]), sizes.append(y - x), bins.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
        _, segments, flex = _bands_of(np.array(sizes, np.int64), 0)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sizes, pa.int64()), pa.array(segments), pa.array(flex),
                                          pa.array(bins, pa.binary())], ["node", "n", "segments", "flex", "bins"])


def _may_link(batches):
    """Drop the pairs whose sketches already differ in more than (s + l) / 9."""
    for b in batches:
        na, nb = b.column("na").to_pylist(), b.column("nb").to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(b.column("bins_a"), b.column("bins_b"))):
            u, v = (np.frombuffer(z.as_buffer(), np.uint8).astype(np.int64) for z in (x, y))
            w = min(u.size, v.size)
            gap = int(np.abs(u.reshape(-1, w).sum(0) - v.reshape(-1, w).sum(0)).sum())
            keep.append(9 * gap <= na[i] + nb[i] and 5 * min(na[i], nb[i]) >= 4 * max(na[i], nb[i]))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sketch_block(column, row):
    """``(node, comp, n, {width: (places, counts)})`` of one row's list of members."""
    lo, hi = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    part = column.values.slice(lo, hi - lo)
    node, comp, n, bins = part.flatten()
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in bins]
    width = np.array([x.size for x in raw])
    by_width = {int(w): (np.flatnonzero(width == w), np.stack([x for x in raw if x.size == w]).astype(np.int32)) for w in np.unique(width)}
    return node.to_numpy(), comp.to_numpy(), n.to_numpy(), by_width


def _close_pairs(batches):
    """Of two blocks of members, the pairs of different components whose sketches differ in (s + l) / 9 at most."""
    for b in batches:
        for row, same in enumerate(b.column("same").to_pylist()):
            (node_a, comp_a, n_a, one), (node_b, comp_b, n_b, two) = (_sketch_block(b.column(c), row) for c in ("one", "two"))
            for wa, (at_a, u) in one.items():
                for wb, (at_b, v) in two.items():
                    w = min(wa, wb)
                    x, y = u.reshape(len(at_a), -1, w).sum(1), v.reshape(len(at_b), -1, w).sum(1)
                    step = max(1, (1 << 21) // y.size)
                    for k in range(0, len(at_a), step):
                        i, j = at_a[k:k + step, None], at_b[None, :]
                        gap = np.abs(x[k:k + step, None, :] - y[None, :, :]).sum(2)
                        keep = ((9 * gap <= n_a[i] + n_b[j]) & (5 * np.minimum(n_a[i], n_b[j]) >= 4 * np.maximum(n_a[i], n_b[j]))
                                & (comp_a[i] != comp_b[j]))
                        if same:
                            keep &= node_a[i] < node_b[j]
                        p, q = np.nonzero(keep)
                        if p.size:
                            left, right = node_a[at_a[k + p]], node_b[at_b[q]]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])


def _verify(batches):
    """Exact: 100 * intersection >= 80 * union."""
    for b in batches:
        ok = np.zeros(len(b), bool)
        step = max(1, int(len(b) * (4 << 20) / max(1, b.nbytes)))
        for at in range(0, len(b), step):
            part = b.slice(at, step)
            left, right = (_all_sets(part.column(c)) for c in ("text_a", "text_b"))
            for i, (x, y) in enumerate(zip(left, right)):
                both = np.concatenate((x, y))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok[at + i] = x.size > 0 and 100 * inter >= 80 * (x.size + y.size - inter)
        yield b.select(["a", "b"]).append_column("ok", pa.array(ok))


def _all_sets(texts):
    return [values[x:y] for _, _, values, bounds in _row_sets(texts)
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def set_keys(docs: DataFrame) -> DataFrame:
    """``(doc_id, rid, set, n_shingles)`` of every row; ``set`` is a digest of its shingles (null: empty)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rid"), text_or_empty().alias("text"))
    return rows.mapInArrow(bk.tidy(_set_keys), "doc_id long, rid long, set binary, n_shingles long")


def class_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(node, set, weight, text)``: a number, one text and a measure of its copies (twice their
    binary logarithm) for every class of equal sets, written."""
    reps = (keys.where("set IS NOT NULL").groupBy("set").agg(F.min(F.struct("doc_id", "rid")).alias("r"), F.count("*").alias("copies"))
            .select("set", F.col("r.doc_id").alias("rep_id"), F.col("r.rid").alias("rep_rid"),
                    F.least(F.lit(_MOST_WEIGHT), F.floor(F.log2("copies") * 2)).cast("int").alias("weight")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rid"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("rid") == F.col("rep_rid"))
    # of a repeated row one is enough; the node number is fixed by writing the table
    return written(rows.join(reps, same).select(F.monotonically_increasing_id().alias("node"), "set", "weight", "text"), "jaccard-texts", "zstd")


def links(texts: DataFrame, n_shingles: int) -> DataFrame:
    """Verified links ``(a, b)`` between classes; they span every component of the full join."""
    parts = max(1, n_shingles // _BLOCK)
    lists = written(texts.select("node", "weight", "text").mapInArrow(bk.tidy(_signature_blocks(parts)), "part long, data binary")
                    .repartition("part").mapInArrow(bk.tidy(_lists), "sig long, node long, bits int, centre long"), "jaccard-lists", "zstd")
    sketch = written(texts.select("node", "text").mapInArrow(bk.tidy(_sketches), "node long, n long, segments long, flex long, bins binary"), "jaccard-sketch")
    release(texts.sparkSession)
    led = written(_led(lists), "jaccard-led")
    seen = written(_check(_stars(led), sketch, texts), "jaccard-stars")
    release(texts.sparkSession)
    comps = connected_components(seen.where("ok").select("a", "b"), "jaccard")
    rest = written(_apart(lists, comps).join(sketch.select("node", F.col("n").alias("size"), "segments", "flex"), "node"), "jaccard-apart")
    release(texts.sparkSession)
    cross = _cross(rest, led, sketch).join(seen.select("a", "b"), ["a", "b"], "left_anti")
    more = written(_check(cross, sketch, texts), "jaccard-cross")
    return seen.where("ok").select("a", "b").union(more.where("ok").select("a", "b"))


def _led(lists: DataFrame) -> DataFrame:
    """``(node, centre, times)``: how many of a set's lists it leads itself, and the ``_STARS`` others that lead most of them."""
    # a list's centre in a task stands for its members there; over all tasks, one leads it
    lead = (lists.groupBy("sig").agg(F.min(F.struct((-F.shiftright("bits", 3)).alias("w"), "node")).alias("l"))
            .select("sig", F.col("l.node").alias("centre")))
    often = lists.drop("centre").join(lead, "sig").groupBy("node", "centre").agg(F.count("*").alias("times"))
    nth = F.row_number().over(Window.partitionBy("node", F.col("node") == F.col("centre")).orderBy(F.desc("times"), "centre"))
    return often.withColumn("nth", nth).where(F.col("nth") <= _STARS).drop("nth")


def _stars(led: DataFrame) -> DataFrame:
    """Each set with the centres that lead most of its lists: near copies share
    many lists, while strangers meet in a few. What is left out here comes up again in ``_cross``."""
    return (led.where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())


def _apart(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The lists whose members lie in different components, each with its length ``n``."""
    placed = lists.join(comps, "node", "left").select("sig", "node", "bits", F.coalesce("label", "node").alias("comp"))
    apart = (placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
             .where("lo <> hi").select("sig", "n"))
    return placed.join(apart, "sig")


def _cross(rest: DataFrame, led: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs between components, as each set's allocation asks for.

    The larger set of a pair asks, under the scheme of its own band: with l shingles it
    differs from a smaller partner in 2 l / 9 at most, and the sum of its allocation needs
    to be one more than that.

    A set's group is its family (the sets that the same centre leads most) if that one's members meet in more
    lists than a comparison of all of them in blocks costs, else its component. Every two sets of which one asks
    for the other are in one family, or in two groups that meet.
    """
    family = led.groupBy("node").agg(F.max(F.struct("times", (-F.col("centre")).alias("c"))).alias("m")).select("node", (-F.col("m.c")).alias("family"))
    rest = rest.join(written(family, "jaccard-families"), "node")
    rest = rest.withColumn("dear", F.col("n") > _DEAR)
    own = rest.where(F.col("bits").bitwiseAND(_NEXT) == 0)
    flexible, less = F.col("bits").bitwiseAND(_FLEX) > 0, F.col("bits").bitwiseAND(_LESS) > 0
    # flexible segments that can get 2: those without a dear list (counted low: a row each)
    one = Window.partitionBy("node")
    costly = (own.where("dear").withColumn("spoilt", F.sum(F.when(flexible, 1).otherwise(0)).over(one)).where(~less)
              .withColumn("nth", F.row_number().over(one.orderBy(F.desc("n"), "sig"))))
    spare = F.greatest(F.col("flex") - F.col("spoilt"), F.lit(0)) + F.col("segments") - 1 - F.floor(F.col("size") * 2 / 9)
    # the longest lists get 0 as far as that goes; the rest are looked up
    cols = ["sig", "node", "comp", "family", "size"]
    asking = written(own.where("NOT dear").select(*cols).union(costly.where(F.col("nth") > spare).select(*cols)), "jaccard-asking")
    members = written(rest.select("node", "comp", "family", "size").distinct(), "jaccard-members")

    def times(one, two, group, group_b):
        """How often groups meet: members of the one that ask times members of the other there, over all lists."""
        here, there = one.groupBy("sig", group).agg(F.count("*").alias("asked")), two.groupBy("sig", group_b).agg(F.count("*").alias("met"))
        return here, there, F.sum(F.col("asked") * F.col("met")).alias("times")

    here, there, total = times(asking, rest, "family", "family")
    tight = (here.join(there, ["sig", "family"]).groupBy("family").agg(total)
             .join(members.groupBy("family").agg(F.count("*").alias("held")), "family")
             .where((F.col("held") > 1) & (F.col("times") * _ROW_COST > F.col("held") * F.col("held"))).select("family", F.lit(True).alias("tight")))
    tight = written(tight, "jaccard-tight")
    group = F.when(F.col("tight"), F.col("family") * 2 + 1).otherwise(F.col("comp") * 2).alias("g")
    members = written(members.join(tight, "family", "left").select("node", "comp", "size", group)
                      .join(sketch.select("node", "bins"), "node"), "jaccard-grouped")
    asking = asking.join(tight, "family", "left").select("sig", "node", "comp", "size", group)
    other = rest.join(tight, "family", "left").select(
        "sig", F.col("node").alias("node_b"), F.col("comp").alias("comp_b"), F.col("size").alias("size_b"), group.alias("g_b"))
    # little data, many pairs: keep the number of partitions
    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asking, other = asking.repartition(n, "sig"), other.repartition(n, "sig")
    here, there, total = times(asking, other, "g", "g_b")
    met = here.join(there, "sig").where("g <> g_b").select("sig", "g", "g_b", "asked", "met")
    held = written(members.groupBy("g").agg(F.count("*").alias("held"), F.greatest(
        F.ceil(F.count("*") / _CELL), F.ceil(F.sum(F.octet_length("bins")) / _CELL_BYTES)).cast("int").alias("cells")), "jaccard-held")
    meets = met.groupBy("g", "g_b").agg(total)
    meets = written(meets.join(held.select("g", "held"), "g").join(held.select(F.col("g").alias("g_b"), F.col("held").alias("held_b")), "g_b")
                    .select("g", "g_b", (F.col("times") * _ROW_COST > F.col("held") * F.col("held_b")).alias("whole"),
                            (F.col("held") * F.col("held_b") <= _ROW_COST).alias("few")), "jaccard-meets")
    # groups that meet often: all their members, in blocks unless they are few; else list by list
    often = meets.where("whole").select(F.least("g", "g_b").alias("g"), F.greatest("g", "g_b").alias("g_b"), "few").distinct()
    whole = (often.where("NOT few").drop("few").union(tight.select((F.col("family") * 2 + 1).alias("g"), (F.col("family") * 2 + 1).alias("g_b"))))
    near = (F.least("size", "size_b") * 5 >= F.greatest("size", "size_b") * 4) & (F.col("comp") != F.col("comp_b"))
    theirs = members.select(F.col("g").alias("g_b"), F.col("node").alias("node_b"), F.col("comp").alias("comp_b"), F.col("size").alias("size_b"))
    few = often.where("few").join(members.drop("bins"), "g").join(theirs, "g_b").where(near)
    single = (met.select("sig", "g", "g_b").join(meets.where("NOT whole"), ["g", "g_b"]).select("sig", "g", "g_b")
              .join(asking, ["sig", "g"]).join(other, ["sig", "g_b"]).where(near & (F.col("size_b") <= F.col("size"))))
    pair = [F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")]
    return _in_blocks(whole, members, held).union(few.select(*pair)).union(single.select(*pair)).distinct()


def _in_blocks(whole: DataFrame, members: DataFrame, held: DataFrame) -> DataFrame:
    """Close pairs ``(a, b)`` of all members of each two groups ``(g, g_b)``, block by block; a pair of blocks is a row,
    dealt by both, so the blocks of a large group are spread."""
    cell = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell")
    blocks = (members.join(held.select("g", "cells"), "g").select("g", cell, F.struct("node", "comp", F.col("size").alias("n"), "bins").alias("m"))
              .groupBy("g", "cell").agg(F.collect_list("m").alias("block")))
    blocks = written(blocks, "jaccard-blocks")
    cells = held.select("g", F.sequence(F.lit(0), F.col("cells") - 1).alias("cells"))
    pairs = (whole.join(cells, "g").join(cells.select(F.col("g").alias("g_b"), F.col("cells").alias("cells_b")), "g_b")
             .select("g", "g_b", F.explode("cells").alias("cell"), "cells_b").select("g", "g_b", "cell", F.explode("cells_b").alias("cell_b"))
             .where("g <> g_b OR cell <= cell_b"))
    # little data, many comparisons: keep the number of partitions
    n = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    two = blocks.select(F.col("g").alias("g_b"), F.col("cell").alias("cell_b"), F.col("block").alias("two"))
    both = (pairs.join(blocks.withColumnRenamed("block", "one"), ["g", "cell"]).repartition(n, "g_b", "cell_b")
            .join(two.repartition(n, "g_b", "cell_b"), ["g_b", "cell_b"])
            .select(((F.col("g") == F.col("g_b")) & (F.col("cell") == F.col("cell_b"))).alias("same"), "one", "two"))
    return both.mapInArrow(bk.tidy(_close_pairs), "a long, b long")


def _check(pairs: DataFrame, sketch: DataFrame, texts: DataFrame) -> DataFrame:
    a, b = (sketch.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "bins_a", "bins_b").mapInArrow(bk.tidy(_may_link), "a long, b long")
    near = written(near, "jaccard-near")
    release(texts.sparkSession)
    ta, tb = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = near.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(bk.tidy(_verify), "a long, b long, ok boolean")


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, rid, set, comp, n_shingles, component_id)`` for every row of ``docs``;
    ``comp`` is the component itself, as two may bear the name of one repeated doc_id."""
    docs = docs.select("doc_id", "text")
    keys = written(set_keys(docs), "jaccard-keys")
    texts = class_texts(docs, keys)
    release(docs.sparkSession)
    total = keys.agg(F.sum("n_shingles")).first()[0] or 0
    labels = connected_components(links(texts, total), "jaccard-all")
    placed = (keys.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"))
              .join(texts.groupBy("set").agg(F.min("node").alias("node")), "set").join(labels, "node", "left")
              .withColumn("comp", F.coalesce("label", "node")))
    names = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed.select("set", "comp").join(names, "comp").select("set", "comp", "component_id")
    out = keys.join(named, "set", "left")
    return out.select("doc_id", "rid", "set", "comp", "n_shingles",
                      F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, then the smallest
    text hash; of rows equal in both, any one. Rows without words or without doc_id stay
    (repeated rows without words: one)."""
    placed = components(docs).where("doc_id IS NOT NULL")
    winner = (placed.where("set IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "rid")).alias("w"))
              .select("w.doc_id", "w.rid"))
    keep = winner.union(placed.where("set IS NULL").select("doc_id", "rid")).distinct()
    rows = docs.select("doc_id", row_hash().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = F.row_number().over(Window.partitionBy("doc_id", "rid").orderBy("doc_id"))
    kept = rows.join(keep.hint("merge"), ["doc_id", "rid"]).withColumn("nth", first).where("nth = 1")
    return kept.select("row.*").union(docs.where("doc_id IS NULL"))
