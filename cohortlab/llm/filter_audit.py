"""Interaction audit of a chain of filters by forward-backward path counting (operator 11).

The states of a chain are the sets of filters applied so far, the edges add one filter, and an
order of the filters is a path from the empty to the full set. ``lattice`` counts the paths that
reach each state (forward) and that leave it for the full set (backward); their product says in
how many orders an edge is walked. What an edge removes (rows that fail its filter and none of
its state's) is counted once per edge and part. Each filter's edges, weighted by those products, sum
up to its Shapley value times the number of orders, and the steps of every single order are
read from the same edges. ``before`` restricts the orders: the lattice then has the allowed
states only, and the counts follow.

Rows are reduced to (part, failure bits) before anything is shuffled twice, so a hot part or
a text with millions of copies costs one counter per task. Copies are found by the text's SHA-256:
the first ``doc_id`` of each text, then an equi-join on text *and* id, which no copy group can skew.

Defined results: a null text is empty (and equal to empty texts), the empty text has no words,
A holds, B to D don't. A null part is the empty string. Rows without ``doc_id`` are
counted, have no label, never fail E and let no other row fail it. Rows with the same doc_id
and text are no copies of each other. A document has a label if any of its label rows says so. Empty tables give no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import SPACES, UPPER, text_or_empty, written

MAX_FILTERS = 7  # of which every order is listed (5,040 orders)


@dataclass(frozen=True)
class Lattice:
    """``edges``: (state, filter, orders that walk it); states and filters as bits and places."""

    n: int
    edges: tuple[tuple[int, int, int], ...]
    n_orders: int

    def orders(self) -> list[tuple[int, ...]]:
        """Every path from the empty to the full state."""
        following: dict[int, list[int]] = {}
        for state, f, _ in self.edges:
            following.setdefault(state, []).append(f)
        paths = [((), 0)]
        for _ in range(self.n):
            paths = [((*path, f), state | 1 << f) for path, state in paths for f in following[state]]
        return [path for path, _ in paths]


def lattice(n: int, before: Sequence[tuple[int, int]] = ()) -> Lattice:
    """The lattice of ``n`` filters; of each pair in ``before`` the first must come earlier."""
    needs = [sum({1 << a for a, b in before if b == f}) for f in range(n)]
    full = (1 << n) - 1
    steps = [(s, f) for s in range(full + 1) for f in range(n) if not s >> f & 1 and needs[f] & ~s == 0]
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for s, f in steps:  # states ascend: all paths into s are counted
        forward[s | 1 << f] += forward[s]
    for s, f in reversed(steps):
        backward[s] += backward[s | 1 << f]
    if not backward[0]:
        raise ValueError("no order of the filters is allowed")
    walked = ((s, f, forward[s] * backward[s | 1 << f]) for s, f in steps)
    return Lattice(n, tuple(e for e in walked if e[2]), backward[0])


def _longs(values) -> Column:
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast("array<bigint>")


def _total(cells: Column, of: str, keep) -> Column:
    return F.aggregate(F.filter(cells, keep), F.lit(0).cast("long"), lambda acc, c: acc + c[of])


def audit(rows: DataFrame, names: str, tallies: Sequence[str] = (), before: Sequence[str] = ()) -> DataFrame:
    """Audit of ``rows(part, mask, *tallies)``; bit i of ``mask``: the row fails filter ``names[i]``.

    ``names`` has one letter per filter, ``tallies`` are 0/1 columns whose removed rows are counted too
    (``<tally>_lost``), ``before`` has pairs such as "AC": A is always applied before C. One row per part, order and step.
    """
    n = len(names)
    if not 0 < n <= MAX_FILTERS or len(set(names)) != n:
        raise ValueError(f"1 to {MAX_FILTERS} filters with different letters are needed")
    grid = lattice(n, [(names.index(a), names.index(b)) for a, b in before])
    orders = grid.orders()
    counted = ["n", *tallies]
    cells = (rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.col(t).cast("long")).alias(t) for t in tallies])
             .groupBy("part").agg(F.collect_list(F.struct("mask", *counted)).alias("cells")))  # at most 2^n cells
    at = F.col("cells")
    bit = lambda f: F.pow(F.lit(2), f).cast("int")
    edge_states, edge_filters, weights = (_longs(column) for column in zip(*grid.edges))

    def edge(i):
        state, f = F.get(edge_states, i).cast("int"), F.get(edge_filters, i).cast("int")
        gone = lambda c: (c["mask"].bitwiseAND(bit(f)) != 0) & (c["mask"].bitwiseAND(state) == 0)
        return F.struct(f.alias("filter"), F.get(weights, i).alias("weight"), *[_total(at, t, gone).alias(t) for t in counted])

    counts = cells.select(
        "part",
        F.transform(F.sequence(F.lit(0), F.lit(len(grid.edges) - 1)), edge).alias("edges"),
        F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: _total(at, "n", lambda c: c["mask"].bitwiseAND(s) == 0)).alias("left"),
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.struct(
            _total(at, "n", lambda c: c["mask"].bitwiseAND(bit(f)) != 0).alias("fails"),
            _total(at, "n", lambda c: c["mask"] == bit(f)).alias("only"))).alias("filters"))
    shares = counts.withColumn("shapley", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.aggregate(
        F.filter("edges", lambda e: e["filter"] == f), F.lit(0).cast("long"), lambda acc, e: acc + e["weight"] * e["n"])))

    place = {(s, f): i for i, (s, f, _) in enumerate(grid.edges)}
    walked, reached = [], []
    for order in orders:
        state = 0
        for f in order:
            walked.append(place[state, f])
            state |= 1 << f
            reached.append(state)
    shown = F.split(F.lit(",".join("".join(names[f] for f in order) for order in orders)), ",")
    walked, reached = _longs(walked), _longs(reached)

    def step(i):
        def row(e):
            own = F.get(F.col("filters"), e["filter"])
            return F.struct(
                F.get(shown, (i / n).cast("int")).alias("filter_order"), (i % n + 1).cast("int").alias("step"),
                F.substring(F.lit(names), e["filter"] + 1, F.lit(1)).alias("filter"),
                F.get(F.col("left"), F.get(reached, i).cast("int")).alias("kept"), e["n"].alias("removed"),
                (own["fails"] - e["n"]).alias("redundant"), own["only"].alias("unique_fails"),
                *[e[t].alias(f"{t}_lost") for t in tallies], F.get(F.col("shapley"), e["filter"]).alias("shapley"))

        return F.transform(F.array(F.get(F.col("edges"), F.get(walked, i).cast("int"))), row)[0]

    return shares.select("part", F.inline(F.transform(F.sequence(F.lit(0), F.lit(len(orders) * n - 1)), step)))


def text_failures(text: Column, min_words: int = 50, min_distinct_pct: int = 65, max_upper_pct: int = 5,
                  marks: str = "#$%&*|") -> list[Column]:
    """Failure conditions of the four text filters: few words, few distinct words, capitals, marks."""
    words = F.filter(F.split(text, "[ \t-\r]+", -1), lambda w: w != "")
    # one array per row, measured three times
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    upper = F.octet_length(text) - F.octet_length(F.translate(text, UPPER, ""))
    return [sizes["n"] < min_words, 100 * sizes["d"] < min_distinct_pct * sizes["n"],
            100 * upper.cast("long") > max_upper_pct * F.char_length(text).cast("long"),
            F.char_length(F.translate(text, marks, "")) < F.char_length(text)]


def failure_bits(docs: DataFrame, part: str = "source") -> DataFrame:
    """``(doc_id, part, mask)`` of every row: bits 0 to 3 by ``text_failures``, bit 4: copy of a smaller doc_id's text."""
    text = F.col("text")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       text_or_empty().alias("text"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(text))]
    rows = written(read.select("doc_id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest")), "audit-rows")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` by source, with good and toxic documents lost."""
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    rows = failure_bits(docs).join(marks, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return audit(rows, "ABCDE", ["good", "toxic"])
