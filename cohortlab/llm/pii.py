"""Personal data: base patterns, and more by bootstrapped context (operator 6, native).

Base spans are regular expressions (email, ip, card, phone) with exact offsets: matches
are marked with a private-use character, the text is split there, and a running sum over
the pieces gives the code point offsets. All of it is column expressions and windows.

Bootstrapping: base spans are the seed instances, identifier-like tokens and digit groups outside
them (four digits or more, or an @) the unseen ones; the two words before an instance, and the word
before with the word behind, are its lexical patterns. In each round a pattern's
confidence for a kind is the share of its occurrences held by instances of that kind; patterns
with enough confidence and different instances pass it on to all their instances (noisy or),
and instances above the threshold count as found in the next round. Their occurrences
are the added spans. Base spans always stay.

Expressions avoid what could run away on odd texts: no unbounded repeated groups (deep
recursion), possessive runs that start only where a run can start (no quadratic scans).

Defined results: null text is empty. Rows equal in doc_id and text get equal results; rows
may lack a doc_id. The private-use characters U+E000 and U+E001 in a text count as any
other character. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import row_hash, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
_MARK, _JOIN = "\ue000", "\ue001"
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base expressions, written so that a run is tried once: where it starts, or where the last match ended.
_EXPRESSION = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # single spaces and hyphens between digits are _JOIN here; other lengths than 13 to 19 digits fail anyway
    "card": rf"(?<![0-9{_JOIN}])[0-9](?:{_JOIN}?+[0-9]){{12,18}}(?![0-9{_JOIN}])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_WORTH = {  # cheap tests first: texts without it have no match
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))"
_TOKEN = r"(?<!\S)(?=\S*?[0-9@])\S++"
#: A single space between digit groups, which may be in round brackets: such groups can be one identifier.
_GAP = r"(?:(?<=[0-9])|(?<=[0-9]\))) (?=\(?[0-9])"
_NEAR = 6   # pieces to each side that can hold two words
_ROW = ["doc_id", "rid"]


def _passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.when(kind == "ip", value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
            .when(kind == "card", F.call_function("luhn_check", digits))
            .when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True))


def _matches(rows: DataFrame, expression: str, text: Column, kind: str) -> DataFrame:
    """``(doc_id, rid, kind, start, value, left, right)``: each match, its place and what lies around it."""
    marked = F.regexp_replace(text, expression, f"{_MARK}$0{_MARK}")
    cut = rows.select(*_ROW, "copy", F.lit(kind).alias("kind"), F.posexplode(F.split(marked, _MARK, -1)).alias("pos", "value"))
    one = Window.partitionBy(*_ROW, "copy", "kind").orderBy("pos")   # odd pieces are the matches
    before = F.sum(F.char_length("value").cast("long")).over(one.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("value")
    left = F.concat_ws("", *[F.lag(F.substring("value", -80, 80), i).over(one) for i in range(_NEAR, 0, -1)])
    right = F.concat_ws("", *[F.lead(F.substring("value", 1, 80), i).over(one) for i in range(1, _NEAR + 1)])
    return (cut.withColumn("start", before).withColumn("left", F.substring(left, -80, 80))
            .withColumn("right", F.substring(right, 1, 80)).where("pos % 2 = 1").drop("pos"))


def _patterns() -> list[Column]:
    """The lexical patterns of a match: two words before it; one before and one behind."""
    w1, w2 = (F.lower(F.regexp_extract("left", e, 1)) for e in (r"(\S+)\s+$", r"(\S+)\s+\S+\s+$"))
    w3 = F.lower(F.regexp_extract("right", r"^\s+(\S+)", 1))
    return [F.when((w1 != "") & (w2 != ""), F.concat_ws(" ", F.lit("<"), w2, w1)).alias("two"),
            F.when((w1 != "") & (w3 != ""), F.concat_ws(" ", F.lit("="), w1, w3)).alias("around")]


def candidates(docs: DataFrame) -> DataFrame:
    """Rows that can hold anything, with private-use marks replaced; ``copy`` tells repeated rows apart."""
    text = F.translate(text_or_empty(), _MARK + _JOIN, "??")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rid"), text.alias("text"))
            .where(F.col("text").rlike("[0-9@]")).withColumn("copy", F.monotonically_increasing_id()))


def base_spans(rows: DataFrame) -> DataFrame:
    """``(doc_id, rid, start, stop, value, two, around, kind)`` of the base patterns in candidate rows."""
    found = []
    for kind in KINDS:
        text = F.col("text")
        if kind == "card":
            text = F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", _JOIN)
        found.append(_matches(rows.where(_WORTH[kind](F.col("text"))), _EXPRESSION[kind], text, kind))
    spans = reduce(DataFrame.unionByName, found).where(_passes(F.col("kind"), F.col("value")))
    return spans.select(*_ROW, "start", (F.col("start") + F.char_length("value")).alias("stop"), F.lower("value").alias("value"),
                        *_patterns(), "kind").distinct()


def tokens(rows: DataFrame) -> DataFrame:
    """Identifier-like tokens, and digit groups with single spaces between them, without the brackets and stops
    around them: ``(doc_id, rid, start, stop, value, two, around)``."""
    joined = _matches(rows.where(F.col("text").rlike(_GAP)), _TOKEN, F.regexp_replace("text", _GAP, _JOIN), "joined")
    joined = joined.where(F.contains(F.col("value"), F.lit(_JOIN))).select(
        *[F.translate(c, _JOIN, " ").alias(c) if c in ("value", "left", "right") else c for c in joined.columns])
    found = _matches(rows, _TOKEN, F.col("text"), "token").unionByName(joined)
    opening = r"""^(?:(?!\([0-9]{1,5}\)[ .-]?[0-9])[(\[{<"']){0,8}+"""  # the brackets of an area code stay
    head = F.char_length(F.regexp_extract("value", opening, 0))
    inner = F.regexp_extract("value", opening + r"""(.*?)[)\]}>"'.,;:!?]*$""", 1)
    got = found.where(F.char_length("value") <= 200).select(
        *_ROW, (F.col("start") + head).alias("start"), F.lower(inner).alias("value"), F.char_length(inner).alias("size"), *_patterns())
    like = (F.length(F.regexp_replace("value", "[^0-9]", "")) >= 4) | F.contains(F.col("value"), F.lit("@"))
    return got.where(like & F.col("size").between(5, 64)).select(
        *_ROW, "start", (F.col("start") + F.col("size")).alias("stop"), "value", "two", "around").distinct()


def outside(found: DataFrame, spans: DataFrame) -> DataFrame:
    """The tokens that no base span overlaps: a sweep over both by offset."""
    both = found.withColumn("token", F.lit(True)).unionByName(
        spans.select(*_ROW, "start", "stop").withColumn("token", F.lit(False)), allowMissingColumns=True)
    # a span reaches into a token from before (or starts with it), or starts inside it
    order = Window.partitionBy(*_ROW).orderBy("start", "token")
    reach = F.max(F.when(~F.col("token"), F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(~F.col("token"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("stop"), F.lit(True))
    return (both.withColumn("reach", reach).withColumn("ahead", ahead).where(F.col("token") & free)
            .select(*_ROW, "start", "stop", "value", "two", "around"))


def bootstrap(found: DataFrame, rounds: int = 3, confidence: float = 0.6, support: int = 8, accept: float = 0.8) -> DataFrame:
    """``(value, kind, score)`` of unseen instances, from instances ``(value, two, around, kind)`` (kind null: none yet)."""
    # a row for each pattern and instance; n: how often they occur together
    graph = written(found.select(F.explode(F.array("two", "around")).alias("pattern"), "value").where("pattern IS NOT NULL")
                    .groupBy("pattern", "value").agg(F.count("*").alias("n")), "pii-graph")
    total = graph.groupBy("pattern").agg(F.sum("n").alias("all"))
    seeds = written(found.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    known, new = seeds, None
    for _ in range(rounds):
        patterns = (graph.join(known, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count("*").alias("values"))
                    .where(F.col("values") >= support).join(total, "pattern")
                    .withColumn("confidence", F.col("hit") / (F.col("all") + 1)).where(F.col("confidence") >= confidence))
        scored = (graph.join(patterns.select("pattern", "kind", "confidence"), "pattern").groupBy("value", "kind")
                  .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")).where(F.col("score") >= accept))
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        new = written(best.join(seeds.select("value").distinct(), "value", "left_anti"), "pii-round")
        known = seeds.unionByName(new.select("value", "kind", "score"))
    return new


def spans(docs: DataFrame, **params) -> DataFrame:
    """``(doc_id, rid, kind, start, stop, base)`` of all spans."""
    rows = candidates(docs)
    base = written(base_spans(rows), "pii-base")
    free = written(outside(tokens(rows), base), "pii-tokens")
    new = bootstrap(base.unionByName(free, allowMissingColumns=True), **params)
    added = free.join(new, "value").select(*_ROW, "kind", "start", "stop").distinct()
    wider = Window.partitionBy(*_ROW).orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reach", F.max("stop").over(wider)).where("reach IS NULL OR stop > reach").drop("reach")  # tokens lie inside groups
    return base.select(*_ROW, "kind", "start", "stop").withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False)))


def report(docs: DataFrame, **params) -> DataFrame:
    """The query's columns for every row of ``docs``; ``n_added`` counts the spans that the method adds."""
    docs = docs.select("doc_id", "text")
    order = reduce(lambda c, i: c.when(F.col("kind") == KINDS[i], i), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    item = F.struct(order.alias("o"), "start", "stop", "kind")
    count = lambda kind: F.sum(F.when((F.col("kind") == kind) & F.col("base"), 1).otherwise(0)).alias(f"n_{kind}")
    found = spans(docs, **params).groupBy(*_ROW).agg(
        *[count(k) for k in KINDS], F.sum(F.when(F.col("base"), 0).otherwise(1)).alias("n_added"),
        F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("own"), F.array_sort(F.collect_list(item)).alias("every"))
    show = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rid"))
    f = found.select(F.col("doc_id").alias("f_id"), F.col("rid").alias("f_rid"), *[f"n_{k}" for k in KINDS], "n_added",
                     show("own").alias("own"), show("every").alias("every"))
    out = rows.join(f, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("rid") == F.col("f_rid")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[zero(f"n_{k}") for k in KINDS], zero("n_added"),
                      F.sha2(F.coalesce("own", F.lit("")), 256).alias("base_sha256"), F.coalesce("every", F.lit("")).alias("spans"))
