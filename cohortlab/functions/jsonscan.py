"""Complete JSON values in free text, as column expressions.

``json_spans`` reads a text from left to right. At each opening brace or bracket a stack automaton follows braces,
brackets, quotes and escapes to the end of that value; if there is one and it is JSON, the value is taken and
reading goes on behind it, else at the next opener, inside or behind. So values are found before, inside and after
prose, between broken ones, and behind an opener that never closes; braces in strings don't count. A truncated value
at the end is no value, what is complete inside it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# an escape, one character that the automaton minds, or a run of others
TOKEN = r'(?s)\\.|["{}\[\]\\]|[^"{}\[\]\\]+'


def _end(tokens: Column) -> Column:
    """How many tokens the value that the first one opens has; 0 if it doesn't end or its brackets don't match."""
    start = F.struct(F.lit("").alias("stack"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(s: Column, t: Column) -> Column:
        quote, opens, closes = t == '"', t.isin("{", "["), t.isin("}", "]")
        matches = F.substring(s["stack"], 1, 1) == F.when(t == "}", F.lit("{")).otherwise(F.lit("["))
        stack = (F.when(s["quoted"], s["stack"]).when(opens, F.concat(t, s["stack"]))
                 .when(closes, F.substring(s["stack"], 2, 1 << 30)).otherwise(s["stack"]))
        over = (F.when(~s["quoted"] & closes & ~matches, F.lit(0))
                .when(~s["quoted"] & closes & (F.char_length(s["stack"]) == 1), s["at"] + 1).otherwise(F.lit(-1)))
        after = F.struct(stack.alias("stack"), (s["quoted"] != quote).alias("quoted"), (s["at"] + 1).alias("at"), over.alias("end"))
        return F.when(s["end"] >= 0, s).otherwise(after)

    return F.aggregate(tokens, start, step, lambda s: F.greatest(s["end"], F.lit(0)))


def json_spans(text: Column) -> Column:
    """Every complete object or list of ``text`` that is not inside another one, in order, as ``array<string>`` (null: null)."""
    def scan(tokens: Column) -> Column:
        n = F.size(tokens)
        openers = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(tokens, i - 1).isin("{", "["))
        state = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("spans"))

        def visit(s: Column, i: Column) -> Column:
            def take(found: Column) -> Column:
                whole = F.array_join(F.slice(tokens, i, found), "")
                good = (found > 0) & F.try_parse_json(F.when(found > 0, whole)).isNotNull()
                return F.when(good, F.struct((i + found).alias("next"), F.concat(s["spans"], F.array(whole)).alias("spans"))).otherwise(s)
            return F.when(i < s["next"], s).otherwise(F.transform(F.array(_end(F.slice(tokens, i, n))), take)[0])

        return F.aggregate(openers, state, visit, lambda s: s["spans"])

    return F.when(text.isNotNull(), F.transform(F.array(F.regexp_extract_all(text, F.lit(TOKEN), 0)), scan)[0])
