"""Op 66: complete JSON values in replies, against Python's decoder."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.jsonscan import json_spans
from cohortlab.operators.prompts import parse_response


def decoded(text):
    """The same reading with json.JSONDecoder.raw_decode at every opener."""
    out, at = [], 0
    while at < len(text):
        if text[at] in "{[":
            try:
                _, end = json.JSONDecoder().raw_decode(text, at)
            except (json.JSONDecodeError, RecursionError):
                pass
            else:
                out.append(text[at:end])
                at = end
                continue
        at += 1
    return out


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    return {r.id: r.s for r in df.select("id", json_spans(F.col("t")).alias("s")).collect()}


def value(draw, depth):
    kind = draw.randrange(6 if depth else 4)
    if kind == 0:
        return draw.choice([1, -2.5, 0, True, None])
    if kind < 4:
        return draw.choice(["a", "é{", "}\"", "[x]", "\\", "tab\t\"{", "", "line\n", "日本"])
    if kind == 4:
        return [value(draw, depth - 1) for _ in range(draw.randrange(4))]
    return {draw.choice("abcd{"): value(draw, depth - 1) for _ in range(draw.randrange(4))}


def reply(draw):
    parts = []
    for _ in range(draw.randrange(5)):
        text = json.dumps(draw.choice([value(draw, 3), {"answer": value(draw, 1)}, [value(draw, 1)]]), ensure_ascii=draw.random() < 0.5)
        if draw.random() < 0.3:
            text = text[:draw.randrange(len(text) + 1)]  # a truncated one
        parts += [draw.choice(["", "so ", "{draft} ", "[1, 2 ", "see {", "it's ", "]", "}", "```json\n", "\n\n"]), text]
    return "".join(parts)


def test_random_replies_against_the_decoder(spark):
    draw = random.Random(8)
    texts = [t for t in (reply(draw) for _ in range(1500)) if '\\{' not in t and '\\[' not in t]
    texts += ['{"a": {"b": [1, {"c": "}"}]}} and {"d": {"e": 1}}', '{"a": 1', '{ {"a": 1}', '[{"a": "\\""}]x', "", "no", '{"a": "]"}]', "[[[]]", '{"k": "{"} {"k": "}"}']
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == decoded(t), t


def test_null_and_long_replies(spark):
    long = "{" * 300 + " words " * 2000 + json.dumps({"think": "x" * 50_000, "answer": 1})
    got = spans(spark, [None, long])
    assert got[0] is None and got[1] == decoded(long)


@pytest.mark.parametrize("text,want", [
    ('first {"think": "a", "answer": {"x": 1}} then {"think": "b", "answer": 0.25, "more": {"y": [1]}} done', 0.25),
    ('{"notes": {"k": 1}} {"think": "t", "answer": 0.5, "why": {"a": {"b": 1}}} and {broken', 0.5),
    ('[{"think": "a", "answer": 0.1, "o": {}}] or {"x": {"y": 1}}', 0.1),
])
def test_nested_objects_in_a_reply(spark, text, want):
    r = parse_response(spark.createDataFrame([(text,)], "response string")).first()
    assert r.status == "ok" and r.pred == want
