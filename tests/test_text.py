from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trellis.functions import scoring, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first().r


SINGLE = [
    ("Therefore, I select (B).", "x", "B", "I select (X)"),
    ("I select **(B)**", "mistral-medium-3.1", "B", "I select (X) [normalized]"),
    ("answer is c", "x", "C", "answer is X"),
    ("I select a ripe one", "x", "A", "I select X"),
    ("Hm. I would choose (D) or (A). Yes.", "x", "A", "Last (X) [low-confidence]"),
    ("I pick B. One. Two. Three. Four.", "x", None, None),
    ("no signal (A)", "x", None, None),
    ("", "x", None, None),
    (None, "x", None, None),
]


@pytest.mark.parametrize(("t", "model", "answer", "pattern"), SINGLE)
def test_single(spark, t, model, answer, pattern):
    got = one(spark, t, lambda c: text.parse_single(c, F.lit(None).cast("string"), F.lit(model)))
    assert (got and got.answer, got and got.pattern) == (answer, pattern)


def test_single_from_thinking(spark):
    got = one(spark, "Nothing.", lambda c: text.parse_single(c, F.lit("so I select (D)"), F.lit("x")))
    assert (got.answer, got.pattern) == ("D", "I select (X) [thinking]")


@pytest.mark.parametrize(
    ("t", "answers"),
    [("Therefore, I select (A, C).", ["A", "C"]), ("I select NONE", []), ("I select (none)", []), ("I select (x, y). The answer is (b,f)", ["B", "F"]), ("I think (A, C)", None), ("I select (A) or so; answer is D", ["A"])],
)
def test_multi(spark, t, answers):
    got = one(spark, t, lambda c: text.parse_multi(c, F.lit(None).cast("string"), F.lit("x")))
    assert (got and got.answer) == answers if answers is not None else got is None


def test_truncated_parenthesis_is_closed_for_its_model(spark):
    got = one(spark, "I select (A, B", lambda c: text.parse_multi(c, F.lit(None).cast("string"), F.lit("openai/gpt-oss-120b")))
    assert got.answer == ["A", "B"]


@pytest.mark.parametrize(("t", "score"), [("The response shows good reasoning. Score: 4", 4), ("Score: 2\nfinal score 5", 2), ("it is 3/5", 3), ("3 out of 5 maybe", 3), ("I give it 4 in all", 4), ("12 or 9", None), ("1 then 2", 2)])
def test_judge(spark, t, score):
    got = one(spark, t, text.parse_judge_score)
    assert (got and got.answer) == score


def test_thinking_blocks(spark):
    got = one(spark, "<think>Option A seems wrong...</think>Therefore, I select (B).<reasoning> r </reasoning>", text.strip_thinking)
    assert (got.clean, got.thinking) == ("Therefore, I select (B).", "Option A seems wrong...\n\nr")
    assert one(spark, "plain ", text.strip_thinking).thinking is None


def test_tool_call(spark):
    got = one(spark, 'Let me see.\nTOOL_CALL: {"name": "get_parent", "args": {"descriptor": "blueberry"}}', text.parse_tool_call)
    assert (got.name, got.args) == ("get_parent", '{"descriptor":"blueberry"}')
    assert one(spark, 'TOOL_CALL: {"name": "", "args": {}}', text.parse_tool_call) is None
    assert one(spark, 'TOOL_CALL: {"name": "a", "args": [1]}', text.parse_tool_call).args == "{}"
    assert one(spark, 'TOOL_CALL: {"name": 3}', text.parse_tool_call) is None


def test_tokens_are_of_any_script(spark):
    assert sorted(one(spark, "The café-Bar, of 2 naïve", text.tokens)) == ["2", "bar", "café", "naïve"]


@pytest.mark.parametrize(("t", "w"), [("x", 4), ("ab", 5), ("abc", 8), ("abcd", 3), ("", 3)])
def test_centred(spark, t, w):
    assert one(spark, t, lambda c: text.centred(c, w)) == t.center(w)


@pytest.mark.parametrize(
    ("judge", "status", "kind", "answer", "gold", "right", "score"),
    [(None, "success", "single", ["B"], ["B"], True, 1.0), (None, "success", "multi", ["A", "C"], ["B", "C", "D"], False, 0.4), (4, "api_error", "open", None, None, None, 0.8), (None, "tool_error", "single", ["B"], ["B"], True, 0.0), (None, "success", "multi", [], [], True, 1.0), (None, "success", "multi", [], ["A"], False, 0.0)],
)
def test_score(spark, judge, status, kind, answer, gold, right, score):
    df = spark.createDataFrame([(judge, status, kind, answer, gold, right)], "j int, s string, k string, a array<string>, g array<string>, r boolean")
    assert df.select(scoring.question_score(*map(F.col, "jskagr")).alias("x")).first().x == pytest.approx(score)
