from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trellis.functions import checks, prompts


def test_arguments():
    assert checks.boolean(True, "x") and checks.integer(3, "x", 0, 5) == 3 and checks.number(2, "x") == 2.0
    assert checks.string("a", "x", ["a"]) == "a" and checks.sequence([1], "x", int) == [1] and checks.mapping({"a": 1}, "x", ["a"]) == {"a": 1}
    for bad in (lambda: checks.integer(True, "x"), lambda: checks.boolean(1, "x"), lambda: checks.number("1", "x"), lambda: checks.string(1, "x"), lambda: checks.sequence((1,), "x"), lambda: checks.sequence(["a"], "x", int), lambda: checks.mapping([], "x")):
        with pytest.raises(TypeError, match="x"):
            bad()
    for bad in (lambda: checks.integer(9, "x", 0, 5), lambda: checks.number(-1, "x", 0), lambda: checks.string("b", "x", ["a"]), lambda: checks.mapping({}, "x", ["a"])):
        with pytest.raises(ValueError, match="x"):
            bad()


def test_rendering_leaves_other_braces():
    assert prompts.rendered('{"a": {b}} {name} {c}', name="N") == '{"a": {b}} N {c}'
    assert {t["function"]["name"] for t in prompts.tools()} == {"validate_descriptors", "get_parent", "get_children"}


@pytest.mark.parametrize(
    ("options", "kind", "end"),
    [({}, "open", "Answer in a few sentences."), ({"B": "y", "A": "x"}, "single", "X is A or B."), ({"A": "x", "B": "y", "C": "z"}, "single", "X is A, B, or C."), ({"A": "x", "B": "y"}, "multi", "Choose all that apply of A, B, or NONE.")],
)
def test_answer_format(spark, options, kind, end):
    df = spark.createDataFrame([(options,)], "o map<string,string>")
    assert df.select(prompts.answer_format(F.col("o"), F.lit(kind)).alias("a")).first().a.endswith(end)


def test_messages_without_options(spark):
    m = spark.range(1).select(prompts.messages_of(F.lit("S \n"), F.lit("T"), F.create_map().cast("map<string,string>"), F.lit("open"), F.lit(True)).alias("m")).first().m
    assert (m[0].content, m[1].content) == ("S\nTraversal calls are limited.", "T\n\n\n\nAnswer in a few sentences.")
