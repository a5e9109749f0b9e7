from __future__ import annotations

import json

import pytest

from trellis.sources import config, files

RAW = {
    "conditions": {"no_tool": {"system_prompt": "S"}, "tool": {"tools_enabled": True, "max_reasoning_calls": 3}},
    "models": [{"id": "a/b", "pricing": {"input": 1, "output": 2.5}}, {"id": "off", "enabled": False}],
    "templates": {"A1": {"template": "Is {x}?", "count": 5, "sampling": {"n": 1}}},
}


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(RAW))
    c = config.load(str(tmp_path / "c.json"))
    assert [x.name for x in c.conditions] == ["no_tool", "tool"] and c.conditions[1].max_reasoning_calls == 3
    assert c.templates[0].options == {"sampling": {"n": 1}}
    assert [tuple(r) for r in c.model_table(spark).collect()] == [("a/b", "recorded", 1.0, 2.5)]
    q = spark.createDataFrame([("1",), ("2",)], "id string")
    assert sorted(tuple(r) for r in c.matrix(spark, q).collect()) == [("1", "a/b", "no_tool"), ("1", "a/b", "tool"), ("2", "a/b", "no_tool"), ("2", "a/b", "tool")]


@pytest.mark.parametrize(("raw", "place"), [({"models": [{}]}, r"models\[0\]"), ({"conditions": {"t": {"tools_enabled": 1}}}, "conditions.t.tools_enabled"), ({"models": [{"id": "a", "tool_mode": "x"}]}, "tool_mode")])
def test_wrong_config(raw, place):
    with pytest.raises((TypeError, ValueError), match=place):
        config.from_dict(raw)


def test_preflight(spark):
    h = files.graph_from_rows(spark, ["r", "a"], [{"source": "r", "target": "a"}], "r")
    good = spark.createDataFrame([("1", "t", "A1", {"A": "x"}, ["A"])], "id string, text string, task_type string, options map<string,string>, correct array<string>")
    assert config.preflight(config.from_dict(RAW), good, h) == []
    bad = config.preflight(config.Config(), good.unionByName(good), h.with_edge("a", "r", "related", 9))
    assert bad == ["no model is enabled", "there is no condition", "1 questions repeat an id", "the hierarchy has a cycle"]
    odd = files.graph_from_rows(spark, ["r", "a"], [{"source": "r", "target": "a", "path_type": "root-branch"}], "r")
    assert config.preflight(config.from_dict(RAW), good, odd) == ["edges of type 'root-branch' have no weight"]
